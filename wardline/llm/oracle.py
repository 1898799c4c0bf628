"""DuckDB twins of the queries that SQL can express."""

_SP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

# crc32 as SQL: the 256 table entries by the polynomial's rule, then one look-up a byte.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(byte_list: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


# Merkle levels and walks, for trees named by column t: (t, lvl, idx, n, h) up, siblings beside each node.
def _merkle_up(name: str, base: str) -> str:
    return f"""{name} AS ({base} UNION ALL
  SELECT t, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY t, lvl, idx // 3, n),
{name}_side AS (SELECT t, lvl, idx, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
  coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY t, lvl, idx // 3 ORDER BY idx))"""


def _merkle_walk(name: str, tree: str, base: str) -> str:
    return f"""{name} AS ({base} UNION ALL
  SELECT w.rid, w.t, w.lvl + 1, w.idx // 3, sha256(s.bef || w.cur || s.aft), w.proof || s.bef || s.aft
  FROM {name} w JOIN {tree}_side s ON s.t IS NOT DISTINCT FROM w.t AND s.lvl = w.lvl AND s.idx = w.idx),
{name}_end AS (SELECT rid, t, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM {name} GROUP BY rid, t)"""


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (
    "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "@")) + ")"

ORACLE = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, {_crc("flatten(list_transform(string_split(id || ':' || run, ''), lambda x: "
                              "CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END))")} AS h
  FROM runs, crc_table),
said AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
less AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word AS w, b.word AS v FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT w, v, b.n, count(*) OVER (PARTITION BY w) AS n_near FROM near JOIN words b ON b.word = v
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY b.n DESC, v) = 1),
forms AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * words.n THEN v END AS form,
  CASE WHEN best.n >= 5 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best ON w = word),
chain AS (SELECT word, word AS tip, 0 AS d FROM forms
  UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(tip, d) AS root FROM chain GROUP BY word) USING (word)""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF.replace("@", "text")} AS leaf, CASE WHEN {
        _crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x))")} % 2 = 0 THEN {
        _LEAF.replace("@", "replace(text, chr(10), '')")} ELSE {_LEAF.replace("@", "text")} END AS seen FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY source) AS n FROM docs),
{_merkle_up("low", "SELECT source AS t, 0 AS lvl, idx, n, leaf AS h FROM leaves")},
subs AS (SELECT t AS source, h AS subroot, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_merkle_up("high", "SELECT 0 AS t, 0 AS lvl, idx, n, subroot AS h FROM subs")},
{_merkle_walk("climb", "low", "SELECT rid, source AS t, 0 AS lvl, idx, seen AS cur, '' AS proof FROM leaves")},
{_merkle_walk("rise", "high", "SELECT rid, 0 AS t, 0 AS lvl, subs.idx, cur, proof FROM climb_end JOIN subs ON subs.source IS NOT DISTINCT FROM climb_end.t")}
SELECT doc_id, leaf, subroot, high.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = high.h AS verified
FROM leaves JOIN subs ON subs.source IS NOT DISTINCT FROM leaves.source JOIN rise_end USING (rid) JOIN high ON high.n = 1""",
    # every pair of one label; the index must find the same links
    "op13_vector_near_duplicates": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid, a.vec_id, b.vec_id AS other FROM usable a JOIN usable b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach AS (SELECT vec_id, other FROM links UNION SELECT r.vec_id, l.other FROM reach r JOIN links l ON l.vec_id = r.other),
comp AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
many AS (SELECT rid, count(*) AS n FROM links GROUP BY rid)
SELECT vec_id, coalesce(many.n, 0) AS n_links, least(vec_id, comp.other) AS component_id, vec_id = least(vec_id, comp.other) AS kept
FROM v LEFT JOIN many USING (rid) LEFT JOIN comp USING (vec_id)""",
    "op2_line_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
win AS (SELECT rid, i, ws[i:i+4] AS v FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, v) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 5) t(k) GROUP BY rid),
ln AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT rid, source, l, len(regexp_extract_all(l, '{_WORD}')) AS n,
       trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
                           '{_SP}', ' ', 'g'), ' ') AS nl FROM ln),
lines AS (SELECT * FROM lw WHERE n > 0),
dup AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, l, count(*) AS c FROM lines GROUP BY rid, l) GROUP BY rid),
host AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT f.source, f.nl FROM (SELECT source, nl, count(DISTINCT rid) AS n FROM lines GROUP BY source, nl) f
         JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n >= 10 AND f.n * 100 > h.n),
kept AS (SELECT x.rid, sum(CASE WHEN f.nl IS NULL THEN x.n ELSE 0 END) AS words_left, count(f.nl) AS lines_removed
         FROM lines x LEFT JOIN freq f ON x.source IS NOT DISTINCT FROM f.source AND x.nl = f.nl GROUP BY x.rid),
m AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(kept.words_left, 0)::BIGINT AS words_left,
      coalesce(kept.lines_removed, 0)::BIGINT AS lines_removed
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN kept USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (words_left < 10 OR words_left * 100 < n_words * 30) AS kept FROM m""",
    "op5_url_filter": r"""
WITH p AS (SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS s FROM pages),
q AS (SELECT page_id, CASE WHEN s > 0 THEN substr(url, s + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM q),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
      || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') END AS canonical FROM h),
r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
      ('allow', 'com/fr/'), ('block', 'com/de/')),
f AS (SELECT page_id, host, path, canonical, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS rv
      FROM c JOIN r ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1))
       AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id, host, path, canonical),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1)
SELECT c.page_id, c.host, c.path, f.rule, l.canonical IS NOT NULL AS listed, c.canonical,
       coalesce(f.rv, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id IS NOT DISTINCT FROM f.page_id AND c.host = f.host AND c.path = f.path
LEFT JOIN l ON c.canonical = l.canonical""",
}
