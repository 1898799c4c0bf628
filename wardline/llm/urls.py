"""URL filter: host/path rules, and a blocked Bloom filter in front of an exact hash join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialise
from .common import ascii_lower

# Fixed values: (verdict, rule) as the contract lists them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
WORDS = 4          # longs of one Bloom block: 256 bits
PROBES = 6         # bits set per key inside its block
KEYS_PER_BLOCK = 16
# A block row is 40 bytes and a listed key 16: at most about 20 MB are broadcast.
BROADCAST_BLOCKS = 1 << 19


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, query, fragment, ``www.``/``m.`` label, ``.html`` and final slash."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html$", ""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host (or a parent domain) and path; else NULLs."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        rhost, slash, rpath = r.partition("/")
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(slash + rpath)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _probe_bits(key: Column) -> list[Column]:
    """Positions 0..255 of a key's bits inside its block, from its second hash."""
    return [F.shiftrightunsigned(key, 8 * i).bitwiseAND(F.lit(255)) for i in range(PROBES)]


def _masks(key: Column) -> list[Column]:
    """The four 64-bit words of a key's bits."""
    masks = []
    for word in range(WORDS):
        m = F.lit(0).cast("long")
        for bit in _probe_bits(key):
            here = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
            m = m.bitwiseOR(F.when(F.shiftright(bit, 6) == word, here).otherwise(F.lit(0).cast("long")))
        masks.append(m)
    return masks


def build_blocked_bloom(listed: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """One row (bloom_block, w0..w3) per non-empty block: bitwise OR of its keys' masks."""
    key = F.xxhash64(F.lit(1), F.col(column))
    return (listed.select(F.pmod(F.xxhash64(F.col(column)), F.lit(n_blocks)).alias("bloom_block"),
                          *[m.alias(f"w{i}") for i, m in enumerate(_masks(key))])
            .groupBy("bloom_block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def listed_by_bloom(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Add ``bloom_hit`` and ``listed`` (booleans) to ``rows``: is its ``column`` in ``listed``?

    The blocked filter answers first, with one block per key; its hits go to an exact hash
    join with the list, which removes the false positives. Blocks and list are broadcast
    up to ``BROADCAST_BLOCKS`` rows and joined by shuffle beyond. NULL keys are never
    listed; repeated list entries count once; an empty list lists nothing."""
    lst = materialise(listed.select(F.col(column).alias("_listed")).where(F.col(column).isNotNull()).distinct())
    n = lst.count()
    n_blocks = max(1, -(-n // KEYS_PER_BLOCK))
    blocks = build_blocked_bloom(lst, "_listed", n_blocks)
    hint = F.broadcast if n <= BROADCAST_BLOCKS else (lambda d: d)
    key = F.xxhash64(F.lit(1), F.col(column))
    probed = rows.withColumn("_block", F.when(F.col(column).isNotNull(),
                                              F.pmod(F.xxhash64(F.col(column)), F.lit(n_blocks))))
    probed = probed.join(hint(blocks), F.col("_block") == F.col("bloom_block"), "left")
    hit = F.col("w0").isNotNull()
    for i, m in enumerate(_masks(key)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = probed.withColumn("bloom_hit", F.coalesce(hit, F.lit(False))).drop(
        "_block", "bloom_block", *[f"w{i}" for i in range(WORDS)])
    # keys that missed the filter carry NULL into the join and match nothing
    maybe = F.when(F.col("bloom_hit"), F.col(column))
    exact = lst.withColumn("_in", F.lit(True))
    return (probed.join(hint(exact), maybe == F.col("_listed"), "left")
            .withColumn("listed", F.coalesce(F.col("_in"), F.lit(False))).drop("_in", "_listed"))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Judge every row of ``pages``: page_id, url, host, path, canonical, bloom_hit, listed, rule, verdict.

    ``listed`` has a column ``canonical``. A fitting rule decides; else a listed canonical
    URL is blocked and any other allowed. NULL urls and urls without ``://`` have empty
    host and path and are allowed. Rows, repeats included, are neither lost nor added, and
    other columns are not read."""
    rows = (pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
            .withColumn("canonical", F.when(F.col("host") != "", canonical_url(F.col("url")))))
    rows = listed_by_bloom(rows, listed, "canonical")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return (rows.withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs that two or more rows share (crawl duplicates)."""
    c = pages.select(canonical_url(F.col("url")).alias("canonical"), host_of(F.col("url")).alias("_h")).where("_h <> ''")
    return c.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("canonical")
