"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

# The base patterns of the contract, in its order. The hex and access runs
# are greedy over one character class, so their least length can stand in the pattern;
# an assignment that fails on length still uses up its characters and is dropped after.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = r"[A-Za-z0-9+/_-]{12,}"
LEAST = 12         # characters of a stretch
ORDINARY = r"[A-Za-z0-9+/_-]{6,}"
ALPHABET = 128     # the models' characters are ASCII codes
SMOOTH = 0.5
SEEN = 65          # characters of the candidate class
MIN_RATIO = 12.0   # nats of evidence for a random string
# Bounds of the labelled sample that the two models are fitted on.
RANDOM_SAMPLE = 20_000
ORDINARY_DOCS = 2_000


def labelled_samples(docs: DataFrame, n_random: int = RANDOM_SAMPLE, n_docs: int = ORDINARY_DOCS) -> DataFrame:
    """(random boolean, token): base matches of all documents, the first ``n_random`` by hash,
    against the identifiers of the ``n_docs`` documents first by id hash."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
                     F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    found = F.when(t.rlike(f"{ASSIGN}|{ACCESS}|{HEX}"), found)
    random = (docs.select(F.explode(found).alias("token")).where(F.length("token") >= ASSIGN_LEN)
              .groupBy("token").agg(F.lit(True).alias("random"))
              .orderBy(F.xxhash64("token"), "token").limit(n_random).select("random", "token"))
    ids = (docs.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
           .orderBy(F.xxhash64("_id"), "_id").limit(n_docs))
    chosen = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = chosen.select(F.lit(False).alias("random"),
                             F.explode(F.regexp_extract_all(clean, F.lit(ORDINARY), F.lit(0))).alias("token"))
    return random.unionByName(ordinary)


def markov_ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of every character pair, index a * 128 + b.

    Counts come from ``samples`` by one grouped count, at most 2 * 128 * 128 rows. Without
    random or ordinary samples every ratio is 0, and nothing is found."""
    chars = F.split("token", "")
    pairs = samples.where((F.length("token") > 1) & F.col("token").rlike(r"^\p{ASCII}*$")).select("random", F.explode(let(
        F.filter(chars, lambda x: x != ""), lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.ascii(F.get(c, i)) * ALPHABET + F.ascii(F.get(c, i + 1))))).alias("pair"))
    rows = pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {True: [0] * ALPHABET ** 2, False: [0] * ALPHABET ** 2}
    for r in rows:
        n[r["random"]][r["pair"]] = r["n"]
    if not sum(n[True]) or not sum(n[False]):
        return [0.0] * ALPHABET ** 2
    out = []
    for a in range(ALPHABET):
        row = {k: v[a * ALPHABET:(a + 1) * ALPHABET] for k, v in n.items()}
        whole = {k: sum(v) + SMOOTH * SEEN for k, v in row.items()}
        out += [math.log((row[True][b] + SMOOTH) / whole[True]) - math.log((row[False][b] + SMOOTH) / whole[False])
                for b in range(ALPHABET)]
    return out


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios of a token's character pairs (ASCII tokens)."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda x: F.ascii(x))
    return let(codes, lambda c: F.aggregate(
        F.sequence(F.lit(0), F.length(token) - 2), F.lit(0.0),
        lambda acc, i: acc + F.get(table, F.get(c, i) * ALPHABET + F.get(c, i + 1))))


def random_stretches(token: Column, ratios: list[float], min_ratio: float) -> Column:
    """Array of (lead, size): stretches of an ASCII token of ``LEAST`` characters or more.

    The stretch with the largest sum of pair ratios is taken where that reaches ``min_ratio``.
    It is closed, and the search starts anew, once the characters after it speak as much for
    ordinary text; so text glued before, behind or between secrets does not outweigh them."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda x: F.ascii(x))
    span = lambda s: F.struct(s["at"].cast("long").alias("lead"), (s["end"] - s["at"]).cast("long").alias("size"))
    none = F.array().cast("array<struct<lead:bigint,size:bigint>>")

    def found(s):
        return F.when(s["best"] >= min_ratio, F.concat(s["out"], F.array(span(s)))).otherwise(s["out"])

    def state(upto, lag, low, low_at, since, best, at, end, top, out):
        return F.struct(upto.alias("upto"), lag.alias("lag"), low.alias("low"), low_at.alias("low_at"), since.alias("since"),
                        best.alias("best"), at.alias("at"), end.alias("end"), top.alias("top"), out.alias("out"))

    def step(c):
        ratio = lambda i: F.get(table, F.get(c, i) * ALPHABET + F.get(c, i + 1))
        far, least = F.lit(float("inf")), F.lit(float("-inf"))

        def one(s, i):
            # ``lag`` is the sum before the latest start that leaves LEAST characters.
            upto, start = s["upto"] + ratio(i), i - (LEAST - 2)
            lag = s["lag"] + F.when(start > 0, ratio(start - 1)).otherwise(0.0)
            lower = (start >= s["since"]) & (lag < s["low"])
            low, low_at = F.when(lower, lag).otherwise(s["low"]), F.when(lower, start).otherwise(s["low_at"])

            def placed(x):
                more = x["upto"] - x["low"] > s["best"]
                pick = lambda a, b: F.when(more, a).otherwise(b)
                return state(x["upto"], x["lag"], x["low"], x["low_at"], s["since"], pick(x["upto"] - x["low"], s["best"]),
                             pick(x["low_at"], s["at"]), pick(i + 2, s["end"]), pick(x["upto"], s["top"]), s["out"])

            def closed(x):
                over = (x["best"] >= min_ratio) & (x["top"] - x["upto"] >= min_ratio)
                pick = lambda a, b: F.when(over, a).otherwise(b)
                return state(x["upto"], x["lag"], pick(far, x["low"]), x["low_at"], pick(i + 1, x["since"]),
                             pick(least, x["best"]), x["at"], x["end"], x["top"], pick(found(x), x["out"]))

            now = F.struct(upto.alias("upto"), lag.alias("lag"), low.alias("low"), low_at.alias("low_at"))
            return let(let(now, placed), closed)

        zero, none_yet = F.lit(0.0), F.lit(0)
        return F.aggregate(F.sequence(F.lit(0), F.length(token) - 2),
                           state(zero, zero, far, none_yet, none_yet, least, none_yet, none_yet, zero, none), one, found)

    return let(codes, step)


def _matches(text: Column, kind: int, pattern: str, parts) -> Column:
    """Array of (kind, pos, gap, len, parts): a match, the characters between it and the one
    before, and the (lead, size) of the spans in it.

    ``split`` and ``regexp_extract_all`` walk the same leftmost matches, so piece i is the gap
    before match i, and positions follow by a running sum."""
    empty = F.array().cast("array<struct<kind:int,pos:int,gap:bigint,len:bigint,parts:array<struct<lead:bigint,size:bigint>>>>")
    found = let(F.split(text, pattern, -1), lambda gaps: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.length(m).cast("long").alias("len"), parts(m).alias("parts"))))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def secret_spans(docs: DataFrame, ratios: list[float], min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): spans, an array of (start, kind, end) sorted by start, then kind.

    Offsets count code points, ends are exclusive, ``kind`` indexes KINDS. Kinds are matched
    separately and may overlap. NULL text counts as empty; a row without a match has an
    empty array; repeated rows are kept apart. Matches of a text are exploded and summed
    in one window per text, so a text with many matches stays linear."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    whole = lambda m: F.array(F.struct(F.lit(0).cast("long").alias("lead"), F.length(m).cast("long").alias("size")))
    second = lambda m: F.filter(whole(m), lambda _: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEN)
    found = F.concat(_matches(t, 0, ASSIGN, second), _matches(t, 1, ACCESS, whole), _matches(t, 2, HEX, whole),
                     _matches(t, 3, CANDIDATE, lambda m: random_stretches(m, ratios, min_ratio)))
    each = d.select("rid", "doc_id", F.explode_outer(found).alias("m")).select(
        "rid", "doc_id", "m.*").repartition("rid")
    upto = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("rid", "kind").orderBy("pos"))
    placed = each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("len"))
    spans = F.transform("parts", lambda p: F.struct(
        (F.col("start") + p["lead"]).alias("start"), F.col("kind").alias("kind"), (F.col("start") + p["lead"] + p["size"]).alias("end")))
    return placed.groupBy("rid").agg(F.first("doc_id").alias("doc_id"),
                                     F.sort_array(F.flatten(F.collect_list(spans))).alias("spans")).drop("rid")


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Spans of every row, by models fitted on ``samples`` (by default those of ``docs``)."""
    return secret_spans(docs, markov_ratios(labelled_samples(docs) if samples is None else samples))
