"""Quality rules: counts of a text, and cross-document line frequency per host."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialise
from .common import LOWER, SPACES, UPPER, let, n_words, words_of

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\f\r"
WINDOW = 5
# Line limits: a line is boilerplate of its host when it stands in at least MIN_DOCS of the
# host's documents and in more than MAX_SHARE_PCT percent of them.
MIN_DOCS = 10
MAX_SHARE_PCT = 1
# A document is depleted when fewer than MIN_WORDS_LEFT words or less than MIN_LEFT_PCT
# percent of its words are left.
MIN_WORDS_LEFT = 10
MIN_LEFT_PCT = 30
# Boilerplate lines are 8-byte hashes: up to this many (16 MB) are broadcast.
BROADCAST_LINES = 1 << 20


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Texts without a repeated window stop after a
    distinct count; else windows are sorted by (hash, position), neighbours of equal hash
    are kept, and the union of their spans is measured."""
    zero = F.lit(0).cast("long")
    last = F.size(words) - WINDOW

    def spans(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("p"))))

        def covered(s: Column) -> Column:
            top = F.size(s) - 1
            same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                            | ((i < top) & (F.get(s, i + 1)["h"] == x["h"])))
            return let(F.sort_array(F.transform(same, lambda x: x["p"])), lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                zero, lambda a, v: a + v))
        return let(ranked, covered)

    hashes = F.transform(F.sequence(F.lit(0), last),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(last < 1, zero).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(spans(h))))


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, digits as 0, runs of white space as one space, ends trimmed."""
    same = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.trim(F.regexp_replace(same, SPACES, " "))


def line_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share_pct: float = MAX_SHARE_PCT,
               min_words_left: int = MIN_WORDS_LEFT, min_left_pct: float = MIN_LEFT_PCT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, host): base counts, words_left, lines_removed, base_failed, kept.

    A line's key is a hash of its host and normalised words; NULL is a host of its own.
    Each row counts as one document, so a repeated row counts again. NULL and empty texts
    have no words and fail the base rules. Other columns of ``docs`` are not read."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(host).alias("host"))
    key = lambda line: F.xxhash64(F.col("host").isNull(), F.coalesce(F.col("host"), F.lit("")), normal_line(line))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)

    keys = d.select("host", F.explode(F.array_distinct(F.transform(lines, key))).alias("line"))
    n_docs = d.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = keys.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    frequent = materialise(frequent.alias("f").join(n_docs.alias("h"), F.col("f.host").eqNullSafe(F.col("h.host")))
                           .where(F.col("n") * 100 > F.col("host_docs") * max_share_pct)
                           .select(F.col("line").alias("common_line")))
    few = frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES

    rid = d.withColumn("rid", F.monotonically_increasing_id())
    base = rid.withColumn("words", words_of(F.col("text"))).select(
        "rid", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(key(x).alias("line"), n_words(x).alias("w"))).alias("lines"))
    carried = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    each = base.select("rid", *carried, F.explode_outer("lines").alias("l")).select(
        "rid", *carried, F.col("l.line").alias("line"), F.coalesce("l.w", F.lit(0)).alias("w"))
    each = each.join(F.broadcast(frequent) if few else frequent, F.col("line") == F.col("common_line"), "left")
    gone = F.col("common_line").isNotNull()
    out = each.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in carried],
        F.sum(F.when(gone, 0).otherwise(F.col("w"))).alias("words_left"),
        F.sum(gone.cast("long")).alias("lines_removed"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("words_left") < min_words_left) | (F.col("words_left") * 100 < F.col("n_words") * min_left_pct)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("rid")
