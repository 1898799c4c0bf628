"""Patient-grouped splits (L1-L4, E10) from a deterministic md5 hash.

Every row of a patient carries the same hash, so whole patients move together and
no patient appears in two splits. A split is a column, not a collect: it is decided
per row from the subject id alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO32 = float(2 ** 32)


def unit_hash(seed: int, key) -> Column:
    """Uniform value in [0, 1) from md5('<seed>:<key>') (first 32 bits)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def grouped_split(df: DataFrame, group: str = "subject_id", test_size: float = 0.2,
                  val_size: float = 0.2, seed: int = 42, val_seed: int = 7) -> DataFrame:
    """L1: test = groups with u < test_size; of the rest, val = groups with u' < val_size
    (second hash with ``val_seed``); others train. Adds ``split``."""
    u1, u2 = unit_hash(seed, group), unit_hash(val_seed, group)
    split = F.when(u1 < F.lit(test_size), "test").when(u2 < F.lit(val_size), "val").otherwise("train")
    return df.withColumn("split", split)


def group_kfold(df: DataFrame, group: str = "subject_id", k: int = 5, seed: int = 42) -> DataFrame:
    """L3: fold = floor(u * k) of the group's hash (usable as a ``foldCol``)."""
    return df.withColumn("fold", F.floor(unit_hash(seed, group) * F.lit(k)).cast("int"))


def learning_curve_subsets(df: DataFrame, group: str = "subject_id", steps: int = 6,
                           lo: float = 0.1, hi: float = 1.0, seed: int = 42) -> DataFrame:
    """L4: nested training subsets at fractions linspace(lo, hi, steps); a group is in
    subset j when its hash is below fraction j, so subsets grow monotonically."""
    fr = [lo + (hi - lo) * j / (steps - 1) for j in range(steps)] if steps > 1 else [hi]
    u = unit_hash(seed, group)
    arr = F.array(*[F.struct(F.lit(j).alias("subset"), F.lit(f).alias("fraction")) for j, f in enumerate(fr)])
    out = df.withColumn("_u", u).select("*", F.inline(arr))
    return out.filter((F.col("_u") < F.col("fraction")) | (F.col("fraction") >= F.lit(1.0))).drop("_u")


def fold_entry(df: DataFrame, fractions, group: str = "subject_id", k: int = 5, seed: int = 42, size_seed: int = 11) -> DataFrame:
    """L4 in L3: ``fold`` and ``entry``, an array that says for each of the ``k`` folds from which
    training size on a row belongs to the fold's training part (NULL: its validation part).

    Size j of a fold holds the first ceil(fraction_j * n) of the n groups outside the fold, in
    the order of a hash; sizes are nested, and a group moves as one. The ranks are taken over
    the distinct groups, in hash cells rather than one task per fold."""
    fr = [float(f) for f in fractions]
    who = df.select(group).distinct()
    who = group_kfold(who, group, k, seed).withColumn("_u", unit_hash(size_seed, group))
    other = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    ranked = rank_in_strata(who.withColumn("_of", F.explode(other)), "_of", "_u", group)
    first = F.least(*[F.when(F.col("_rank") <= F.ceil(F.lit(f) * F.col("_n_stratum")), j).otherwise(len(fr)) for j, f in enumerate(fr)], F.lit(len(fr)))
    pairs = F.map_from_entries(F.collect_list(F.struct("_of", first.alias("_j"))))
    entry = ranked.groupBy(F.col(group).alias("_who"), "fold").agg(pairs.alias("_m"))
    entry = entry.select("_who", "fold", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.col("_m")[f]).alias("entry"))
    return df.join(entry, F.col(group).eqNullSafe(F.col("_who"))).drop("_who")


def modal_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent ``value`` per ``key`` (ties: smallest value). Counts are a
    partial aggregation; the pick is ``min_by`` over the per-(key, value) counts."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value)))
    return counts.groupBy(key).agg(pick.alias(out))


def rank_in_strata(df: DataFrame, stratum: str, u: str, tie: str, buckets: int = 1024) -> DataFrame:
    """Exact 1-based rank of rows by ``u`` inside each stratum, without one task per
    stratum: rows are bucketed by ``u``; bucket offsets come from a cumulative sum
    over the small (stratum, bucket) count table, and the final ordering runs within
    (stratum, bucket) cells only."""
    b = F.least(F.floor(F.col(u) * F.lit(buckets)), F.lit(buckets - 1)).cast("int")
    df = df.withColumn("_b", b)
    cells = df.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_off", F.coalesce(F.sum("_c").over(wc), F.lit(0)))
    cells = cells.withColumn("_n_stratum", F.sum("_c").over(Window.partitionBy(stratum)))
    df = df.join(cells.drop("_c"), [stratum, "_b"], "inner")
    wr = Window.partitionBy(stratum, "_b").orderBy(u, tie)
    return df.withColumn("_rank", F.col("_off") + F.row_number().over(wr)).drop("_b", "_off")


def stratified_group_split(df: DataFrame, group: str = "subject_id", stratum: str = "race",
                           test_size: float = 0.15, val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """L2: each group gets its modal ``stratum`` value; inside every stratum the groups
    are ordered by hash and the first floor(test_size*n) go to test, the next
    floor(val_size/(1-test_size) * rest) to val, the others to train. Strata with a
    single group go to train. Adds ``split`` to every row of ``df``."""
    modal = modal_value(df, group, stratum, "_stratum").fillna({"_stratum": "UNKNOWN"})
    modal = modal.withColumn("_u", unit_hash(seed, group))
    ranked = rank_in_strata(modal, "_stratum", "_u", group)
    n = F.col("_n_stratum")
    n_test = F.floor(n * F.lit(test_size))
    n_val = F.floor((n - n_test) * F.lit(val_size / (1.0 - test_size)))
    split = (F.when(n < 2, "train").when(F.col("_rank") <= n_test, "test")
             .when(F.col("_rank") <= n_test + n_val, "val").otherwise("train"))
    assign = ranked.select(group, F.col("_stratum").alias(f"{stratum}_subj"), split.alias("split"))
    return df.join(assign, group, "left")
