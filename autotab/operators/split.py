"""Repeatable splits, folds and samples keyed on row ids.

Randomness is ``md5(concat_ws(':', seed, *ids))``: independent of partitioning
and task order, and computable by any SQL engine. Exact split sizes come from
the distributed rank in :mod:`autotab.operators.ranking`, never from a
single-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autotab.operators.ranking import global_rank


def hash_key(ids: list[str], seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


MAX_BUCKET_BITS = 20
ROWS_PER_BUCKET = 2000


def _with_rank(df: DataFrame, ids: list[str], seed: int, group: list[str] | None = None,
               rank_col: str = "_rank") -> DataFrame:
    """Exact rank in (md5 hash, ids) order, restarting per group.

    The md5 order is uniform, so its leading bits are a ready-made range
    partitioning: rows fall in 2^b buckets of about ROWS_PER_BUCKET rows
    (b <= 20). Counts per (group, bucket) -- a small table -- give each
    bucket's offset; the rank inside a bucket is a window over that bucket
    only. Deterministic, no sampling pass, no single large task, and a
    class holding a third of all rows is still split over many buckets.
    """
    group = list(group or [])
    n = df.count()
    bits = int(min(MAX_BUCKET_BITS, max(0, math.floor(math.log2(max(1, n / ROWS_PER_BUCKET))))))
    keyed = df.withColumn("_h", hash_key(ids, seed)).withColumn(
        "_b", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), 32 - bits)
        if bits else F.lit(0).cast("long"))
    # one row per (group, bucket); Spark broadcasts it when it is small enough
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*group).orderBy("_b") if group else Window.orderBy("_b")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inner = Window.partitionBy(*group, "_b").orderBy("_h", *ids)
    return (keyed.join(offsets, group + ["_b"])
            .withColumn(rank_col, F.col("_off") + F.row_number().over(inner))
            .drop("_h", "_b", "_off"))


def _keyed(df: DataFrame, ids: list[str], seed: int, n: int) -> DataFrame:
    """``df`` with its order key: ``_at`` (md5, then the ids) and its hash bucket ``_b``."""
    bits = int(min(MAX_BUCKET_BITS, max(0, math.floor(math.log2(max(1, n / ROWS_PER_BUCKET))))))
    h = hash_key(ids, seed)
    bucket = (F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32 - bits) if bits
              else F.lit(0).cast("long"))
    return df.withColumns({"_at": F.struct(h.alias("h"), *[F.col(c) for c in ids]), "_b": bucket})


def _thresholds(keyed: DataFrame, group: list[str], quotas: DataFrame) -> DataFrame:
    """(group, _last): the order key of the ``_quota``-th row of every group.

    Counts per (group, bucket) find the bucket that holds that row; only the rows of
    those buckets (about ROWS_PER_BUCKET per group) are ranked.
    """
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_b"))
    held = (counts.withColumn("_end", upto).join(quotas.select(*group, "_quota"), group)
            .filter((F.col("_quota") <= F.col("_end")) & (F.col("_quota") > F.col("_end") - F.col("_c")))
            .select(*group, "_b", (F.col("_quota") - F.col("_end") + F.col("_c")).alias("_k")))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_at"))
    return (keyed.select(*group, "_b", "_at").join(F.broadcast(held), group + ["_b"]).withColumn("_r", rank)
            .filter("_r = _k").select(*group, F.col("_at").alias("_last")))


def split_random(df: DataFrame, ids: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` = 'test' for the first ceil(n * test) rows in hash order: a filter on the
    order key against one threshold, so the rows themselves are not shuffled."""
    n = df.count()
    keyed = _keyed(df, ids, seed, n).withColumn("_g", F.lit(0))
    quota = df.sparkSession.createDataFrame([(0, math.ceil(n * test))], "_g int, _quota long")
    last = _thresholds(keyed, ["_g"], quota)    # one row
    return (keyed.join(F.broadcast(last), "_g", "left")
            .withColumn("split", F.when(F.col("_at") <= F.col("_last"), "test").otherwise("train"))
            .drop("_at", "_b", "_g", "_last"))


def stratified_quotas(df: DataFrame, label: str, test: float) -> DataFrame:
    """Test rows per class: floor(n_c * t) plus one for the classes with the
    largest remainders (ties -> smaller label) until ceil(n * t) is reached.
    One row per class; the window below runs over that small table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w_all = Window.partitionBy(F.lit(1))
    q = (counts.withColumn("_tot", F.sum("_n").over(w_all))
         .withColumn("_base", F.floor(F.col("_n") * test).cast("long"))
         .withColumn("_rem", F.col("_n") * test - F.floor(F.col("_n") * test))
         .withColumn("_need", F.ceil(F.col("_tot") * test).cast("long") - F.sum("_base").over(w_all))
         .withColumn("_order", F.row_number().over(Window.orderBy(F.col("_rem").desc(), label)))
         .withColumn("_quota", F.col("_base") + F.when(F.col("_order") <= F.col("_need"), 1)
                     .otherwise(0)))
    return q.select(label, "_n", "_quota")


def split_stratified(df: DataFrame, label: str, ids: list[str], test: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Hash-order split inside every class, ``stratified_quotas`` test rows each: a filter
    against one threshold per class. The thresholds are broadcast (one row per class), so the rows
    stay where they are; joined by class, each class would fill one task."""
    quotas = stratified_quotas(df, label, test)
    keyed = _keyed(df, ids, seed, df.count())
    last = _thresholds(keyed, [label], quotas)
    return (keyed.join(F.broadcast(last), label, "left")
            .withColumn("split", F.when(F.col("_at") <= F.col("_last"), "test").otherwise("train"))
            .drop("_at", "_b", "_last"))


def kfold(df: DataFrame, ids: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (rank - 1) mod k over the hash order."""
    ranked = _with_rank(df, ids, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def kfold_stratified(df: DataFrame, label: str, ids: list[str], k: int = 5,
                     seed: int = 42) -> DataFrame:
    ranked = _with_rank(df, ids, seed, group=[label])
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def cv_plain(df: DataFrame, ids: list[str], k: int | None = None,
             label: str | None = None, few_rows: int = 30) -> DataFrame:
    """Unshuffled contiguous folds over the id order (per class when
    ``label`` is given): fold = floor((rank - 1) * k / n), like ``ntile``.
    k defaults to 3, or 2 below ``few_rows`` rows."""
    group = [label] if label else None
    n_all = df.count()
    k = k or (2 if n_all < few_rows else 3)
    ranked = global_rank(df, [], ids, group_cols=group, rank_col="_rank")
    if label:
        sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
        ranked = ranked.join(F.broadcast(sizes), label)     # one row per class
    else:
        ranked = ranked.withColumn("_n", F.lit(n_all))
    return (ranked.withColumn("fold", F.floor((F.col("_rank") - 1) * k / F.col("_n")).cast("int"))
            .drop("_rank", "_n"))


def sample_n(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest hashes.

    A hash bound that keeps about 2n rows (exactly: more than n, or all rows)
    filters first, so the final top-n merges about 2n rows however many
    partitions there are.
    """
    total = df.count()
    if total > 4 * n:
        share = F.conv(F.substring(hash_key(ids, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
        few = df.filter(share < 2.0 * n / total + 20.0 * math.sqrt(n) / total)
        df = few if few.count() >= n else df
    return (df.withColumn("_h", hash_key(ids, seed)).orderBy("_h", *ids).limit(n).drop("_h"))


def head_n(df: DataFrame, ids: list[str], n: int = 2000) -> DataFrame:
    """First n rows in id order."""
    return df.orderBy(*ids).limit(n)


def rows_of_split(raw: DataFrame, split_df: DataFrame, ids: list[str],
                  which: str = "test") -> DataFrame:
    """Raw rows of one split: left-semi join on the ids."""
    return raw.join(split_df.filter(F.col("split") == which).select(*ids), ids, "left_semi")
