"""Exact global ranks without pulling rows into one task.

A window with ``orderBy`` and no partition key moves every row to one task.
Here the rows are range-partitioned on the ordering (plus a unique tiebreak,
so even a value held by a third of all rows is spread over many tasks),
sorted inside each partition and written once to the reliable checkpoint
directory. Per-partition counts then give each partition's offset by prefix sums in two
levels (:func:`partition_offsets`), a table joined by partition number, so the plan is the same for
any number of partitions and ``rank = offset + position``.

With ``group_cols`` the rank restarts per group: groups are the leading sort
keys, and the group's start offset (one row per group) is subtracted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autotab.session import cut_lineage

_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits

ROWS_PER_RANGE = 500_000
SPAN = 1024      # partitions whose sums are added up together


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions: as many as the session shuffles into, more when the rows ask for it."""
    if num_partitions:
        return int(num_partitions)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
               math.ceil(df.count() / ROWS_PER_RANGE))


def global_rank(df: DataFrame, order: list[str | Column], tiebreak: list[str],
                group_cols: list[str] | None = None, rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based ``rank_col`` by ``order`` (ascending, then ``tiebreak``).

    ``tiebreak`` must make the order total (a row key), so the ranks are
    repeatable whatever the input partitioning.
    """
    group_cols = list(group_cols or [])
    keys = [F.col(c) if isinstance(c, str) else c for c in group_cols + list(order) + list(tiebreak)]
    n_parts = _partitions(df, num_partitions)
    pid = F.spark_partition_id().cast("long")
    ranged = (df.repartitionByRange(n_parts, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_rk_pid", pid)
              .withColumn("_rk_pos", F.monotonically_increasing_id() - F.shiftleft(pid, _POS_BITS)))
    ranged = cut_lineage(ranged)

    offsets = partition_offsets(ranged.groupBy("_rk_pid").agg(F.count(F.lit(1)).alias("_rk_off")), ["_rk_off"])
    ranked = ranged.join(offsets, "_rk_pid").withColumn(rank_col, F.col("_rk_off") + F.col("_rk_pos") + 1).drop("_rk_off")

    if group_cols:
        # Groups lead the sort, so each group is one contiguous run of global
        # ranks: its start is its smallest rank minus one.
        starts = group_starts(ranked, group_cols, {"_rk_start": F.col(rank_col) - 1})
        ranked = (ranked.join(starts, group_cols + ["_rk_pid"], "inner")
                  .withColumn(rank_col, F.col(rank_col) - F.col("_rk_start"))
                  .drop("_rk_start"))
    return ranked.drop("_rk_pid", "_rk_pos")


def group_starts(ranged: DataFrame, group_cols: list[str], cols: dict[str, Column]) -> DataFrame:
    """(group, _rk_pid, cols): the smallest value of each of ``cols`` in a group, once for every partition that
    holds rows of it. Joined by group alone, all rows of a group would meet in one task."""
    spots = ranged.groupBy(*group_cols, "_rk_pid").agg(*[F.min(c).alias(n) for n, c in cols.items()])
    whole = Window.partitionBy(*group_cols)      # one row per range partition at most
    return spots.select(*group_cols, "_rk_pid", *[F.min(n).over(whole).alias(n) for n in cols])


def partition_offsets(totals: DataFrame, cols: list[str]) -> DataFrame:
    """(_rk_pid, cols): sums of ``cols`` over all partitions before each one, from one row per partition.

    Partitions are added up in spans of ``SPAN``, and the spans' sums above them, so no window holds more
    than ``SPAN`` rows or one row per span.
    """
    spanned = totals.withColumn("_span", F.expr(f"_rk_pid div {SPAN}"))
    inside = Window.partitionBy("_span").orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spanned.groupBy("_span").agg(*[F.sum(c).alias(f"_all_{c}") for c in cols]).select(
        "_span", *[F.coalesce(F.sum(f"_all_{c}").over(above), F.lit(0)).alias(f"_all_{c}") for c in cols])
    local = spanned.select("_rk_pid", "_span", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in cols])
    return local.join(spans, "_span").select("_rk_pid", *[(F.col(c) + F.col(f"_all_{c}")).alias(c) for c in cols])


BUCKETS = 2048


def column_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict:
    """Exact linear-interpolated quantiles of several columns of one table:
    {column: {q: value}}. See :func:`column_quantiles_with`."""
    return column_quantiles_with(df, cols, qs)[0]


def column_quantiles_with(df: DataFrame, cols: list[str], qs: list[float],
                          extra: list[Column] | None = None):
    """Quantiles as in :func:`column_quantiles`, plus ``extra`` aggregates
    evaluated in the same first scan; returns (quantiles, extra row).

    Selection by counting: the first scan gives count, min and max per column.
    Each further scan cuts the range that holds a wanted order statistic into
    ``BUCKETS`` buckets and keeps only counts, minima and maxima per bucket
    (map-side combined, so a value held by a third of all rows is one
    count). The bucket that holds the statistic becomes the next range; a
    statistic at a bucket's edge, or in a bucket of one value, is found. Only
    the found buckets (one row per column and quantile) reach the driver.
    """
    if not cols:
        return {}, (df.agg(*extra).first() if extra else None)
    val = {c: F.col(f"`{c}`").cast("double") for c in cols}
    ok = {c: F.when(val[c].isNotNull() & ~F.isnan(val[c]), val[c]) for c in cols}
    extra = list(extra or [])
    wide = df.agg(*[F.struct(F.count(ok[c]).alias("n"), F.min(ok[c]).alias("lo"), F.max(ok[c]).alias("hi"))
                    .alias(f"c{i}") for i, c in enumerate(cols)], *extra).first()
    found: dict = {}        # (column, rank) -> value
    pending: dict = {}      # (column, rank) -> (low, high, rows below low)
    wanted = {}
    for i, c in enumerate(cols):
        n, lo, hi = wide[f"c{i}"]
        for q in qs if n else ():
            pos = q * (n - 1)
            wanted[c, q] = (pos, math.floor(pos) + 1, math.ceil(pos) + 1)
            for k in wanted[c, q][1:]:
                _settle(found, pending, (c, k), lo, hi, 0, n)
    while pending:
        pending = _narrow(df, ok, pending, found)
    out: dict = {c: {} for c in cols}
    for (c, q), (pos, lo_k, hi_k) in wanted.items():
        a, b = found[c, lo_k], found[c, hi_k]
        out[c][q] = a + (pos - (lo_k - 1)) * (b - a)
    return out, (wide if extra else None)


def _settle(found: dict, pending: dict, key: tuple, lo: float, hi: float, below: int, n: int) -> None:
    """Record the order statistic ``key`` = (column, rank), known to lie among ``n`` values in
    [lo, hi] with ``below`` values under them, as found or pending."""
    if lo == hi or key[1] == below + 1:
        found[key] = lo
    elif key[1] == below + n:
        found[key] = hi
    else:
        pending[key] = (lo, hi, below)


def _narrow(df: DataFrame, ok: dict, pending: dict, found: dict) -> dict:
    """One counting scan over the pending ranges."""
    spark = df.sparkSession
    ranges = sorted({(c, *r) for (c, _), r in pending.items()})
    number = {r: i for i, r in enumerate(ranges)}
    names = sorted({r[0] for r in ranges})
    table = spark.createDataFrame([(i, names.index(c), lo, hi, below) for (c, lo, hi, below), i in number.items()],
                                  "range int, col int, lo double, hi double, below long")
    ranks = spark.createDataFrame([(number[(c, *r)], k) for (c, k), r in pending.items()], "range int, rank long")
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), ok[c].alias("x")) for i, c in enumerate(names)])).alias("v")).select("v.*")
    # halves keep the width of the widest double ranges finite
    at = ((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS)
    hist = (values.join(F.broadcast(table), "col")      # one row per column and quantile
            .filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
            .groupBy("range", "below", F.least(F.floor(at), F.lit(BUCKETS - 1)).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("bucket"))    # BUCKETS rows at most
    hits = (hist.withColumn("end", F.col("below") + upto).join(F.broadcast(ranks), "range")
            .filter((F.col("rank") <= F.col("end")) & (F.col("rank") > F.col("end") - F.col("n"))))
    left: dict = {}
    for r in hits.collect():
        _settle(found, left, (ranges[r["range"]][0], r["rank"]), r["mn"], r["mx"], r["end"] - r["n"], r["n"])
    return left


def global_cumsum(df: DataFrame, order: list[str | Column], weights: list[str],
                  group_cols: list[str] | None = None, tiebreak: list[str] | None = None,
                  suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of non-negative ``weights`` in a global order.

    Same plan as :func:`global_rank`: range partitions, a per-partition
    running sum in Arrow batches (``mapInPandas``, no shuffle), one write,
    then per-partition totals (one row per partition) as offsets. With
    ``group_cols`` the sums restart per group.
    """
    import pandas as pd  # noqa: F401  (executor side)
    from pyspark.sql import types as T

    group_cols = list(group_cols or [])
    keys = [F.col(c) if isinstance(c, str) else c
            for c in group_cols + list(order) + list(tiebreak or [])]
    n_parts = _partitions(df, num_partitions)
    ranged = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    out_schema = T.StructType(ranged.schema.fields + [T.StructField("_rk_pid", T.LongType())] + [
        T.StructField(w + suffix, T.DoubleType()) for w in weights])

    def running(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = {w: 0.0 for w in weights}
        for pdf in batches:
            pdf["_rk_pid"] = pid
            for w in weights:
                cs = pdf[w].astype("float64").cumsum() + carry[w]
                pdf[w + suffix] = cs
                if len(cs):
                    carry[w] = float(cs.iloc[-1])
            yield pdf

    local = cut_lineage(ranged.mapInPandas(running, out_schema))
    before = [f"_rk_before_{i}" for i in range(len(weights))]
    offsets = partition_offsets(local.groupBy("_rk_pid").agg(
        *[F.sum(w).cast("double").alias(b) for w, b in zip(weights, before)]), before)
    out = local.join(offsets, "_rk_pid").withColumns(
        {w + suffix: F.col(w + suffix) + F.col(b) for w, b in zip(weights, before)}).drop(*before)
    if group_cols:
        starts = group_starts(out, group_cols, {"_st_" + w: F.col(w + suffix) - F.col(w) for w in weights})
        out = out.join(starts, group_cols + ["_rk_pid"])
        out = out.withColumns({w + suffix: F.col(w + suffix) - F.col("_st_" + w) for w in weights}
                              ).drop(*["_st_" + w for w in weights])
    return out.drop("_rk_pid")
