"""Ranks and running sums whose plan does not grow with the number of ranges."""

import numpy as np
from pyspark.sql import functions as F

from autotab.operators import ranking as R


def test_offsets_of_many_partitions(spark):
    rng = np.random.default_rng(2)
    pid = np.sort(rng.permutation(6000)[:5000])      # some partitions are empty
    n = rng.integers(1, 50, len(pid))
    df = spark.createDataFrame([(int(p), int(x)) for p, x in zip(pid, n)], "_rk_pid long, n long")
    got = {r._rk_pid: r.n for r in R.partition_offsets(df, ["n"]).collect()}
    want = dict(zip(pid.tolist(), (np.cumsum(n) - n).tolist()))
    assert got == want


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_plan_does_not_grow_with_the_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"), F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    sizes = set()
    for parts in (2, 300):
        ranked = R.global_rank(df, ["x"], ["row_id"], ["g"], num_partitions=parts)
        summed = R.global_cumsum(df.withColumn("w", F.lit(2.0)), ["x"], ["w"], ["g"], ["row_id"], num_partitions=parts)
        sizes.add((plan_size(ranked), plan_size(summed)))
        rows = sorted((r.g, r.x, r.rank) for r in ranked.collect())
        for g in range(3):
            assert [r[2] for r in rows if r[0] == g] == list(range(1, 1001))
        assert sorted((r.g, r.w_cum) for r in summed.collect()) == [(g, 2.0 * i) for g in range(3) for i in range(1, 1001)]
    assert len(sizes) == 1


def test_rows_of_one_group_stay_in_many_partitions(spark):
    """Group starts are joined per partition: a large group is not gathered in one task."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4000).selectExpr("id", "'g' AS g", "1.0D AS w")
        ranked = R.global_rank(df, ["id"], [], ["g"], "r", num_partitions=8)
        summed = R.global_cumsum(df, ["id"], ["w"], ["g"], num_partitions=8)
        for out in (ranked, summed):
            assert out.groupBy(F.spark_partition_id()).count().count() > 2
        assert [r.r for r in ranked.orderBy("id").collect()] == list(range(1, 4001))
        assert [r.w_cum for r in summed.orderBy("id").collect()] == [float(i) for i in range(1, 4001)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
