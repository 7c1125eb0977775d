import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from autotab.llm import shards


def test_hypergeometric_follows_its_distribution(spark):
    from math import comb
    n = 20000
    df = spark.range(n).select(shards.hypergeometric(
        F.lit(50), F.lit(20), F.lit(10), shards.uniform01(F.lit(1), F.col("id"))).alias("x"))
    got = {r.x: r["count"] for r in df.groupBy("x").count().collect()}
    for k in range(11):
        p = comb(20, k) * comb(30, 10 - k) / comb(50, 10)
        assert abs(got.get(k, 0) - n * p) < 5 * (n * p) ** 0.5 + 5


def test_matrix_sums(spark):
    counts = spark.range(1024).select(F.col("id").alias("block"), (F.col("id") % 7).alias("n"))
    total = sum(i % 7 for i in range(1024))
    sizes = [total // 5 + (j < total % 5) for j in range(5)]
    rows = shards.communication_matrix(counts, 2, sizes, 1).collect()
    assert len(rows) == 1024 and all(sum(r["columns"]) == r.block % 7 for r in rows)
    assert [sum(r["columns"][j] for r in rows) for j in range(5)] == sizes


def check(rows, source, k):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in source)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots.get(j, [])) for j in range(k)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_exact_sizes_gapless_slots_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shards.shard_rows(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 24)
    again = shards.shard_rows(docs.repartition(5, "lang")).collect()
    assert sorted(rows) == sorted(again)


def test_null_empty_repeated_and_no_rows(frame):
    src = [(1, None), (2, ""), (2, ""), (None, "é"), (5, "x" * 100_000)] + [(7, "same")] * 40
    check(shards.shard_rows(frame(src), shards=4).collect(), src, 4)
    assert shards.shard_rows(frame([])).count() == 0
