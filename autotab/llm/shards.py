"""Uniform shuffle into shards of exact size by a hypergeometric matrix.

Rows are dealt to ``P`` blocks by a hash.  For a uniform permutation of all rows
cut into shards, the number of rows that block ``p`` sends to shard ``j`` is
distributed as a contingency table with fixed row sums (block sizes) and column
sums (shard sizes).  That matrix is drawn first, exactly, by splitting a tree
of blocks: a node's column sums are divided among its 32 children by
sequential hypergeometric draws.  Then every block is permuted locally and cut by
its row of the matrix (the exchange), and every shard is permuted again, in
hash blocks whose offsets come from their counts, so no task ever holds a whole
shard.  Everything is DataFrame operations; texts never leave the scan.

A draw inverts the distribution function over the values within 9 standard
deviations + 9 of the mode; what lies beyond has a probability below 1e-17, less than
the spacing of the uniform doubles.

Defined cases: a null text has no bytes (size 8, crc32 0); null ids and repeated rows
are rows like any other (identical rows are interchangeable); an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autotab.llm.common import stored

FANOUT = 32
BLOCK_ROWS = 131_072


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of named values, each computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _steps(first: Column, last: Column) -> Column:
    """first..last ascending; empty when last < first."""
    return F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(
        F.array().cast("array<bigint>"))


def uniform01(*key: Column) -> Column:
    """A double in (0, 1) that depends on ``key`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hypergeometric(pool: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of ``good`` items among ``drawn`` out of ``pool``, at quantile u."""
    def up(w, k, v):    # weight of k + 1 from that of k
        return w * (v.good - k) * (v.drawn - k) / ((k + 1) * (v.pool - v.good - v.drawn + k + 1))

    def down(w, k, v):  # weight of k - 1 from that of k
        return w * k * (v.pool - v.good - v.drawn + k) / ((v.good - k + 1) * (v.drawn - k + 1))

    def total(steps, step, v):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda a, k: _let(
            {"w": step(a.w, k.cast("double"), v), "sum": a["sum"]},
            lambda x: F.struct(x.w.alias("w"), (x["sum"] + x.w).alias("sum"))))

    def draw(v):
        def pick(x):
            start = F.struct(x.left.w.alias("w"), x.left.w.alias("cum"), v.first.alias("k"))
            return F.aggregate(_steps(v.first, v.last - 1), start, lambda a, k: F.when(
                a.cum > x.at, a).otherwise(_let(
                    {"w": up(a.w, k.cast("double"), v), "cum": a.cum, "k": k + 1},
                    lambda y: F.struct(y.w.alias("w"), (y.cum + y.w).alias("cum"), y.k.alias("k")))),
                lambda a: a.k)
        return _let({"left": total(F.reverse(_steps(v.first + 1, v.mode)), down, v),
                     "right": total(_steps(v.mode, v.last - 1), up, v)},
                    lambda s: _let({"left": s.left,
                                    "at": u * (s.left["sum"] + 1.0 + s.right["sum"])}, pick))

    def ranges(v):
        n = F.greatest(v.pool, F.lit(1.0))
        low = F.greatest(F.lit(0.0), v.drawn + v.good - v.pool)
        high = F.least(v.drawn, v.good)
        mode = F.least(high, F.greatest(low, F.floor(
            (v.drawn + 1) * (v.good + 1) / (v.pool + 2)).cast("double")))
        spread = F.sqrt(F.greatest(F.lit(0.0), v.drawn * (v.good / n) * (1 - v.good / n)
                                   * (n - v.drawn) / F.greatest(n - 1, F.lit(1.0))))
        reach = F.ceil(spread * 9).cast("double") + 9
        return _let({"pool": v.pool, "good": v.good, "drawn": v.drawn, "mode": mode.cast("bigint"),
                     "first": F.greatest(low, mode - reach).cast("bigint"),
                     "last": F.least(high, mode + reach).cast("bigint")}, draw)

    return _let({"pool": pool.cast("double"), "good": good.cast("double"),
                 "drawn": drawn.cast("double")}, ranges)


def _row(columns: Column, total: Column, drawn: Column, shards: int, *key: Column) -> Column:
    """A multivariate hypergeometric draw of ``drawn`` rows from ``columns``."""
    start = F.struct(drawn.alias("need"), total.alias("pool"),
                     F.array().cast("array<bigint>").alias("got"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, lambda a, j: _let(
        {"a": a, "good": columns[j],
         "x": hypergeometric(a.pool, columns[j], a.need, uniform01(*key, j))},
        lambda v: F.struct((v.a.need - v.x).alias("need"), (v.a.pool - v.good).alias("pool"),
                           F.concat(v.a.got, F.array(v.x)).alias("got"))), lambda a: a.got)


def communication_matrix(counts: DataFrame, depth: int, columns: list[int], seed: int) -> DataFrame:
    """(block, columns): rows that each of the 32^depth blocks sends to each shard.

    ``counts`` has (block, n); ``columns`` are the shard sizes.
    """
    shards = len(columns)
    nodes = counts.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("node"),
        F.array(*[F.lit(c).cast("bigint") for c in columns]).alias("columns"))
    for level in range(depth):
        below = FANOUT ** (depth - level - 1)
        kids = (counts.groupBy(F.floor(F.col("block") / below).alias("kid")).agg(F.sum("n").alias("n"))
                .groupBy(F.floor(F.col("kid") / FANOUT).alias("node"))
                .agg(F.map_from_entries(F.collect_list(F.struct(
                    (F.col("kid") % FANOUT).alias("at"), "n"))).alias("by")))
        drawn = nodes.join(kids, "node").select(
            "node", "columns", F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.lit(FANOUT - 1).cast("bigint")),
                lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("bigint"))).alias("sizes"))
        start = F.struct(F.col("columns").alias("rest"),
                         F.array().cast("array<array<bigint>>").alias("out"))
        split = F.aggregate(F.sequence(F.lit(0), F.lit(FANOUT - 1)), start, lambda a, i: _let(
            {"a": a, "x": _row(a.rest, F.aggregate(a.rest, F.lit(0).cast("bigint"), lambda s, c: s + c),
                               F.col("sizes")[i], shards, F.lit(seed), F.lit(level), F.col("node"), i)},
            lambda v: F.struct(F.zip_with(v.a.rest, v.x, lambda r, x: r - x).alias("rest"),
                               F.concat(v.a.out, F.array(v.x)).alias("out"))), lambda a: a.out)
        nodes = (drawn.select("node", F.posexplode(split).alias("at", "columns"))
                 .select((F.col("node") * FANOUT + F.col("at")).alias("node"), "columns"))
        if level < depth - 1:
            nodes = nodes.repartition("node")
    return nodes.withColumnRenamed("node", "block")


def shard_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24,
               seed: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``df``: a uniform
    random shuffle into ``shards`` shards whose row counts differ by at most one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = df.count()
    depth = 2
    while FANOUT**depth * BLOCK_ROWS < n:
        depth += 1
    blocks = FANOUT**depth
    row = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]

    def keyed(k: int) -> Column:
        return F.xxhash64(F.lit(seed * 4 + k), *row)

    digest = stored(df.select(F.col(id_col).alias("doc_id"),
                              (F.octet_length(text) + 8).cast("bigint").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"))
                    .withColumn("block", F.pmod(keyed(0), F.lit(blocks))))
    counts = digest.groupBy("block").agg(F.count("*").alias("n"))
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = communication_matrix(counts, depth, sizes, seed).select("block", F.aggregate(
        "columns", F.array(F.lit(0).cast("bigint")),
        lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c))).alias("ends"))
    local = F.row_number().over(Window.partitionBy("block").orderBy(keyed(1), *row))
    sent = stored(digest.join(matrix, "block").withColumn("at", local).select(
        *row, (F.size(F.filter("ends", lambda e: e < F.col("at"))) - 1).alias("shard"),
        F.pmod(keyed(2), F.lit(blocks)).alias("part")))
    offsets = (sent.groupBy("shard", "part").agg(F.count("*").alias("n"))
               .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
               .drop("n"))
    again = F.row_number().over(Window.partitionBy("shard", "part").orderBy(keyed(3), *row))
    return sent.join(offsets, ["shard", "part"]).select(
        *row, "shard", (F.col("before") + again - 1).alias("slot"))
