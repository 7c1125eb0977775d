"""Source and sink queries. Files are written under the
session's checkpoint folder (shared storage on a cluster) and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from autotab import sources as IO
from autotab.operators import models as MD
from autotab.plans import fixtures as X
from autotab.plans.model_plans import lineitem_binary
from autotab.plans.profile_plans import LI
from autotab.plans.registry import plan
from autotab.session import ensure_checkpoint_dir

CSV_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "qty_null", "flag_null", "l_returnflag"]


def scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/autotab-io-{name}-{uuid.uuid4().hex}"


@plan("read_parquet", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, cast(l_shipdate as varchar) AS l_shipdate FROM lineitem""")
def q_read_parquet(spark, d):
    df = IO.read_table(spark, f"{d}/lineitem.parquet")
    return df.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@plan("write_csv", sql=f"SELECT {', '.join(CSV_COLS)} FROM {LI}")
def q_write_csv(spark, d):
    path = scratch(spark, "csv")
    IO.write_csv(X.lineitem(spark, d).select(*CSV_COLS), path)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"),
                      F.col("l_quantity").cast("double"), F.col("qty_null").cast("double"),
                      "flag_null", "l_returnflag")


@plan("read_csv", sql=f"""
SELECT l_orderkey, cast(l_linenumber as bigint) AS l_linenumber, l_quantity, qty_null, flag_null,
       l_returnflag FROM {LI}""")
def q_read_csv(spark, d):
    path = scratch(spark, "csv") + "/data.csv"
    IO.write_csv(X.lineitem(spark, d).select(*CSV_COLS), path)
    return IO.read_table(spark, path)


@plan("read_csv_quoted", sql="""
SELECT p_partkey, 'say "' || p_name || '", twice ""' AS quoted, p_brand || chr(10) || p_type AS two_lines,
       cast(p_size as varchar) || 'd' AS suffixed, 1.5 * p_size AS number FROM part""")
def q_read_csv_quoted(spark, d):
    """Doubled quotes, newlines inside values and number-like text survive a write and a read."""
    path = scratch(spark, "csv") + "/data.csv"
    p = X.table(spark, d, "part")
    IO.write_csv(p.select("p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('", twice ""')).alias("quoted"),
                          F.concat("p_brand", F.lit("\n"), "p_type").alias("two_lines"),
                          F.concat(F.col("p_size").cast("string"), F.lit("d")).alias("suffixed"),
                          (1.5 * F.col("p_size")).alias("number")), path)
    return IO.read_table(spark, path)


@plan("read_feather", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_read_feather(spark, d):
    path = scratch(spark, "feather")
    IO.write_feather(X.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                        "o_totalprice"), path)
    return IO.read_table(spark, path, "feather")


@plan("preview", sql=f"SELECT row_id, l_quantity, l_returnflag FROM {LI} ORDER BY row_id LIMIT 5")
def q_preview(spark, d):
    return IO.preview(X.lineitem(spark, d).select("row_id", "l_quantity", "l_returnflag"), ["row_id"], 5)


#: The test rows of the stratified split: as many as its quotas.
@plan("save_model", sql="""
SELECT cast(ceil(count(*) * 0.2) as bigint) AS n, cast(ceil(count(*) * 0.2) as bigint) AS n_equal FROM lineitem""")
def q_save_model(spark, d):
    """Fit, save, reload, score: predictions of the reloaded model."""
    train, test, _ = lineitem_binary(spark, d)
    m = MD.fit_model(train, "classification", "clf_logistic")
    path = scratch(spark, "model")
    IO.save_model(m, path, spark)
    loaded = IO.load_model(path, spark)
    a = MD.score(m, test, ["row_id"]).select("row_id", F.col("prediction").alias("p_saved"))
    b = MD.score(loaded, test, ["row_id"]).select("row_id", F.col("prediction").alias("p_loaded"))
    return a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col("p_saved") == F.col("p_loaded")).alias("n_equal"))
