import re

import __spark_entry__
import corpus_pipeline
from autotab.llm import secret_scan


def test_registered():
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in q) == 1


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            break
        assert out.columns == first.columns and out.dtypes == first.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        rows = docs.collect()
        if name == "simhash_dedup":
            assert len({r.text for r in rows}) == len(rows)
        if name == "secrets":
            assert not any(re.search(secret_scan.HEX_LONG, r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
    assert out.groupBy("doc_id").agg({"length": "sum"}).count() == docs.count()


def stages(spark, docs, sf, tmp_path):
    """Rows after each stage, written and read again as the pipeline does."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return out


def test_nulls_long_repeated_and_clashing_columns(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    base = given.orderBy("doc_id").limit(60)
    text = base.filter("lang = 'en'").first().text
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(
        [(None, text + " and one more word here", None, None, None), (900001, None, "en", None, None), (900002, "", None, "s", 0),
         (900003, "12345 67", None, "s", 8), (900004, (text + " ") * 400, "en", "s", None),
         (900005, text, "en", "s", 1), (900005, text, "en", "s", 1), (900006, text, None, "s", 1)], kind)
    docs = base.unionByName(odd).selectExpr("*", "'k' AS _key", "1 AS _id", "'s' AS _spans", "2 AS score", "3 AS component")
    out = stages(spark, docs, sf, tmp_path)
    for name in ("language", "toxicity", "simhash_dedup", "secrets"):
        assert out[name].columns == docs.columns
    ids = {r.doc_id for r in out["language"].collect()}
    assert not ids & {900001, 900002, 900003} and 900004 in ids
    kept = [r.doc_id for r in out["simhash_dedup"].collect()]
    assert kept.count(900005) + kept.count(900006) <= 1 and len(kept) == len(set(kept))
    assert {r._key for r in out["secrets"].collect()} == {"k"}
    pieces = out["packing"]
    assert pieces.select("doc_id").distinct().count() == out["secrets"].select("doc_id").distinct().count()


def test_empty_table_and_no_optional_column(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    out = stages(spark, given.limit(0).drop("n_chars"), sf, tmp_path)
    assert all(df.count() == 0 for df in out.values())
