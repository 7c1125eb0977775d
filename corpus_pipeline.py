"""A training-corpus pipeline over ``documents``; part of the llm subpackage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of ``documents``.

Defined cases: a null or letterless text has no language and goes in the first
stage; rows with a null id stay and are told apart by their text; of rows that repeat id
and text one stays; an empty table passes all stages and gives no pieces; further columns,
whatever their names, are carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autotab.llm import langid, packing, secret_scan, simhash, toxicity
from autotab.llm import queries as q
from autotab.llm.common import fold_of
from autotab.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a recognisable language go."""
    model = langid.train(docs, fold_of(docs["doc_id"], 4) != 2)
    return langid.keep_known(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents scored toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.train(docs, labels, fold_of(labels["doc_id"], 5) != 0)
    return toxicity.keep_clean(docs, net)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays."""
    return simhash.deduplicate(docs, shingle=3, radius=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every reported span is replaced by a mark; n_chars follows where it is a column."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: tokens of every document in windows of 1024."""
    return packing.pack(docs, *q._byte_bpe(), window=1024)


STAGES = [("language", language), ("toxicity", toxic), ("simhash_dedup", dedup),
          ("secrets", secrets), ("packing", pack)]

#: Trained classifiers and near-duplicate components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
