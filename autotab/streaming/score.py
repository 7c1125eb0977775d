"""Scoring a stream with a fitted preparation + model.

The original reads complete uploaded files only; there is no streaming
operator to reproduce. What carries over is applying a saved
``PipelineModel`` (and a model with ``transform``) to rows as they arrive:
``transform`` is a per-row projection, so it runs unchanged on a streaming
DataFrame. Offsets and the sink commit log live under the checkpoint
location, so a restarted query resumes without loss or duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from autotab.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files: int = 1) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files).load(path))


def score_stream(stream: DataFrame, prep_model, model, ids: list[str], out_path: str,
                 checkpoint: str | None = None, fmt: str = "parquet",
                 trigger_once: bool = True) -> StreamingQuery:
    """prep -> model -> (ids, prediction[, probability]) appended to ``out_path``."""
    from autotab.operators.models import score
    prepared = prep_model.transform(stream)
    scored = score(model, prepared, ids, label="__none__")
    checkpoint = checkpoint or (ensure_checkpoint_dir(stream.sparkSession).rstrip("/")
                                + "/autotab-stream-" + out_path.rstrip("/").split("/")[-1])
    writer = (scored.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", out_path))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
