"""SparkSession construction and stored intermediate results."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SPREAD = 10_000         # fewer rows stay in the partitions they have
ROWS_PER_TASK = 500_000     # of a table that many passes read


def get_spark(master: str | None = None, app: str = "autotab",
              shuffle_partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    Master, shuffle partitions and driver memory are set only when given;
    otherwise those of spark-submit or the cluster hold. AQE is on so shuffle
    partitions are coalesced and skewed joins split at runtime; ANSI mode stays
    on (Spark 4 default), so divisions go through ``try_divide``/``nullif``.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only a local session without one gets a scratch folder; elsewhere its
    absence is an error, since executors could not see a local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="autotab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table under the checkpoint directory.

    Used where a result must be computed exactly once (global ranks) or an
    iterative job would otherwise grow its plan every round. One write job;
    the files sit in the shared folder named by the session, so a lost
    executor cannot take them along (unlike cached or local blocks).
    :func:`release` deletes them when nothing reads them any more.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/autotab-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files behind results of :func:`cut_lineage`; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
            df._stored_path = None


def spread(df: DataFrame) -> DataFrame:
    """``df`` kept in executor storage, in partitions of less than twice an even share of the cores and of
    less than twice ``ROWS_PER_TASK``.

    A file of few row groups, or a join on few keys, leaves the rows in few partitions, and every pass over
    them would use as few cores. Rows are moved only then.
    """
    held = df.persist()
    tasks = _uneven(held)
    if not tasks:
        return held
    held.unpersist()        # so that the move reads the source, not one large stored partition per task
    even = df.repartition(tasks).persist()
    even.count()            # stored whole: a job that looks at one row would move all rows for one partition
    return even


def evened(df: DataFrame) -> DataFrame:
    """``df``, a table just read, moved to partitions as even as :func:`spread` wants them, unless it lies so.

    The rows are counted without reading a column. Unlike ``spread`` it goes before the first pass, so that none of them
    has as few tasks as the file has row groups.
    """
    tasks = _uneven(df)
    return df.repartition(tasks) if tasks else df


def _uneven(df: DataFrame) -> int | None:
    """Partitions to move ``df`` to; None if it may stay as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    n = sum(sizes)
    if n < MIN_SPREAD or max(sizes) <= 2 * min(n / cores, ROWS_PER_TASK):
        return None
    return max(2 * cores, math.ceil(n / ROWS_PER_TASK))
