"""Readers and writers.

``read_table`` picks the reader by file extension like the original upload
path. CSV is read as text and typed by one aggregate over all columns
(pandas-like inference: integer -> float -> boolean -> text, NA tokens ->
null); Feather/Arrow IPC files come through a Python data source with one
partition per file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text tokens read as missing (the pandas CSV defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Text read as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

READERS = {"csv": "csv", "txt": "csv", "parquet": "parquet", "feather": "feather",
           "arrow": "feather"}


def file_extension(path: str) -> str:
    return path.rstrip("/").split(".")[-1].lower()


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or READERS.get(file_extension(path))
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "feather":
        return read_feather(spark, path)
    raise ValueError(f"unsupported file type: {path} (csv, txt, parquet, feather)")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Numbers in text: no type suffixes, no Java spellings.
LONG_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"


def read_csv(spark: SparkSession, path: str, sep: str = ",", multiline: bool = True) -> DataFrame:
    """Header row, comma separated, doubled quotes inside quoted values; NA tokens become null;
    each column gets the narrowest of long, double, boolean, string that all its values fit.

    ``multiline`` allows newlines inside quoted values, which makes a file one task; turn it off for
    large files without such newlines, so they are split."""
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False) \
        .option("quote", '"').option("escape", '"').option("multiLine", multiline) \
        .option("nullValue", None).option("emptyValue", "").csv(path)
    cols = raw.columns
    clean = raw.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None).cast("string"))
                         .otherwise(F.col(f"`{c}`")).alias(c) for c in cols])
    checks = []
    for c in cols:
        v = F.col(f"`{c}`")
        checks += [F.count(v).alias(f"{c}__n"),
                   F.count(F.when(v.rlike(LONG_TEXT), F.trim(v).try_cast("long"))).alias(f"{c}__l"),
                   F.count_if(v.rlike(NUMBER_TEXT)).alias(f"{c}__d"),
                   F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"{c}__b")]
    stats = clean.agg(*checks).first().asDict() if cols else {}
    out = []
    for c in cols:
        n, nl, nd, nb = (stats[f"{c}__n"], stats[f"{c}__l"], stats[f"{c}__d"], stats[f"{c}__b"])
        v = F.col(f"`{c}`")
        if n == 0:
            out.append(v.cast("double").alias(c))        # all missing: float column of NaN
        elif nl == n:
            out.append(F.trim(v).cast("long").alias(c))
        elif nd == n:
            out.append(F.trim(v).cast("double").alias(c))
        elif nb == n:
            out.append(v.isin(TRUE_TOKENS).alias(c))
        else:
            out.append(v.alias(c))
    return clean.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index column, quotes doubled; one file per partition under ``path``."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def preview(df: DataFrame, ids: list[str], n: int = 5) -> DataFrame:
    """First n rows in key order (a plain limit is not repeatable)."""
    return df.orderBy(*ids).limit(n)


# ------------------------------------------------------------------ feather
BATCHES_PER_TASK = 4


def _fs(path: str):
    """(pyarrow filesystem, path inside it) for local, file:, hdfs:, s3: ..."""
    import pyarrow.fs as pafs
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        import os
        path = "file://" + os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def _list_files(path: str) -> list[str]:
    import fnmatch
    import pyarrow.fs as pafs
    fs, p = _fs(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.Directory:
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(p))
                 if f.path.endswith((".feather", ".arrow"))]
    elif info.type == pafs.FileType.File:
        files = [p]
    else:
        parent = p.rsplit("/", 1)[0]
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(parent))
                 if fnmatch.fnmatch(f.path, p)]
    if not files:
        raise FileNotFoundError(path)
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    return sorted(scheme + f if scheme != "file://" else "file://" + f for f in files)


def _register_feather(spark: SparkSession) -> None:
    from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                        WriterCommitMessage)

    class FeatherPartition(InputPartition):
        def __init__(self, path, first, last):
            self.path, self.first, self.last = path, first, last

    class FeatherReader(DataSourceReader):
        def __init__(self, options, schema):
            self.options, self.schema_ = options, schema

        def partitions(self):
            import pyarrow.ipc as ipc
            out = []
            for path in _list_files(self.options["path"]):
                fs, p = _fs(path)
                with fs.open_input_file(p) as src:
                    n = ipc.open_file(src).num_record_batches
                out += [FeatherPartition(path, i, min(i + BATCHES_PER_TASK, n)) for i in range(0, n, BATCHES_PER_TASK)]
            return out or [FeatherPartition(None, 0, 0)]

        def read(self, partition):
            import pyarrow.ipc as ipc
            if partition.path is None:
                return
            fs, p = _fs(partition.path)
            with fs.open_input_file(p) as src:
                reader = ipc.open_file(src)
                for i in range(partition.first, partition.last):
                    yield reader.get_batch(i)

    @dataclass
    class FeatherDone(WriterCommitMessage):
        file: str | None

    class FeatherWriter(DataSourceArrowWriter):
        """Every task attempt writes a file of its own under ``_temporary``; the driver moves the
        files of the attempts that count to their names, so repeated attempts leave no rows behind."""

        def __init__(self, options):
            self.path = options["path"]

        def write(self, batches):
            import uuid

            import pyarrow.ipc as ipc
            fs, p = _fs(self.path)
            fs.create_dir(f"{p}/_temporary", recursive=True)
            name, out, sink = f"{p}/_temporary/{uuid.uuid4().hex}", None, None
            for b in batches:
                if out is None:
                    sink = fs.open_output_stream(name)
                    out = ipc.new_file(sink, b.schema)
                out.write_batch(b)
            if out is None:
                return FeatherDone(None)
            out.close()
            sink.close()
            return FeatherDone(name)

        def commit(self, messages):
            fs, p = _fs(self.path)
            kept = [m.file for m in messages if m is not None and m.file]
            for i, name in enumerate(sorted(kept)):
                fs.move(name, f"{p}/part-{i:05d}.feather")
            self._clean(fs, p)

        def abort(self, messages):
            self._clean(*_fs(self.path))

        def _clean(self, fs, p):
            import pyarrow.fs as pafs
            if fs.get_file_info(f"{p}/_temporary").type == pafs.FileType.Directory:
                fs.delete_dir(f"{p}/_temporary")

    class FeatherSource(DataSource):
        @classmethod
        def name(cls):
            return "autotab_feather"

        def schema(self):
            import pyarrow.ipc as ipc
            from pyspark.sql.pandas.types import from_arrow_schema
            fs, p = _fs(_list_files(self.options["path"])[0])
            with fs.open_input_file(p) as src:
                return from_arrow_schema(ipc.open_file(src).schema)

        def reader(self, schema):
            return FeatherReader(self.options, schema)

        def writer(self, schema, overwrite):
            return FeatherWriter(self.options)

    spark.dataSource.register(FeatherSource)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather (Arrow IPC file) file, directory or glob on any filesystem
    pyarrow reaches; a few record batches per partition, straight to Spark."""
    _register_feather(spark)
    return spark.read.format("autotab_feather").option("path", path).load()


def write_feather(df: DataFrame, path: str) -> int:
    """One Feather file per non-empty partition, streamed by the executors to ``path`` and
    committed together. Returns the number of files."""
    _register_feather(df.sparkSession)
    df.write.format("autotab_feather").mode("append").option("path", path).save()
    return len(_list_files(path))
