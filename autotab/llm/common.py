"""Helpers shared by the text operators."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autotab.session import cut_lineage

MASK64 = (1 << 64) - 1


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used for small digests that several jobs reuse and to cut the lineage of
    iterative jobs; the files outlive any executor (``autotab.session.release`` deletes them).
    """
    return cut_lineage(df)


def id_text(c: Column) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(c: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_text(c).cast("binary")), F.lit(folds))


def strings(col: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [t if t is not None else "" for t in col.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from well-mixed uint64 values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def word_table(groups: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct words, index of each word, start offset of each group).

    ``groups`` holds the words of each text; ids follow first occurrence.
    """
    sizes = np.fromiter(map(len, groups), np.int64, len(groups))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = list(chain.from_iterable(groups))
    if "\0" in "".join(flat):      # pandas would end such words there
        table = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        return list(table), np.fromiter(map(table.__getitem__, flat), np.int64, len(flat)), offsets
    words = np.empty(len(flat), object)
    words[:] = flat
    ids, words = pd.factorize(words)
    return words.tolist(), ids.astype(np.int64), offsets


def chunks(texts: list[str], limit: int = 2_000_000):
    """Slices (start, end) of ``texts`` holding about ``limit`` characters each,
    at least one text, so working memory follows the slice, not the batch."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive offsets; 0 where empty."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def bounded_sample(df: DataFrame, group: str, key: Column, per_group: int, total: int | None = None) -> DataFrame:
    """About ``per_group`` rows of every group (fewer if all groups would pass ``total``), chosen by a
    hash of ``key``: all rows of a smaller group.  Reads one count per group."""
    share = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = F.lit(False)
    counts = df.groupBy(group).count().collect()
    if total is not None and counts:
        per_group = max(1, min(per_group, total // len(counts)))
    for row in counts:
        wanted = wanted | ((F.col(group) == F.lit(row[0])) & (share < per_group / row["count"]))
    return df.filter(wanted)
