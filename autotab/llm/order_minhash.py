"""Order MinHash fingerprints: signatures that follow edit distance.

A text's k-mers (``k`` code points) are numbered by occurrence, so repeats
count.  For each of ``slots`` hash functions the ``TUPLE`` smallest of the numbered
k-mers are selected, put back in text order and hashed to one 32-bit value.
Two texts agree in a slot only if they share those k-mers in the same order;
the likeness of two fingerprints is the TUPLE-th root of their share of equal slots.

``edited_pairs`` compares every text with an edited form that borrows the
start of the next text by descending id.  Texts are range-partitioned by id once
and streamed in order; only a partition's first and last text leave it, to
meet across partition bounds.

Defined cases: a null text is the empty text, whose fingerprint is all zero; a
text shorter than ``k`` is one k-mer; null ids come last; rows with equal ids follow
each other by text hash; a single row is its own next document; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import mix, stored, strings

K = 8
SLOTS = 32
TUPLE = 2
_POSITION = 24
_CELLS = 1 << 17
_ODD = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of the k-mers in text order (``k`` a power of two)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.uint64)
    if len(c) < k:
        h = np.uint64(len(c))
        with np.errstate(over="ignore"):
            for x in c:
                h = h * _ODD[0] + np.uint64(x) * _ODD[1]
        return mix(np.array([h], np.uint64))
    h, span = (c + np.uint64(1)) * _ODD[2], 1
    while span < k:
        h = h[:-span] * _ODD[3 + span] + h[span:]
        span *= 2
    return mix(h)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-mer with its occurrence number, its position)."""
    if len(h) < 1 << _POSITION:    # hash and position in one word, sorted by value
        low = np.uint64((1 << _POSITION) - 1)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        packed.sort()
        group, at = packed >> np.uint64(_POSITION), (packed & low).astype(np.int64)
    else:
        group = h >> np.uint64(_POSITION)
        at = np.argsort(group, kind="stable")
        group = group[at]
    index = np.arange(len(h))
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(group[1:], group[:-1], out=new[1:])
    nth = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(np.uint64)
    return mix(group * _ODD[0] + nth * _ODD[1] + np.uint64(1)), at


def signature(text: str, k: int = K, slots: int = SLOTS) -> np.ndarray:
    """[slots] uint32; all zero for the empty text."""
    out = np.zeros(slots, np.uint32)
    h = kmers(text, k)
    if not len(h):
        return out
    base, at = numbered(h)
    step = max(1, _CELLS // len(base))
    for s in range(0, slots, step):
        ranked = base[None, :] * _ODD[16 + s:16 + min(s + step, slots), None]
        row = np.arange(len(ranked))
        picked = []
        for _ in range(min(TUPLE, len(base))):
            best = ranked.argmin(axis=1)
            ranked[row, best] = _TOP
            picked.append(best)
        picked = np.stack(picked, axis=1)
        order = np.argsort(at[picked], axis=1)
        ordered = base[np.take_along_axis(picked, order, axis=1)]
        value = np.zeros(len(ranked), np.uint64)
        for j in range(ordered.shape[1]):
            value = mix(value * _ODD[0] + ordered[:, j])
        out[s:s + len(ranked)] = value >> np.uint64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean() ** (1 / TUPLE))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 slots: int = SLOTS) -> DataFrame:
    """(doc_id, fingerprint) per row; the fingerprint is the slots' bytes in hex."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([signature(t, k, slots).tobytes().hex() for t in strings(b.column("text"))])],
                names=["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _compared(text: str, own: np.ndarray, following: str, theirs: np.ndarray, k: int) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    changed = edited(text, following)
    sig = signature(changed, k, len(own))
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), own.tobytes(),
            sig.tobytes(), likeness(own, sig), likeness(own, theirs))


_FIELDS = (("n_chars", "long", pa.int64()), ("edited_sha256", "binary", pa.binary()),
           ("fingerprint", "binary", pa.binary()), ("edited_fingerprint", "binary", pa.binary()),
           ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()))
_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(_FIELDS)]


def edited_pairs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (see the module's head)."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, before = TaskContext.get().partitionId(), None
        doc_type = pa.int64()

        def rows(edge, doc_ids, found, texts):
            n = len(edge)
            values = _columns(found) if found else [pa.nulls(n, t) for _, _, t in _FIELDS]
            return pa.RecordBatch.from_arrays(
                [pa.array(edge, pa.string()), pa.array([part] * n, pa.int32()), pa.array(doc_ids, doc_type),
                 *values, pa.array(texts, pa.string())],
                names=["edge", "part", "doc_id", *[f[0] for f in _FIELDS], "text"])

        for b in batches:
            doc_type = b.column("doc_id").type
            doc_ids, found = [], []
            for doc, t in zip(b.column("doc_id").to_pylist(), strings(b.column("text"))):
                sig = signature(t, k, slots)
                if before is None:
                    yield rows(["first"], [doc], [], [t])
                else:
                    doc_ids.append(before[0])
                    found.append(_compared(before[1], before[2], t, sig, k))
                before = doc, t, sig
            if found:
                yield rows([None] * len(found), doc_ids, found, [None] * len(found))
        if before is not None:
            yield rows(["last"], [before[0]], [], [before[1]])

    done = stored(src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, f"edge string, part int, doc_id {kind}, {_SCHEMA}, text string"))
    inner = done.filter("edge IS NULL").select("doc_id", *[f[0] for f in _FIELDS])
    parts = sorted(r.part for r in done.filter("edge = 'first'").select("part").collect())
    if not parts:
        return _named(inner)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = done.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    outer = (done.filter("edge = 'last'").select("part", "doc_id", "text").join(following, "part")
             .join(first, "next_part").select("doc_id", "text", "next_text"))

    def across(batches):
        for b in batches:
            found = [_compared(t, signature(t, k, slots), n, signature(n, k, slots), k)
                     for t, n in zip(strings(b.column("text")), strings(b.column("next_text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(found)],
                                             names=["doc_id", *[f[0] for f in _FIELDS]])

    return _named(inner.unionByName(outer.mapInArrow(across, f"doc_id {kind}, {_SCHEMA}")))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
