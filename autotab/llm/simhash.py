"""SimHash near-duplicates: exact links within a bit radius, by bit-sliced comparison.

A text's fingerprint has a bit set where more than half of its word shingles'
hashes have it set.  Two fingerprints within ``radius`` bits agree on all but
``radius`` of their eight bytes, so every choice of ``radius`` bytes to ignore gives a
band; fingerprints that agree on a band's other bytes are compared.  A band's
bucket holds at most 2^(8 radius) distinct fingerprints, whatever the input.

Comparison is bit-sliced: the bits of a block of fingerprints are stored as 64
planes, 64 lanes to a word; for a query the planes that differ are added into
carry-save counters that overflow when a lane exceeds the radius, and words
whose lanes have all overflowed are abandoned.  A bucket reports its connected
parts as one star each, never its pairs; alternating stars join them.

Defined cases: a null text is the empty text, whose fingerprint is zero and
links like any other; a null id takes part but is never a component id unless
its component has no other; repeated rows each get a row; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import id_text, stored, strings, unused
from autotab.llm.graph import components

LANES = 64
BLOCK = 1024
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of ``text``."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at:at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp) per row: the text's hash and its fingerprint, as signed longs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"),
                 pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "key", "fp"])

    return src.mapInArrow(run, f"doc_id {kind}, key long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """[64, words]: bit b of every fingerprint, 64 fingerprints to a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = -(-len(fps) // LANES) * LANES
    vertical = np.zeros((64, lanes), np.uint8)
    vertical[:, :len(fps)] = bits.T
    return np.packbits(vertical, axis=1, bitorder="little").view(np.uint64)


def near_pairs(queries: np.ndarray, fps: np.ndarray, radius: int,
               upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query index, fingerprint index) of all pairs within ``radius`` bits;
    ``upper`` skips words wholly before the query (both arrays are the same)."""
    vertical = planes(fps)
    words = vertical.shape[1]
    q, w = np.divmod(np.arange(len(queries) * words), words)
    if upper:
        keep = w >= q // LANES
        q, w = q[keep], w[keep]
    width = radius.bit_length()
    start = (1 << width) - 1 - radius    # so that the counters overflow beyond the radius
    counters = [np.full(len(q), _ALL if start >> i & 1 else np.uint64(0)) for i in range(width)]
    over = np.zeros(len(q), np.uint64)
    for b in range(64):
        flip = np.uint64(0) - (queries >> np.uint64(b) & np.uint64(1))
        carry = vertical[b][w] ^ flip[q]
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b % 8 == 7:
            alive = over != _ALL
            if not alive.all():
                q, w, over = q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    q, f = q[at], w[at] * LANES + lane
    inside = f < len(fps)
    return q[inside], f[inside]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (smallest index reachable so far) after the links (a, b)."""
    x, y = label[a], label[b]
    apart = x != y
    if not apart.any():
        return label
    ids, at = np.unique(np.concatenate([x[apart], y[apart]]), return_inverse=True)
    half = len(at) // 2
    new = np.arange(len(label))
    new[ids] = ids[stars(len(ids), at[:half], at[half:])]
    return new[label]


def _links(fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among sorted buckets (``ends``: end offset of each) of a run of rows: one star
    for each connected part of a bucket, so fewer links than fingerprints."""
    us, vs = [], []

    def emit(members, label):
        moved = np.flatnonzero(label != np.arange(len(members)))
        us.append(members[moved])
        vs.append(members[label[moved]])

    begins = np.concatenate([[0], ends[:-1]])
    at = 0
    while at < len(ends):
        size = ends[at] - begins[at]
        if size > BLOCK:    # a large bucket: block against block
            own, label = fps[begins[at]:ends[at]], np.arange(size)
            for i in range(0, size, BLOCK):
                for j in range(i, size, BLOCK):
                    a, b = near_pairs(own[i:i + BLOCK], own[j:j + BLOCK], radius, upper=i == j)
                    label = joined(label, a + i, b + j)
            emit(own, label)
            at += 1
            continue
        last = int(np.searchsorted(ends, begins[at] + BLOCK, side="right"))
        own = fps[begins[at]:ends[last - 1]]
        emit(own, stars(len(own), *near_pairs(own, own, radius, upper=True)))
        at = last
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that connect all fingerprints of ``distinct`` (fp, no repeats)
    that lie within ``radius`` bits of each other, directly or through others."""
    masks = [((1 << 64) - 1) ^ sum(255 << 8 * i for i in skip) for skip in combinations(range(8), radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    bands = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("rest"))
        for i, m in enumerate(signed)])).alias("b")).select("fp", "b.band", "b.rest")
    dealt = bands.repartition("band", "rest").sortWithinPartitions("band", "rest")

    def run(batches):
        kept = None
        for b in batches:
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "rest", "fp")]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            cut = new[-1] if len(new) else 0
            kept = [x[cut:] for x in now]
            yield from flush(now[2][:cut], new)
        if kept is not None:
            yield from flush(kept[2], np.array([len(kept[2])]))

    def flush(fps, ends):
        if not len(fps):
            return
        size = np.diff(ends, prepend=0)
        many = np.repeat(size > 1, size)
        fps, ends = fps[many].view(np.uint64), np.cumsum(size[size > 1])
        if len(fps):
            u, v = _links(np.ascontiguousarray(fps), ends, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                                 names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, rows, component, component_id): per distinct fingerprint its number of rows, one
    fingerprint that stands for its component, and the smallest id reachable."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    linked = components(links(nodes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    members = stored(linked.union(linked.select(F.col("root").alias("fp"), "root").distinct()).join(nodes, "fp"))
    lowest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(lowest, "root").select("fp", "root", "component_id")
    return nodes.join(named, "fp", "left").select(
        "fp", "rows", F.coalesce("root", "fp").alias("component"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, key, fp, component, component_id) per row of ``df``; components without an id, or
    with one id among them, still differ in ``component``.

    A fingerprint that holds more than 1/200 of the rows (at most 200 of them) is joined in 32 parts.
    """
    prints = stored(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle))
    found = stored(classes(prints, radius))
    total = prints.count()
    hot = [r.fp for r in found.filter(F.col("rows") * 200 > total).select("fp").collect()]
    parts = F.when(F.col("fp").isin(hot), F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("fp").isin(hot), F.pmod(F.xxhash64("doc_id", "key"), F.lit(32)).cast("int")).otherwise(0)
    return prints.withColumn("salt", salt).join(
        found.select("fp", "component", "component_id", F.explode(parts).alias("salt")), ["fp", "salt"]).select(
        "doc_id", "key", "fp", "component", "component_id")


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                radius: int = 2) -> DataFrame:
    """One row of ``df`` per component: the one with the component's id (of repeated
    ids, or of null ids when there are no others, the one with the smallest text hash).

    Which rows go is settled on (id, text hash); the texts pass one anti-join.  Only rows that repeat both
    id and text are sent on, so that one of them stays.
    """
    found = near_duplicates(df, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius)
    each = stored(found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("rows")))
    best = each.groupBy("component").agg(
        F.count("*").alias("members"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "rows")).alias("w"))
    many = best.filter("members > 1").select("component", F.col("w.doc_id").alias("first"), F.col("w.key").alias("first_key"))
    gone = each.join(many, "component").filter(~(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("first_key"))))
    none, name, key = unused(df, "_none", "_name", "_key")

    def keyed(rows: DataFrame, c, k) -> DataFrame:
        return rows.withColumns({none: c.isNull(), name: id_text(c), key: k})

    docs = keyed(df, F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    keys = [none, name, key]
    gone = keyed(gone.select("doc_id", F.col("key").alias("_k")), F.col("doc_id"), F.col("_k")).select(*keys)
    again = stored(best.filter("w.rows > 1").select("w.doc_id", F.col("w.key").alias("_k")))
    if not again.first():
        return docs.join(gone, keys, "left_anti").select(*df.columns)
    again = keyed(again, F.col("doc_id"), F.col("_k")).select(*keys)
    once = docs.join(gone.union(again), keys, "left_anti").select(*df.columns)
    return once.unionByName(docs.join(again, keys, "left_semi").dropDuplicates(keys).select(*df.columns))
