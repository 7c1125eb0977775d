"""Prefix trie of conversations by range minima over sorted common prefixes.

A conversation is the sequence of its turns' digests (16 bytes of md5 each, so
byte order keeps prefixes together).  Rows are range-partitioned and sorted by sequence
and id; neighbours' common prefix lengths (LCP) then hold the whole trie: a
prefix of depth d is a run of rows whose inner LCPs are d or more.  Each partition builds a
sparse table of range minima over its LCPs, and every candidate prefix, a row with a
depth beyond its LCP, finds the left and the right end of its run by binary search in that table,
on its own and without a stack.  All sums over a run or its subtree are differences of prefix sums.

A run may cross partitions.  Its pieces carry additive sums, so they are added up by
the prefix's hash; only runs that touch a partition's edge take part, at most
the length of the edge's LCP per partition.  A node's parent is found in its own partition.

Defined cases: rows without conversation id take no part; a null role or text is empty; turns
of one number are ordered by role and text digest and repeated rows are turns each; a
conversation without turns is a member of the root alone; an empty table gives no nodes; other
columns are not read.  One conversation's digests (24 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autotab.llm.common import stored
from autotab.session import release

DIGEST = 16
PART_TURNS = 1_000_000      # turns per partition at most, about
CHUNK = 4096                # ids hashed or carried at once


def sequences(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, turns): array of (digest, bytes) of every conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).isNotNull().alias("has"), F.col(turn_col).alias("turn"), role.alias("role"),
                    F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
                    F.octet_length(text).cast("long").alias("bytes"))
    return (df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.bytes.alias("bytes"))).alias("turns")))


def plain(turned: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) of (conv_id, turns)."""
    return turned.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), "")).alias("seq"),
                         F.transform("turns", lambda t: t.bytes).alias("sizes"))


def regrown(df: DataFrame, *, group: int = 5, heads: int = 9, **cols) -> DataFrame:
    """(conv_id, seq, sizes) of conversations rebuilt on shared heads: the first h turns of
    conversation c - c % ``group``, then c's own turns after its first h; h is
    crc32(c) modulo ``heads``."""
    own = sequences(df, **cols)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    base = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(base, "base", "left")
    empty = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(empty)
    return plain(joined.select("conv_id", F.concat(head, rest).alias("turns")))


class Minima:
    """Sparse table of range minima of an array."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while len(self.rows[-1]) > 1 << len(self.rows) - 1:
            half, last = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of x[a..b], both ends included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << int(k)) + 1])
        return out

    def right(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Largest r >= at with x[at + 1 .. r] >= d."""
        r = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            fits = r + 1 < len(row)
            go = np.zeros(len(r), bool)
            go[fits] = row[r[fits] + 1] >= d[fits]
            r += step * go
        return r

    def left(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Smallest l <= at with x[l + 1 .. at] >= d."""
        left = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            fits = left - step >= 0
            go = np.zeros(len(left), bool)
            go[fits] = row[left[fits] - step + 1] >= d[fits]
            left -= step * go
        return left


def common(a: bytes, b: bytes) -> int:
    """Number of leading digests that two sequences share."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(s, f"V{DIGEST}", n) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


class Part:
    """The rows of one partition in order, with their LCPs."""

    def __init__(self, ids: np.ndarray, seqs: list[bytes], sizes: list[np.ndarray], before: int, after: int):
        self.ids, self.seqs, n = ids, seqs, len(ids)
        self.before, self.after = before, after      # LCP with the rows beyond both edges, -1 if there is none
        self.len = np.array([len(s) // DIGEST for s in seqs], np.int64)
        self.lcp = np.zeros(n, np.int64)              # entry 0 is never asked for
        self.lcp[1:] = self._neighbours()
        start = np.concatenate([[0], np.cumsum(self.len)])
        self.start, self.cum = start[:-1], np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])
        self.minima, self.least = Minima(self.lcp), Minima(ids)
        #: depth up to which a row's prefixes are also those of the row before it
        self.shared = np.concatenate([[before], self.lcp[1:]])
        ahead = np.concatenate([self.lcp[1:], [after]])
        self.leaf = ahead < self.len
        self.total = self.bytes_to(np.arange(n), self.len)

    def _neighbours(self) -> np.ndarray:
        """LCP of each row but the first with the row before it."""
        n = len(self.len)
        if n < 2:
            return np.zeros(0, np.int64)
        flat = np.frombuffer(b"".join(self.seqs), np.uint64).reshape(-1, 2)
        start = np.concatenate([[0], np.cumsum(self.len)])
        both = np.minimum(self.len[1:], self.len[:-1])
        row = np.repeat(np.arange(n - 1), both)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
        differ = np.flatnonzero((flat[start[row] + offset] != flat[start[row + 1] + offset]).any(axis=1))
        out = both.copy()
        np.minimum.at(out, row[differ], offset[differ])
        return out

    def bytes_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of a row's first ``depth`` turns."""
        return self.cum[self.start[row] + depth] - self.cum[self.start[row]]

    def nodes(self) -> dict[str, np.ndarray]:
        """Every prefix with a row in this partition, as far as its run lies here."""
        n = len(self.ids)
        low = self.lcp + 1                             # first depth that starts at a row
        low[0] = 0
        count = np.maximum(self.len - low + 1, 0)
        base = np.cumsum(count) - count
        row = np.repeat(np.arange(n), count)
        depth = np.arange(len(row)) - np.repeat(base, count) + low[row]
        right, left = self.minima.right(row, depth), self.minima.left(row, depth)
        over = lambda x: np.concatenate([[0], np.cumsum(x)])
        total, leaves = over(self.total), over(self.leaf)
        own = over(self.total - self.bytes_to(np.arange(n), np.maximum(self.shared, 0)))
        members = right - left + 1
        above = np.maximum(depth - 1, 0)
        #: bytes of the subtree's nodes, each counted at the first row that has it
        new = own[right + 1] - own[left + 1] + self.total[left] - self.bytes_to(left, np.maximum(above, self.shared[left]))
        saved = total[right + 1] - total[left] - members * self.bytes_to(left, above) - new
        up = np.full(len(row), -1, np.int64)           # the parent's number
        inner = np.flatnonzero(depth > 0)
        top = self.minima.left(row[inner], depth[inner] - 1)
        up[inner] = base[top] + depth[inner] - 1 - low[top]
        children = np.zeros(len(row), np.int64)
        fresh = inner[depth[inner] > self.shared[row[inner]]]
        np.add.at(children, up[fresh], 1)
        onward = (left == 0) & (depth <= self.before)
        crossing = onward | ((right == n - 1) & (depth <= self.after))
        same = np.concatenate([[False], (self.lcp[1:] == self.len[1:]) & (self.len[1:] == self.len[:-1])])
        group = np.cumsum(~same) - 1                   # equal rows; those that end at a node come first in its run
        ends = np.where(self.len[left] == depth, np.bincount(group)[group[left]], 0)
        return {"depth": depth, "left": left, "conv_id": self.least.over(left, right), "n_convs": members,
                "n_children": children, "n_leaves": leaves[right + 1] - leaves[left], "saved": saved, "ends": ends,
                "up": up, "crossing": crossing, "onward": onward}


def _names(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


_NODE = [("part", pa.int32()), ("depth", pa.int64()), ("onward", pa.bool_()), ("key", pa.binary()), ("conv_id", pa.int64()),
         ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
         ("ends_sha256", pa.string()), ("chunk", pa.int32()), ("ids", pa.binary()), ("parent_conv_id", pa.int64()),
         ("up_onward", pa.bool_())]
_NODE_DDL = ("part int, depth long, onward boolean, key binary, conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, ends_sha256 string, chunk int, ids binary, parent_conv_id long, up_onward boolean")


def _describe(number: int, part: Part):
    """Record batches of a partition's nodes.  A crossing prefix has a key and, in further rows
    without sums, the ids that end there."""
    x = part.nodes()
    n = len(x["depth"])
    up = x["up"]
    known = (up >= 0) & ~x["crossing"][up]
    parent = np.where(known, x["conv_id"][up], -1)
    none = hashlib.sha256(b"").hexdigest()
    for at in range(0, n, 1 << 16):
        idx = np.arange(at, min(at + (1 << 16), n))
        rows = {c: [] for c, _ in _NODE}

        def put(i, **extra):
            one = {"part": number, "depth": int(x["depth"][i]), "onward": bool(x["onward"][i])} | extra
            for c, _ in _NODE:
                rows[c].append(one.get(c))

        for i in idx[x["crossing"][idx]]:      # few: they touch an edge
            key = hashlib.md5(part.seqs[x["left"][i]][:DIGEST * int(x["depth"][i])]).digest()
            put(i, key=key, conv_id=int(x["conv_id"][i]), n_convs=int(x["n_convs"][i]), n_children=int(x["n_children"][i]),
                n_leaves=int(x["n_leaves"][i]), saved_tokens=int(x["saved"][i]),
                up_onward=bool(x["onward"][up[i]]) if up[i] >= 0 else None)
            first = int(x["left"][i])
            for c, lo in enumerate(range(first, first + int(x["ends"][i]), CHUNK)):
                put(i, key=key, chunk=c, ids=_names(part.ids[lo:min(lo + CHUNK, first + int(x["ends"][i]))]))
        if rows["part"]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in _NODE], names=[c for c, _ in _NODE])
        idx = idx[~x["crossing"][idx]]
        if not len(idx):
            continue
        hashes = [none] * len(idx)
        for j in np.flatnonzero(x["ends"][idx]):
            i = idx[j]
            state, first, last = hashlib.sha256(), int(x["left"][i]), int(x["left"][i] + x["ends"][i])
            for lo in range(first, last, CHUNK):
                state.update((b"," if lo > first else b"") + _names(part.ids[lo:min(lo + CHUNK, last)]))
            hashes[j] = state.hexdigest()
        size, has = len(idx), up[idx] >= 0
        fixed = {"part": pa.array(np.full(size, number, np.int32)), "depth": pa.array(x["depth"][idx]),
                 "onward": pa.array(np.zeros(size, bool)), "conv_id": pa.array(x["conv_id"][idx]),
                 "n_convs": pa.array(x["n_convs"][idx]), "n_children": pa.array(x["n_children"][idx]),
                 "n_leaves": pa.array(x["n_leaves"][idx].astype(np.int64)), "saved_tokens": pa.array(x["saved"][idx]),
                 "ends_sha256": pa.array(hashes, pa.string()),
                 "parent_conv_id": pa.array(parent[idx], mask=~known[idx]),
                 "up_onward": pa.array(x["onward"][up[idx]], mask=~(has & ~known[idx]))}
        yield pa.RecordBatch.from_arrays([fixed.get(c, pa.nulls(size, t)) for c, t in _NODE], names=[c for c, _ in _NODE])


def _pieces(batches):
    """Nodes of partitions that arrive one after the other, each in order."""
    held, number = [], None

    def flush():
        ids = np.concatenate([b.column("conv_id").to_numpy() for b in held])
        seqs = [s for b in held for s in b.column("seq").to_pylist()]
        flat = [b.column("sizes").flatten().to_numpy() for b in held]
        first = held[0]
        return _describe(number, Part(ids, seqs, flat, first.column("before")[0].as_py(), first.column("after")[0].as_py()))

    for batch in batches:
        part = batch.column("part").to_numpy()
        ends = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for a, b in zip(ends[:-1], ends[1:]):
            if a == b:
                continue
            if held and part[a] != number:
                yield from flush()
                held = []
            number = int(part[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from flush()


def _hashed(batches):
    """SHA-256 of the comma-joined ids of each key; chunks arrive in order."""
    key, state = None, None
    for batch in batches:
        keys, out = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids)
            else:
                state.update(b",")
                state.update(ids)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "sha"])


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations`` (conv_id, seq, sizes): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = stored(conversations)
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART_TURNS))
    ordered = rows.repartitionByRange(parts, "seq", "conv_id").withColumn("part", F.spark_partition_id())
    dealt = stored(ordered)
    edges = dealt.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))

    def shared(batches):
        for b in batches:
            lcp = [-1 if y is None else common(x, y) for x, y in zip(b.column("last").to_pylist(), b.column("next").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(lcp, pa.int64())], names=["part", "after"])

    row = Window.orderBy("part")      # one row per partition
    after = stored(edges.withColumn("next", F.lead("first").over(row)).select("part", "last", "next")
                   .mapInArrow(shared, "part int, after long"))
    bounds = after.withColumn("before", F.coalesce(F.lag("after").over(row), F.lit(-1).cast("long")))
    here = dealt.join(F.broadcast(bounds), "part")      # three numbers per partition
    pieces = stored(here.repartition(parts, "part").sortWithinPartitions("part", "seq", "conv_id")
                    .select("part", "before", "after", "conv_id", "seq", "sizes").mapInArrow(_pieces, _NODE_DDL))
    whole = pieces.filter("key IS NULL")
    crossing = pieces.filter("key IS NOT NULL AND chunk IS NULL")
    sums = crossing.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min(F.struct("part", "onward", "depth", "up_onward")).alias("at"))
    sums = stored(sums)
    shas = (pieces.filter("chunk IS NOT NULL").select("key", "part", "chunk", "ids").repartition("key")
            .sortWithinPartitions("key", "part", "chunk").select("key", "ids").mapInArrow(_hashed, "key binary, sha string"))
    over = sums.join(shas, "key", "left").select(
        "at.part", "at.depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        F.lit(None).cast("long").alias("parent_conv_id"), "at.up_onward")
    # parents that cross an edge: (partition, depth, which edge) names them among its nodes
    named = crossing.select("key", "part", "depth", "onward").join(sums.select("key", "conv_id"), "key").select(
        "part", (F.col("depth") + 1).alias("depth"), F.col("onward").alias("up_onward"), F.col("conv_id").alias("_parent"))
    nodes = whole.select(*over.columns).unionByName(over).join(named, ["part", "depth", "up_onward"], "left")
    release(rows)
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs",
                        "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(df: DataFrame, *, group: int = 5, heads: int = 9, **cols) -> DataFrame:
    """Trie of the conversations of ``df`` rebuilt on shared heads (:func:`regrown`)."""
    return trie(regrown(df, group=group, heads=heads, **cols))
