"""Best-fit-decreasing packing of token sequences into fixed windows.

A document is its token ids followed by one end id.  Every full window of an
overlong document is cut off first and becomes a sequence of its own; what is
left (at most ``window`` ids) is packed best-fit decreasing: the open windows
are indexed by remaining capacity in a segment tree, which finds the tightest
window that still takes the piece.

Ids come from a byte-level BPE.  ``tokenizers`` defines them: the content of an added
token (``<|endoftext|>``) inside a text is that token.  For texts without one and without
code points beyond Latin Extended-B the same merges are applied by ``tiktoken``,
which gives the same ids several times faster (tests/llm compares the two).

Defined cases: a null text is the empty text; an empty text is the single end
id; repeated rows are packed each on its own; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import strings

_LATIN = re.compile("[\x00-ɏ]*")
_LOADED: dict = {}


class ByteBpe:
    """Token ids of a byte-level BPE file and its rank file."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import base64

        import tiktoken
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.full = None

    def _full(self, text: str, ordinary: bool) -> array:
        if self.full is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            self.full = Tokenizer.from_file(self.json_path)
        self.full.encode_special_tokens = ordinary
        return array("I", self.full.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> array:
        """The ids of ``text`` with contents of added tokens taken as ordinary text."""
        if _LATIN.fullmatch(text):
            return array("I", self.fast.encode_ordinary(text))
        return self._full(text, True)

    def encode(self, text: str) -> array:
        """The ids that the file's tokenizer gives as it is, added tokens included."""
        if any(t in text for t in self.added):
            return self._full(text, False)
        return self.ids(text)


def load_bpe(json_path: str, rank_path: str, pattern: str) -> ByteBpe:
    key = (json_path, rank_path)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(json_path, rank_path, pattern)
    return _LOADED[key]


class CapacityTree:
    """Segment tree over the capacities 0..window; a node counts the open
    windows below it.  ``tightest`` finds the smallest capacity >= need."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, seq: int) -> None:
        self.open[capacity].append(seq)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, capacity: int) -> int:
        node = capacity + self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.open[capacity].pop()

    def tightest(self, need: int) -> int | None:
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.size


def token_pieces(df: DataFrame, json_path: str, rank_path: str, pattern: str, *,
                 id_col: str = "doc_id", text_col: str = "text", window: int = 1024,
                 end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens), and
    with ``keep_ids`` the piece's token ids themselves."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load_bpe(json_path, rank_path, pattern)
        for b in batches:
            which, start, length, crc, total, kept = [], [], [], [], [], []
            for row, text in enumerate(strings(b.column("text"))):
                ids = bpe.encode(text)
                ids.append(end_id)
                raw, n = memoryview(ids).cast("B"), len(ids)
                for at in range(0, n, window):
                    size = min(window, n - at)
                    which.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                    total.append(n)
                    if keep_ids:
                        kept.append(ids[at:at + size])
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(which, pa.int64())), pa.array(start, long),
                 pa.array(length, long), pa.array(crc, long), pa.array(total, long)]
                + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []),
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return src.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, "
                               "doc_tokens long" + ", ids array<int>" * keep_ids)


def pack_pieces(pieces: DataFrame, n_docs: int, *, window: int = 1024,
                per_bucket: int = 2048) -> DataFrame:
    """Place every piece in a sequence: adds (sequence_id, offset).

    Pieces are dealt to ``n_docs / per_bucket`` buckets by a hash of the piece,
    each bucket is streamed in decreasing length and packed on its own, so no
    task holds more than the open windows of one bucket.  Sequence ids are
    local numbers interleaved over the buckets, hence unique.
    """
    buckets = max(1, -(-n_docs // per_bucket))
    dealt = (pieces.withColumn("bucket", F.pmod(
                F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(buckets)))
             .repartition("bucket")
             .sortWithinPartitions("bucket", F.desc("length"), "doc_id", "start", "ids_crc32"))
    kept = [c for c in dealt.columns if c != "bucket"]
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        current, used, tree = None, 0, None
        for b in batches:
            seqs, offsets = [], []
            for bucket, length in zip(b.column("bucket").to_pylist(), b.column("length").to_pylist()):
                if bucket != current:
                    current, used, tree = bucket, 0, CapacityTree(window)
                capacity = tree.tightest(length)
                if capacity is None:
                    seq, capacity = used * buckets + bucket, window
                    used += 1
                else:
                    seq = tree.take(capacity)
                seqs.append(seq)
                offsets.append(window - capacity)
                if capacity > length:
                    tree.put(capacity - length, seq)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*kept, "sequence_id", "offset"])

    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, json_path: str, rank_path: str, pattern: str, *, id_col: str = "doc_id",
         text_col: str = "text", window: int = 1024, end_id: int = 0,
         per_bucket: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack all rows of ``df``; one row per piece."""
    pieces = token_pieces(df, json_path, rank_path, pattern, id_col=id_col, text_col=text_col,
                          window=window, end_id=end_id, keep_ids=keep_ids)
    return pack_pieces(pieces, df.count(), window=window, per_bucket=per_bucket)
