"""SentencePiece segmentations sampled without replacement by Gumbel top-k.

Every segmentation of a text has its unigram probability; adding independent
Gumbel noise to the log-probabilities and taking the k largest draws k distinct
segmentations without replacement.  The noise is never drawn per segmentation:
a best-first (A*) search over the lattice keeps sets of segmentations that share
a prefix, each with the largest perturbed value inside it, which is itself a
Gumbel variable at the set's log-mass, truncated by the value of the set it came from.
Popping the best set draws the segmentation that has that value (backward
log-sums give the exact conditional probabilities) and splits what is left of the set
at every step of the drawn path.

The inclusion score of a drawn segmentation is the log-probability that its
perturbed value exceeds the (k+1)-th largest, the threshold of the usual
Horvitz-Thompson weights.

All randomness is a hash of the row key, the sample's rank and the place in
the text, so results do not depend on partitions or batches.

Defined cases: a null text is the empty text, whose only segmentation is the
empty one; a text with fewer than k segmentations gives them all, with inclusion score
0 (certain); repeated rows with one id draw the same samples; a null id is hashed as a value of its own;
an empty table gives no rows; other columns of the input are not read.
Working memory follows a slice of a batch, or the longest text.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import MASK64, chunks, mix, strings, uniform, word_table
from autotab.llm.unigram import MARK, UNITS, Lattice, Vocabulary, heads, lattice, levels, load, sorted_by

_STEP, _RANK, _PLACE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_FAR = -math.inf
#: Stands for the log-mass of nothing; perturbed values below half of it are no sets.
_NONE = -1e300
#: Probabilities are compared as integers of this many bits, so sums do not
#: depend on what else is in a slice.
_BITS = 40
#: Steps whose sets are kept one by one; those further on form one set until it is popped.
NEAR = 64
#: Characters sampled together in a task.
SLICE_CHARS = 2_000_000


def _times(n: int, factor: int) -> np.uint64:
    return np.uint64(n * factor & MASK64)


class Chain:
    """Conditional edge probabilities of a lattice, edges sorted by start position."""

    def __init__(self, lat: Lattice, alpha: float, byte_ids: np.ndarray):
        order = sorted_by(lat.start)
        self.start, self.end = lat.start[order], lat.end[order]
        self.piece, self.width, self.raw = lat.piece[order], lat.width[order], lat.raw
        byte = np.flatnonzero((self.piece < 0) & (self.width == 1))
        self.piece[byte] = byte_ids[lat.raw[self.start[byte]]]
        score = lat.score[order] * (alpha / UNITS)
        finish = np.zeros(lat.positions + 1, np.int64)
        finish[lat.begin] = lat.finish
        self.finish = np.maximum.accumulate(finish)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.start, minlength=lat.positions))])
        beta = np.zeros(lat.positions)
        p = np.empty(len(score))
        for edges in levels(self.finish[self.start] - self.start):
            value = score[edges] + beta[self.end[edges]]
            start = self.start[edges]
            run = heads(start)
            own = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(edges))))
            top = np.maximum.reduceat(value, run)
            part = np.exp(value - top[own])
            total = np.add.reduceat(part, run)
            beta[start[run]] = top + np.log(total)
            p[edges] = part / total[own]
        self.log_p = score + beta[self.end] - beta[self.start]
        self.p = p
        units = (p * float(1 << _BITS)).astype(np.int64)
        upto = np.cumsum(units)
        self.upto = upto - (upto - units)[self.first[self.start]]
        self.upto[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = 1 << _BITS

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Completions from one position per place: (edges, offset of each place's edges)."""
        goal = self.finish[node]
        live, step, taken = np.flatnonzero(node != goal), 0, []
        node = node.copy()
        count = np.zeros(len(node), np.int64)
        while len(live):
            u = (mix(key[live] + _times(step, _STEP)) >> np.uint64(64 - _BITS)).astype(np.int64)
            edge = self.first[node[live]]
            beyond = np.flatnonzero(u >= self.upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= self.upto[edge[beyond]]]
            taken.append((live, edge))
            node[live] = self.end[edge]
            count[live] += 1
            live = live[node[live] != goal[live]]
            step += 1
        offset = np.concatenate([[0], np.cumsum(count)])
        edges = np.empty(offset[-1], np.int64)
        for step, (live, edge) in enumerate(taken):
            edges[offset[live] + step] = edge
        return edges, offset

    def others(self, edges: np.ndarray) -> np.ndarray:
        """Log-mass of the other edges of each edge's node; never quite nothing while
        there are others."""
        start = self.start[edges]
        rest = np.log(np.maximum(1 - self.p[edges], 1e-30))
        rest[self.first[start + 1] - self.first[start] == 1] = _NONE
        return rest

    def ids(self, edges: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Piece ids of a path; an unknown character of several bytes gives an id for each."""
        piece = self.piece[edges]
        if not len(piece) or piece.min() >= 0:
            return piece
        width = self.width[edges]
        out = np.repeat(piece, width)
        byte = np.flatnonzero(out < 0)
        inner = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        out[byte] = vocabulary.byte_ids[self.raw[(np.repeat(self.start[edges], width) + inner)[byte]]]
        return out


def _truncated(log_mass, bound, noise):
    """Largest perturbed values of sets of the given log-mass below ``bound``; ``noise`` is the
    logarithm of unit exponentials."""
    return -np.logaddexp(-bound, noise - log_mass)


def _noise(key: np.ndarray) -> np.ndarray:
    return np.log(-np.log(uniform(mix(key))))


def _noises(keys: np.ndarray, rank: int) -> np.ndarray:
    """[texts, NEAR + 2] noise for the sets that a draw of this rank leaves: one for each near
    step, one for the far steps, one for the node it left its parent at."""
    base = mix(keys + _times(rank, _RANK) + _times(2, _PLACE))
    return _noise(base[:, None] + np.arange(NEAR + 2, dtype=np.uint64) * _times(1, _STEP))


def _keys(key: np.uint64, rank: int, salt: int, n: int = 1) -> np.ndarray:
    """``n`` hash inputs for one purpose (``salt``) of one drawn path."""
    return mix(key + _times(rank, _RANK) + _times(salt, _PLACE) + np.arange(n, dtype=np.uint64) * _times(1, _STEP))


class Search:
    """The frontier of one text: drawn paths and the sets left beside their steps.

    ``value`` of a path holds the perturbed maxima of the sets beside its first
    steps and, last, of all sets beside the steps from ``near`` on.
    """

    def __init__(self, chain: Chain, key: np.uint64):
        self.chain, self.key = chain, np.array([key], np.uint64)
        self.paths: list[dict] = []
        self.barred: dict = {}      # (path, step) -> edges already taken at that node

    def add(self, head, edges, log_p0, bound, where, noise):
        """A drawn path: ``head`` is (parent, step, edge, barred edges) or None for the
        first; ``edges`` follow the head's edge, ``log_p0`` is the log-mass up to them."""
        rank, chain = len(self.paths), self.chain
        since = 0 if head is None else head[1] + 1
        n = min(len(edges), NEAR)
        log_p = chain.log_p[edges]
        upto = log_p0 + np.cumsum(log_p[:n])
        total = log_p0 + float(log_p.sum())
        value = np.full(since + n + 1, _FAR)
        value[since:-1] = _truncated(upto - log_p[:n] + chain.others(edges[:n]), bound, noise[:n])
        if len(edges) > n:
            far = upto[-1] + math.log(-math.expm1(min(total - upto[-1], -1e-30)))
            value[-1] = _truncated(far, bound, noise[-2])
        if head is not None:
            parent, step, edge, barred = head
            lo, hi = chain.first[chain.start[edge]], chain.first[chain.start[edge] + 1]
            open_ = [e for e in range(lo, hi) if e not in barred]
            if open_:
                mass = log_p0 - chain.log_p[edge] + np.log(max(chain.p[open_].sum(), 1e-300))
                value[step] = _truncated(mass, bound, noise[-1])
            self.barred[rank, step] = barred
            edges = np.concatenate([self.paths[parent]["edges"][:step], [edge], edges])
        self.paths.append({"edges": edges, "value": value, "bound": bound, "log_p": total, "where": where})

    def best(self):
        """(value, path, step) of the best set, or None."""
        found = None
        for i, p in enumerate(self.paths):
            t = int(p["value"].argmax())
            if p["value"][t] > _NONE / 2 and (found is None or p["value"][t] > found[0]):
                found = float(p["value"][t]), i, t
        return found

    def pop(self, value, path, step):
        """Take the best set: (its step, first edge, the edges barred now, log-mass with
        that edge)."""
        chain, p, rank = self.chain, self.paths[path], len(self.paths)
        log_p = chain.log_p[p["edges"]]
        prefix = np.cumsum(log_p) - log_p
        if step == len(p["value"]) - 1:     # the far steps: one holds the value, the others less
            mass = prefix[step:] + chain.others(p["edges"][step:])
            share = np.cumsum(np.exp(mass - mass.max()))
            u = uniform(_keys(self.key, rank, 6))[0]
            beside = _truncated(mass, value, _noise(_keys(self.key, rank, 7, len(mass))))
            p["value"] = np.concatenate([p["value"][:step], beside, [_FAR]])
            step += min(int(np.searchsorted(share, u * share[-1], side="right")), len(mass) - 1)
        p["value"][step] = _FAR
        used = p["edges"][step]
        barred = self.barred.get((path, step), frozenset()) | {int(used)}
        lo, hi = chain.first[chain.start[used]], chain.first[chain.start[used] + 1]
        open_ = np.array([e for e in range(lo, hi) if e not in barred])
        share = np.cumsum(np.exp(chain.log_p[open_] - chain.log_p[open_].max()))
        u = uniform(_keys(self.key, rank, 4))[0]
        edge = int(open_[min(int(np.searchsorted(share, u * share[-1], side="right")), len(open_) - 1)])
        return step, edge, barred | {edge}, float(prefix[step] + chain.log_p[edge])


def sample_texts(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int, alpha: float = 1.0) -> list:
    """Per text a list of (ids, log_prob, perturbed, log_inclusion) in order of rank."""
    return sample_normal(vocabulary, [vocabulary.model.normalize(t) for t in texts], keys, k, alpha)


def sample_normal(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int, alpha: float = 1.0) -> list:
    """``sample_texts`` of normalised texts."""
    words, ids, offsets = word_table([vocabulary.split(t) for t in texts])
    lat = lattice(vocabulary, words or [MARK])
    chain = Chain(lat, alpha, vocabulary.byte_ids)
    begin = lat.begin[ids]
    place = (np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64) * _times(1, _PLACE)
    searches = [Search(chain, key) for key in keys]

    def draw(rank, which, nodes, text_of):
        return chain.walk(nodes, mix(mix(keys + _times(rank, _RANK))[text_of] + place[which]))

    edges, step_at = draw(0, np.arange(len(ids)), begin, np.repeat(np.arange(len(texts)), np.diff(offsets)))
    noise = _noises(keys, 0)
    bound = -_noise(mix(keys + _times(1, _PLACE)))    # the largest value of all: a Gumbel variable
    for i, s in enumerate(searches):
        lo, hi = offsets[i], offsets[i + 1]
        s.add(None, edges[step_at[lo]:step_at[hi]], 0.0, bound[i], (lo, step_at[lo:hi + 1] - step_at[lo]), noise[i])
    for rank in range(1, k):
        popped = []
        for i, s in enumerate(searches):
            top = s.best()
            if top is not None:
                popped.append((i, top, *s.pop(*top)))
        if not popped:
            break
        # the place of the step that is replaced; the drawing goes on from there
        froms = []
        for i, top, step, *_ in popped:
            first, steps = searches[i].paths[top[1]]["where"]
            froms.append(first + int(np.searchsorted(steps, step, side="right")) - 1)
        size = offsets[1:][[i for i, *_ in popped]] - froms
        bounds = np.concatenate([[0], np.cumsum(size)])
        which = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - froms, size)
        nodes = begin[which]
        nodes[bounds[:-1]] = chain.end[[edge for _, _, _, edge, *_ in popped]]
        edges, step_at = draw(rank, which, nodes, np.repeat([i for i, *_ in popped], size))
        noise = _noises(keys, rank)
        for n, (i, top, step, edge, barred, log_p0) in enumerate(popped):
            lo, hi = bounds[n], bounds[n + 1]
            first, steps = searches[i].paths[top[1]]["where"]
            own = step_at[lo + 1:hi + 1] - step_at[lo] + step + 1
            where = first, np.concatenate([steps[:froms[n] - first + 1], own])
            searches[i].add((top[1], step, edge, barred), edges[step_at[lo]:step_at[hi]], log_p0, top[0], where,
                            noise[i])
    out = []
    for s in searches:
        rest, rows = s.best(), []
        for p in s.paths:
            x = p["log_p"] - rest[0] if rest else math.inf
            sure = 0.0 if x > 3 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            rows.append((chain.ids(p["edges"], vocabulary), p["log_p"], p["bound"], sure))
        out.append(rows)
    return out


def sample(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2,
           alpha: float = 1.0, seed: int = 1, keep_ids: bool = True) -> DataFrame:
    """(doc_id, rank, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, decodes) per row and
    drawn segmentation, best perturbed value first, and ``ids`` when kept.  ``decodes`` tells
    whether the ids give back the normalised text."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"))
    kind = src.schema["doc_id"].dataType.simpleString()
    fields = (("rank", "int", pa.int32()), ("n_pieces", "long", pa.int64()), ("ids_crc32", "long", pa.int64()),
              ("log_prob", "double", pa.float64()), ("perturbed", "double", pa.float64()),
              ("log_inclusion", "double", pa.float64()), ("decodes", "boolean", pa.bool_()))
    if keep_ids:
        fields += (("ids", "array<int>", pa.list_(pa.int32())),)

    def run(batches):
        vocabulary = load(model_path)
        for b in batches:
            texts = strings(b.column("text"))
            keys = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for at, until in chunks(texts, SLICE_CHARS):
                which, rows = [], []
                normal = [vocabulary.model.normalize(t) for t in texts[at:until]]
                for i, drawn in enumerate(sample_normal(vocabulary, normal, keys[at:until], k, alpha), at):
                    plain = normal[i - at].replace(MARK, " ")
                    plain = plain[1:] if plain[:1] == " " else plain
                    for rank, (ids, log_p, value, sure) in enumerate(drawn):
                        which.append(i)
                        rows.append((rank + 1, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log_p, value, sure,
                                     vocabulary.decode(ids) == plain, *([ids.astype(np.int32)] * keep_ids)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(which, pa.int64()))]
                    + [pa.array([r[j] for r in rows], f[2]) for j, f in enumerate(fields)],
                    names=["doc_id", *[f[0] for f in fields]])

    return src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def decode(df: DataFrame, model_path: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its piece ids (null for null ids)."""
    schema = df.withColumn("decoded", F.lit(None).cast("string")).schema

    def run(batches):
        vocabulary = load(model_path)
        for b in batches:
            text = [None if ids is None else vocabulary.decode(np.array(ids, np.int64)) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) if c != "decoded" else pa.array(text, pa.string()) for c in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)
