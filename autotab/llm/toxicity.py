"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of four rows, looked up by the two halves of its
hash and the two halves of its stem's hash (the first ``STEM`` letters), so two
words share a part only if both halves agree.  Filters of
several widths run over the word sequence, each filter's largest response over
the whole text is kept, and a logistic layer scores the maxima.

Embeddings start from the training log-odds of their words; rows that fewer
than ``SEEN`` training texts touch keep the zero embedding.  The model is fitted on all
labelled texts, whole: they are dealt into blocks by the id, every epoch each block
goes through its texts in a task of its own, and the steps the blocks took are averaged
(per embedding row, weighted by how often a block moved it).  A threshold is then calibrated
per language on the texts kept aside, from counts of their logits in steps of 1/``STEPS``; the
language is guessed from the text by language-ID classifiers fitted on runs of all labelled
texts and averaged.  The score is shifted so that 0.5 is the threshold.

Defined cases: a null or empty text has no words and gets the score of all
responses at rest, 0.49 at most; repeated rows get equal scores; without labelled rows of
both classes every score is 0; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autotab.llm import langid
from autotab.llm.common import chunks, strings, word_table

WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 8
ROWS = 1 << 16
STEM = 4
TABLES = 4
SEEN = 3
BLOCK_TEXTS = 1024       # labelled texts of a block, more when there would be over BLOCKS of them
BLOCKS = 32
LANGUAGE_TEXTS = 512     # texts of one fit of the language classifiers
LANGUAGE_STEPS = 50
STEPS = 256              # of a logit, in the counts that thresholds are taken from
PIECE = 1 << 14          # parameter rows summed together
EDGES = ".,;:!?\"'()[]{}<>|*"


def word_codes(words: list[str]) -> np.ndarray:
    """[words, 4] embedding rows: the halves of the 32-bit hashes of the lower-cased word
    without the punctuation at its ends, and of its stem."""
    plain = [w.lower().strip(EDGES) for w in words]
    both = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in part), np.uint32, len(words))
            for part in (plain, (w[:STEM] + "-" for w in plain))]
    return np.stack([h for c in both for h in (c & 0xFFFF, c >> 16)], axis=1).astype(np.uint16)


@dataclass
class Cnn:
    """Parameters; ``shift`` holds the threshold (a logit) of every language."""

    tables: list        # 4 of [ROWS, SIZE]
    filters: list       # per width: [width, SIZE, FILTERS]
    bias: list          # per width: [FILTERS]
    out: np.ndarray     # [len(WIDTHS) * FILTERS + 1], the last is the bias
    shift: dict = field(default_factory=dict)
    language: langid.Ecoc | None = None

    def embed(self, codes: np.ndarray) -> np.ndarray:
        return sum(t[codes[:, i]] for i, t in enumerate(self.tables))

    def responses(self, per_offset: list, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, widths * FILTERS] largest rectified responses; ``per_offset`` holds per
        width and offset the distinct words' products with the filters."""
        n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, len(WIDTHS) * FILTERS), np.float32)
        for k, width in enumerate(WIDTHS):
            total = len(ids) - width + 1
            if total <= 0:
                continue
            conv = per_offset[k][0][ids[:total]].copy()
            for j in range(1, width):
                conv += per_offset[k][j][ids[j:j + total]]
            conv += self.bias[k]
            first, last = offsets[:-1], offsets[1:] - width + 1
            full = last > first
            if full.any():
                # windows that reach over a text's end are skipped through paired bounds
                bounds = np.stack([first[full], np.minimum(last[full], total)], axis=1).ravel()
                padded = np.concatenate([conv, np.zeros((1, FILTERS), np.float32)])
                out[np.flatnonzero(full), k * FILTERS:(k + 1) * FILTERS] = np.maximum(
                    np.maximum.reduceat(padded, bounds, axis=0)[::2], 0)
        return out

    def logits(self, codes: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        e = self.embed(codes)
        per_offset = [[e @ f[j] for j in range(len(f))] for f in self.filters]
        return self.responses(per_offset, ids, offsets) @ self.out[:-1] + self.out[-1]

    def score(self, texts: list[str]) -> np.ndarray:
        """Score in 0..1 of each whole text; 0.5 is its language's threshold."""
        out = []
        for a, z in chunks(texts):
            words, ids, offsets = word_table([t.split() for t in texts[a:z]])
            logit = self.logits(word_codes(words), ids, offsets)
            cut = np.full(len(logit), self.shift.get(None, 0.0))
            if self.language is not None:
                best = self.language.decode(self.language.margins(words, ids, offsets))[0]
                cut = np.array([self.shift.get(self.language.languages[i], self.shift.get(None, 0.0)) for i in best])
            score = 1 / (1 + np.exp(-np.clip(logit - cut, -30, 30)))
            out.append(np.where(np.diff(offsets) > 0, score, np.minimum(score, 0.49)))
        return np.concatenate(out) if out else np.zeros(0)


#: Rows of ``SIZE`` parameters: the tables, then filters and bias of every width, then the last layer.
LAST = -(-(len(WIDTHS) * FILTERS + 1) // SIZE)
PARAMETERS = TABLES * ROWS + sum(w * FILTERS + -(-FILTERS // SIZE) for w in WIDTHS) + LAST


def network(p: np.ndarray) -> Cnn:
    """The net whose parameters are views of the rows of ``p`` [PARAMETERS, SIZE]."""
    def take(shape):
        nonlocal at
        n = math.prod(shape)
        rows, at = p[at:at + -(-n // SIZE)], at + -(-n // SIZE)
        return rows.reshape(-1)[:n].reshape(shape)

    at = 0
    tables = [take((ROWS, SIZE)) for _ in range(TABLES)]
    filters = [take((w, SIZE, FILTERS)) for w in WIDTHS]
    return Cnn(tables, filters, [take((FILTERS,)) for _ in WIDTHS], take((len(WIDTHS) * FILTERS + 1,)))


def start(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First parameters: embeddings from the log-odds of training words, small random filters.
    ``seen`` [TABLES * ROWS, 2] holds the training texts of either class that touch a row, ``n`` all of them."""
    rng = np.random.default_rng(3)
    p = np.zeros((PARAMETERS, SIZE), np.float32)
    net = network(p)
    odds = np.log((seen[:, 1] + 1) / (n[1] + 2)) - np.log((seen[:, 0] + 1) / (n[0] + 2))
    known = known_rows(seen)
    p[:TABLES * ROWS, 0] = np.where(known, odds / 4, 0)
    p[:TABLES * ROWS][known, 1:] = rng.normal(0, 0.02, (int(known.sum()), SIZE - 1))
    for f in net.filters:
        f += rng.normal(0, 0.1, f.shape).astype(np.float32)
        f[:, 0, :] += 0.3 / len(f)
    net.out[:-1], net.out[-1] = 0.1, -1.0
    return p


def known_rows(seen: np.ndarray) -> np.ndarray:
    return seen.sum(axis=1) >= SEEN


class Learner:
    """Adagrad over the parameters; the gradient of a filter's maximum reaches the words of its
    winning window only.  ``moves`` counts the steps that changed a row."""

    def __init__(self, p: np.ndarray, squares: np.ndarray, known: np.ndarray, rate: float = 0.05):
        self.p, self.squares, self.known, self.rate = p.copy(), squares.copy(), known.reshape(TABLES, ROWS), rate
        self.net, self.state, self.moves = network(self.p), network(self.squares), np.zeros(len(p), np.float32)

    def _step(self, p, s, grad):
        s += grad * grad
        p -= self.rate * grad / np.sqrt(s)

    def learn(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """One step on a few texts ([words, TABLES] embedding rows each)."""
        net, state = self.net, self.state
        docs = [d if len(d) else np.zeros((1, TABLES), np.uint16) for d in docs]
        codes = np.concatenate(docs)
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        e = net.embed(codes)
        top = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros(top.shape, np.int64)
        for k, width in enumerate(WIDTHS):
            if len(codes) < width:
                continue
            conv = sum(e[j:len(e) - width + 1 + j] @ net.filters[k][j] for j in range(width)) + net.bias[k]
            for i in range(len(docs)):
                own = conv[offsets[i]:offsets[i + 1] - width + 1]
                if len(own):
                    best = own.argmax(axis=0)
                    where[i, k * FILTERS:(k + 1) * FILTERS] = best + offsets[i]
                    top[i, k * FILTERS:(k + 1) * FILTERS] = own[best, np.arange(FILTERS)]
        hidden = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-(hidden @ net.out[:-1] + net.out[-1])))
        g = ((p - y) / len(docs)).astype(np.float32)
        back = (g[:, None] * net.out[:-1]) * (top > 0)
        self._step(net.out, state.out, np.concatenate([hidden.T @ g, [g.sum()]]).astype(np.float32) + 1e-4 * net.out)
        ge = np.zeros_like(e)
        for k, width in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            gf = np.zeros_like(net.filters[k])
            for f in range(FILTERS):
                w, rows = back[:, cols][:, f], where[:, cols][:, f]
                for j in range(width):
                    r = np.minimum(rows + j, len(e) - 1)
                    gf[j, :, f] = e[r].T @ w
                    np.add.at(ge, r, w[:, None] * net.filters[k][j, :, f])
            self._step(net.bias[k], state.bias[k], back[:, cols].sum(axis=0))
            self._step(net.filters[k], state.filters[k], gf)
        self.moves[TABLES * ROWS:] += 1
        touched = np.flatnonzero(np.abs(ge).sum(axis=1))
        for i, table in enumerate(net.tables):
            own = touched[self.known[i][codes[touched, i]]]
            rows, back_to = np.unique(codes[own, i], return_inverse=True)
            grad = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(grad, back_to, ge[own])
            squares = state.tables[i][rows] + grad * grad
            state.tables[i][rows] = squares
            table[rows] -= self.rate * grad / np.sqrt(squares)
            self.moves[i * ROWS:(i + 1) * ROWS][rows] += 1


def _rows(batches):
    """(block, embedding rows of the words, label) of every text."""
    for b in batches:
        for block, words, y in zip(*(b.column(c).to_pylist() for c in ("block", "words", "y"))):
            yield block, np.frombuffer(words, np.uint16).reshape(-1, TABLES), y


def _pieces(block: int, rows: np.ndarray, values: np.ndarray):
    """Values of some parameter rows, cut up for ``_totals``."""
    for piece in np.unique(rows // PIECE).tolist():
        own = rows // PIECE == piece
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece], pa.int32()), pa.array([block], pa.int32()),
             pa.array([(rows[own] % PIECE).astype(np.int32).tobytes()], pa.binary()),
             pa.array([values[own].astype(np.float32).tobytes()], pa.binary())], names=["piece", "block", "at", "v"])


def _totals(texts: DataFrame, run, width: int) -> np.ndarray:
    """[PARAMETERS, width] sums over the blocks of what ``run`` makes of their texts with ``_pieces``."""
    def add(found):
        total = np.zeros((PIECE, width))
        for _, at, v in sorted(zip(*(found.column(c).to_pylist() for c in ("block", "at", "v")))):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(v, np.float32).reshape(-1, width)
        rows = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        return pa.table({"piece": found.column("piece")[:1], "at": pa.array([rows.tobytes()], pa.binary()),
                         "v": pa.array([total[rows].tobytes()], pa.binary())})

    out = np.zeros((PARAMETERS, width))
    for r in (texts.select("block", "words", "y").mapInArrow(run, "piece int, block int, at binary, v binary")
              .groupBy("piece").applyInArrow(add, "piece int, at binary, v binary").collect()):
        out[r.piece * PIECE + np.frombuffer(r.at, np.int32)] = np.frombuffer(r.v).reshape(-1, width)
    return out


def _count_rows(batches):
    """Texts of either class that touch a row of the tables, per block."""
    for block, rows in groupby(_rows(batches), lambda r: r[0]):
        seen = np.zeros((TABLES * ROWS, 2), np.float32)
        for _, codes, y in rows:
            for i in range(TABLES):
                seen[i * ROWS:(i + 1) * ROWS][np.unique(codes[:, i]), y] += 1
        at = np.flatnonzero(seen.any(axis=1))
        yield from _pieces(block, at, seen[at])


def fit(texts: DataFrame, n: np.ndarray, epochs: int = 5, batch: int = 32) -> np.ndarray:
    """Parameters learnt from all rows of ``texts`` (block, words, y), which lie block by block;
    ``n`` holds their number per class."""
    context = texts.sparkSession.sparkContext
    seen = _totals(texts, _count_rows, 2)[:TABLES * ROWS]
    known = known_rows(seen)
    p = start(seen, n)
    squares = np.full_like(p, 1e-3)
    for _ in range(epochs):
        now = context.broadcast((p, squares, known))

        def run(batches):
            p0, s0, used = now.value
            for block, rows in groupby(_rows(batches), lambda r: r[0]):
                learner = Learner(p0, s0, used)
                while part := list(islice(rows, batch)):
                    learner.learn([r[1] for r in part], np.array([r[2] for r in part]))
                at = np.flatnonzero(learner.moves)
                w = learner.moves[at, None]
                yield from _pieces(block, at, np.concatenate(
                    [w, w * (learner.p[at] - p0[at]), w * (learner.squares[at] - s0[at])], axis=1))

        total = _totals(texts, run, 1 + 2 * SIZE)
        step = total[:, 1:] / np.maximum(total[:, :1], 1)
        p, squares = (p + step[:, :SIZE]).astype(np.float32), (squares + step[:, SIZE:]).astype(np.float32)
        now.destroy()
    return p


def threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the fewest weighted errors, midway between the logits beside it
    (of equally good cuts the middle one)."""
    order = np.argsort(logit)
    s, pos = logit[order], (y[order] * weight[order])
    neg = weight[order] - pos
    errors = np.concatenate([[0], np.cumsum(pos)]) + (neg.sum() - np.concatenate([[0], np.cumsum(neg)]))
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    allowed = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = np.flatnonzero(allowed & (errors <= errors[allowed].min() + 1e-9))
    low, high = edges[best[0]], edges[best[-1]]
    return float((low + high) / 2)


def train(df: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", label_col: str = "toxic", aside: float = 0.25, least: int = 20) -> Cnn | None:
    """Fit on all labelled texts.  ``labels`` has the id and the label (0 or 1; repeated ids: the larger);
    ``usable`` is a condition on its id column.  ``aside`` of the texts calibrate the thresholds; a language
    with fewer than ``least`` of either class there takes the common one."""
    marked = (labels.filter(usable).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    n_marked = marked.count()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     F.col(lang_col).cast("string").alias("lang"))
    langs = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\S")).select("id", "lang")
    languages = sorted(r[0] for r in langs.join(marked, "id").select("lang").distinct().collect())
    # texts and labels meet in as many tasks as there are blocks: one move of the texts, and no list of ids sent to all tasks
    blocks = min(BLOCKS, max(1, math.ceil(n_marked / BLOCK_TEXTS)))
    rows = (rows.repartition(blocks, "id").join(marked.repartition(blocks, "id").hint("shuffle_hash"), "id")
            .select("id", "text", "lang", "y", F.xxhash64(F.lit(17), F.col("id")).alias("key"), F.spark_partition_id().alias("block"),
                    (F.pmod(F.xxhash64(F.lit(29), F.col("id")), F.lit(1000)) < 1000 * aside).alias("aside"))
            .sortWithinPartitions("key", "id", "text", "lang"))
    held = rows.mapInArrow(lambda batches: _encoded(batches, languages),
                           "block int, lang string, y int, aside boolean, words binary").persist()
    try:
        return _train(held, languages, least)
    finally:
        held.unpersist()


def _encoded(batches, languages: list):
    """Every text as the embedding rows of its words; and, in a row without label, the language classifiers
    fitted on runs of the texts, times the texts."""
    total, run = None, []

    def flush():
        nonlocal total, run
        m = langid.fit_profiles(run, languages, LANGUAGE_STEPS)
        part = np.concatenate([[1], m.weights.ravel(), m.bias, m.trust]) * len(run)
        total, run = part if total is None else total + part, []

    for b in batches:
        texts, lang = strings(b.column("text")), b.column("lang").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("block"), b.column("lang"), b.column("y"), b.column("aside"),
             pa.array([word_codes(t.split()).tobytes() for t in texts], pa.binary())],
            names=["block", "lang", "y", "aside", "words"])
        for t, name in zip(texts, lang):
            at, n = langid.profile(t) if name is not None else ((), ())
            if len(at) and name in languages:
                run.append((name, at.tobytes(), n.tobytes()))
                if len(run) == LANGUAGE_TEXTS:
                    flush()
    if run:
        flush()
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int32()), pa.array([None], pa.string()), pa.array([None], pa.int32()),
             pa.array([None], pa.bool_()), pa.array([total.astype(np.float32).tobytes()], pa.binary())],
            names=["block", "lang", "y", "aside", "words"])


def _train(held: DataFrame, languages: list, least: int) -> Cnn | None:
    texts = held.filter("y IS NOT NULL")
    size = {(r.aside, r.y): r["count"] for r in texts.groupBy("aside", "y").count().collect()}
    if len({y for _, y in size}) < 2:
        return None
    net = network(fit(texts.filter("NOT aside"), np.array([size.get((False, y), 0) for y in (0, 1)])))
    sums = [np.frombuffer(r.words, np.float32) for r in held.filter("y IS NULL").select("words").collect()]
    if sums:
        net.language = langid.from_sums(languages, np.sum(sums, axis=0, dtype=np.float64))

    kept = texts.filter("aside")
    counted = (kept.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("y").alias("n1"), F.count("y").alias("n"))
               .filter((F.col("n1") >= least) & (F.col("n") - F.col("n1") >= least)).select("lang").collect())
    own = sorted(r.lang for r in counted)
    now = held.sparkSession.sparkContext.broadcast(net)

    def logits(batches):
        for b in batches:
            codes = [np.frombuffer(w, np.uint16).reshape(-1, TABLES) for w in b.column("words").to_pylist()]
            value = np.array([now.value.logits(c, np.arange(len(c)), np.array([0, len(c)]))[0] for c in codes])
            at = np.floor(np.clip(value, -32, 31.999) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(at)], names=["lang", "y", "at"])

    found = (kept.select("lang", "y", "words").mapInArrow(logits, "lang string, y int, at int")
             .groupBy(F.when(F.col("lang").isin(own), F.col("lang")).alias("lang"), "y", "at").count().collect())
    s = np.array([(r["at"] + 0.5) / STEPS for r in found])
    y, n = (np.array([r[c] for r in found], np.int64) for c in ("y", "count"))
    name = np.array([r.lang for r in found], object)
    net.shift[None] = threshold(s, y, n) if len(set(y.tolist())) == 2 else 0.0
    for lang in own:
        net.shift[lang] = threshold(s[name == lang], y[name == lang], n[name == lang])
    now.destroy()
    return net


def predict(df: DataFrame, net: Cnn | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``df``."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            texts = strings(b.column("text"))
            score = held.value.score(texts) if held.value is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())],
                                             names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(df: DataFrame, net: Cnn | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose score is below 0.5."""
    held = df.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            if held.value is None:
                yield b
            else:
                yield b.filter(pa.array(held.value.score(strings(b.column(text_col))) < 0.5))

    return df.mapInArrow(run, df.schema)
