"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit (logistic, on
hashed character 1- to 3-grams inside words) predicts that bit.  Decoding is
loss-weighted: a language's distance is the sum over bits of the bit's
reliability times the logistic loss of its predicted margin against the
codeword; the nearest codeword wins, and a text whose two nearest codewords are
closer than ``margin`` is flagged ambiguous.

The classifiers are fitted on a bounded sample (``per_language`` texts of each
language, whole texts); their n-gram counts are made on the executors.
Scoring reads whole texts: words are scored once per slice of a batch.

Defined cases: a null text or one without letters is ``und`` with score 0;
repeated rows get equal results; no training rows at all: every text is ``und``; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import bounded_sample, chunks, segment_sum, strings, word_table

FEATURES = 1 << 13
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def codewords(n: int) -> np.ndarray:
    """[n, bits] of +-1.  Up to 7 languages: all splits of the languages in two (63 of 7);
    beyond that 63 seeded random splits, no two equal or opposite (8 languages have 119 to draw from)."""
    if n <= 7:
        rows = [[1 if i and side >> (i - 1) & 1 else -1 for i in range(n)]
                for side in range(1, max(2, 1 << (n - 1)))]
        return np.array(rows, np.float32).T
    rng, rows = np.random.default_rng(n), set()
    while len(rows) < 63:
        row = rng.integers(0, 2, n) * 2 - 1
        if abs(row.sum()) <= n // 2:
            rows.add(tuple(row * row[0]))
    return np.array(sorted(rows), np.float32).T


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """([positions, 3] hashed n-gram buckets, start of each word): at every character
    of a word the 1-, 2- and 3-gram around it, blanks marking the word's ends."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner = np.flatnonzero(c != 32)
    here, before, after = c[inner] * _K[0], c[inner - 1] * _K[1], c[inner + 1] * _K[2]
    both = here + before
    h = np.stack([here + np.uint64(1), both + np.uint64(2), both + after + np.uint64(3)], axis=1) * _K[3]
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    return ((h ^ h >> np.uint64(29)) * _K[0] >> shift).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Ecoc:
    """A fitted model: languages, their codewords, one linear classifier per bit."""

    languages: list
    code: np.ndarray       # [languages, bits]
    weights: np.ndarray    # [FEATURES, bits]
    bias: np.ndarray       # [bits]
    trust: np.ndarray      # [bits], mean 1

    def margins(self, words: list[str], ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, bits] from a word table."""
        if not words:
            return np.tile(self.bias, (len(offsets) - 1, 1))
        per_word = np.empty((len(words), len(self.bias)), np.float32)
        chars = np.empty(len(words), np.float64)
        for at in range(0, len(words), 50_000):
            part = [w.lower() for w in words[at:at + 50_000]]
            bucket, starts = grams(part)
            summed = self.weights[bucket[:, 0]]
            summed += self.weights[bucket[:, 1]]
            summed += self.weights[bucket[:, 2]]
            per_word[at:at + len(part)] = segment_sum(summed, starts)
            chars[at:at + len(part)] = np.diff(starts)
        total = segment_sum(chars[ids], offsets)
        return segment_sum(per_word[ids].astype(np.float64), offsets) / np.maximum(total, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its probability, gap to the second)."""
        loss = np.stack([(self.trust * np.logaddexp(0, -margins * word)).sum(axis=1) for word in self.code], axis=1)
        order = np.sort(loss, axis=1)
        gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        share = np.exp(-(loss - order[:, :1]))
        return loss.argmin(axis=1), (share / share.sum(axis=1, keepdims=True)).max(axis=1), gap


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, relative counts / 3) of all n-grams of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    bucket, starts = grams(words)
    at, n = np.unique(bucket, return_counts=True)
    return at.astype(np.uint16), (n / starts[-1]).astype(np.float32)


def fit(languages: list, labels: np.ndarray, x: np.ndarray, steps: int = 200) -> Ecoc:
    """Fit the bit classifiers on rows ``x`` [n, FEATURES] with language indices; scales ``x`` in place."""
    code = codewords(len(languages))
    want = code[labels]
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-4)).astype(np.float32)
    x *= scale
    share = np.bincount(labels, minlength=len(languages)).astype(np.float32)
    row_weight = (1 / share[labels] / len(languages))[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2 = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        g = -want * row_weight / (1 + np.exp(want * z))
        for i, (p, grad) in enumerate(((w, x.T @ g + 1e-4 * w), (b, g.sum(axis=0)))):
            m1[i] = 0.9 * m1[i] + 0.1 * grad
            m2[i] = 0.99 * m2[i] + 0.01 * grad * grad
            p -= (0.1 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    wrong = (((x @ w + b) * want <= 0) * row_weight).sum(axis=0) + 0.01
    trust = np.log((1 - np.minimum(wrong, 0.49)) / np.minimum(wrong, 0.49))
    return Ecoc(languages, code, w * scale[:, None], b, trust / trust.mean())


def sample_profiles(rows: DataFrame) -> list:
    """[(lang, buckets, counts)] of a bounded frame (lang, text), counted on the executors."""
    def run(batches):
        for b in batches:
            got = [profile(t) for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array([g[0].tobytes() for g in got], pa.binary()),
                 pa.array([g[1].tobytes() for g in got], pa.binary())], names=["lang", "at", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, at binary, n binary").collect()


def fit_profiles(rows: list, languages: list | None = None, steps: int = 200) -> Ecoc | None:
    """Fit on (lang, buckets, counts) rows; ``languages``: sorted, those of the rows among them."""
    rows = sorted(rows)
    languages = sorted({r[0] for r in rows}) if languages is None else languages
    if not languages:
        return None
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r[1], np.uint16)] = np.frombuffer(r[2], np.float32)
    return fit(languages, np.array([languages.index(r[0]) for r in rows]), x, steps)


def from_sums(languages: list, sums: np.ndarray) -> Ecoc:
    """The mean of models over the same languages, from the sum of their (1, weights, bias, trust)
    times the texts of each."""
    code = codewords(len(languages))
    bits = code.shape[1]
    mean = (sums[1:] / sums[0]).astype(np.float32)
    return Ecoc(languages, code, mean[:FEATURES * bits].reshape(FEATURES, bits), mean[FEATURES * bits:][:bits], mean[-bits:])


def train(df: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", per_language: int = 600, total: int = 6000) -> Ecoc | None:
    """Fit on about ``per_language`` (``total`` over all languages, 200 MB on the driver) of the rows of ``df``
    for which ``usable`` holds and whose language is not null and text has a letter; None when there are none."""
    rows = df.filter(usable).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"),
                                    F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    return fit_profiles(sample_profiles(bounded_sample(rows, "lang", F.col("id"), per_language, total)))


def predict(df: DataFrame, model: Ecoc | None, *, id_col: str = "doc_id", text_col: str = "text",
            margin: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per row of ``df``."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, unsure = guess(held.value, strings(b.column("text")), margin)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def guess(model: Ecoc | None, texts: list[str], margin: float) -> tuple[list, list, list]:
    """(language, score, ambiguous) of each text."""
    langs, scores, unsure = [], [], []
    for a, z in chunks(texts):
        part = texts[a:z]
        if model is None:
            langs += ["und"] * len(part)
            scores += [0.0] * len(part)
            unsure += [False] * len(part)
            continue
        best, share, gap = model.decode(model.margins(*word_table([t.split() for t in part])))
        for t, i, s, g in zip(part, best, share, gap):
            known = any(map(str.isalpha, t))
            langs.append(model.languages[i] if known else "und")
            scores.append(float(s) if known else 0.0)
            unsure.append(bool(known and g < margin))
    return langs, scores, unsure


def identify(df: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_language: int = 600, margin: float = 0.5) -> DataFrame:
    """Train on the usable rows of ``df`` and predict all of its rows."""
    model = train(df, usable, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language)
    return predict(df, model, id_col=id_col, text_col=text_col, margin=margin)


def keep_known(df: DataFrame, model: Ecoc | None, *, text_col: str = "text", margin: float = 0.5,
               least: float = 0.4) -> DataFrame:
    """The rows of ``df``, all columns, but those that are ``und`` and those flagged
    ambiguous whose score is below ``least``.  Without a model no language is judged:
    only null texts and those without a letter go."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = strings(b.column(text_col))
            if held.value is None:
                yield b.filter(pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_()))
                continue
            lang, score, unsure = guess(held.value, texts, margin)
            yield b.filter(pa.array([x != "und" and not (u and s < least)
                                     for x, s, u in zip(lang, score, unsure)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
