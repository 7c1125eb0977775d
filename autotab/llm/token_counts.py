"""Token counts by a count-only Viterbi pass.

Aho-Corasick enumerates the vocabulary matches of a text's distinct segments; the
dynamic program carries only the best score and the number of pieces behind it,
with the tokenizer's tie rules (``unigram.best_counts``).  No ids are made.

Defined cases: a null text is the empty text, which has no tokens; a character
outside the vocabulary counts one token per UTF-8 byte; repeated rows get equal
counts; an empty table gives no rows; other columns of the input are not read.
Working memory follows a slice of a batch, or the longest run without a blank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import chunks, segment_sum, strings, word_table
from autotab.llm.unigram import SLICE, UNITS, Vocabulary, best_counts, lattice, load


class Memory:
    """Values of recently used segments: two generations of at most ``limit`` entries
    (some 150 bytes each); using an old entry makes it young again."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, segments: list[str]) -> list[str]:
        """The segments without a value; the others are made young."""
        young, old, out = self.young, self.old, []
        for s in segments:
            if s not in young:
                if s in old:
                    young[s] = old[s]
                else:
                    out.append(s)
        return out

    def rest(self) -> None:
        """Between slices: a full young generation becomes the old one."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young


def slices(segments: list[str], limit: int = SLICE):
    """(start, end) runs of ``segments`` of about ``limit`` characters."""
    return chunks(segments, limit)


def count_texts(vocabulary: Vocabulary, texts: list[str], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, best score in units) of each text."""
    memory = memory or Memory()
    tokens, scores = [], []
    for a, z in chunks(texts, 2 * SLICE):
        words, ids, offsets = word_table([vocabulary.segments(t) for t in texts[a:z]])
        fresh = memory.missing(words)
        for i, j in slices(fresh):
            score, count = best_counts(lattice(vocabulary, fresh[i:j]))
            memory.young.update(zip(fresh[i:j], (score + 1j * count).tolist()))     # both exact below 2^53
        both = np.fromiter(map(memory.young.__getitem__, words), np.complex128, len(words))
        tokens.append(segment_sum(both.imag.astype(np.int64)[ids], offsets))
        scores.append(segment_sum(both.real.astype(np.int64)[ids], offsets))
        memory.rest()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(tokens), np.concatenate(scores)


def count_tokens(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) per row; ``score`` is the best path's log-probability."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vocabulary, memory = load(model_path), Memory()
        for b in batches:
            tokens, score = count_texts(vocabulary, strings(b.column("text")), memory)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(score / UNITS, pa.float64())],
                names=["doc_id", "n_tokens", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
