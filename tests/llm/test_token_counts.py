import random

import numpy as np
import public_tokenizers as P
import pytest

from autotab.llm import token_counts, unigram

from unigram_model import as_unigram

PATH = P.path("piece_bpe_32k.model")
RND = random.Random(4)
TEXTS = ["", " ", "   ", "a  b\n é ﬁ\t① ", "▁▁x ▁", "\0a\0 b", "日本語 😀 テスト", "x" * 3000, "Hello   world " * 40,
         "aaaa bbbb aaab abab"] + ["".join(RND.choices("abet  ▁é\n日", k=RND.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return as_unigram(PATH, vocabulary)


def test_counts_are_those_of_the_library(vocabulary, library):
    got, _ = token_counts.count_texts(vocabulary, TEXTS)
    assert got.tolist() == [len(library.encode(t)) for t in TEXTS]


def test_score_and_ties_against_plain_viterbi(vocabulary):
    scores = {vocabulary.pieces[i]: int(vocabulary.scores[i]) for i in range(len(vocabulary.pieces)) if vocabulary.scores[i]}
    for t in TEXTS[:60]:
        text = vocabulary.model.normalize(t)
        best = [(0, 0)] + [None] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 48) + 1):
                if text[i:j] in scores:
                    step = scores[text[i:j]], 1
                elif j == i + 1:
                    step = vocabulary.unknown, len(text[i].encode())
                else:
                    continue
                value = best[i][0] + step[0], best[i][1] + step[1]
                if best[j] is None or value[0] > best[j][0]:
                    best[j] = value
        tokens, score = token_counts.count_texts(vocabulary, [t])
        assert (score[0], tokens[0]) == best[-1]


def test_memory_changes_nothing(vocabulary):
    small = token_counts.Memory(limit=5)
    for t in TEXTS[:40] * 2:
        assert token_counts.count_texts(vocabulary, [t], small)[0] == token_counts.count_texts(vocabulary, [t])[0]


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(library.encode(r.text))


def test_null_empty_repeated_and_no_rows(frame):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "word " * 40_000)]
    got = token_counts.count_tokens(frame(rows), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[1:3] == [(1, 0), (2, 0)] and len(got) == 5
    assert token_counts.count_tokens(frame([]), PATH).count() == 0


def test_word_table_keeps_words_apart():
    from autotab.llm.common import word_table
    groups = [["ab", "ab\0c", "ab"], [], ["nan", "", "None"], ["ab\0d"]]
    words, ids, offsets = word_table(groups)
    assert [[words[i] for i in ids[a:b]] for a, b in zip(offsets, offsets[1:])] == groups
    groups = [["x", "y", "x"], ["nan", "None", ""]]
    words, ids, offsets = word_table(groups)
    assert [[words[i] for i in ids[a:b]] for a, b in zip(offsets, offsets[1:])] == groups


def test_scores_beyond_31_bits_stay_whole(vocabulary, monkeypatch):
    score, count = -3_221_225_550, 1_600_000
    monkeypatch.setattr(token_counts, "best_counts", lambda _: (np.array([score]), np.array([count])))
    got = token_counts.count_texts(vocabulary, ["xyz"])
    assert (got[0].tolist(), got[1].tolist()) == ([count], [score])
