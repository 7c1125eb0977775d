import math
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from autotab.llm import sp_sample, unigram

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(PATH)


def every(vocabulary, text, alpha):
    """{ids: probability} of all segmentations, by enumeration."""
    score = {vocabulary.pieces[i]: (i, s * alpha / 64) for i, s in enumerate(vocabulary.scores) if s}
    text = vocabulary.model.normalize(text)

    def rest(i):
        if i == len(text):
            yield (), 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in score:
                head = (score[text[i:j]][0],), score[text[i:j]][1]
            elif j == i + 1:
                head = tuple(vocabulary.bytes[b] for b in text[i].encode()), vocabulary.unknown * alpha / 64
            else:
                continue
            for ids, s in rest(j):
                yield head[0] + ids, head[1] + s

    found = dict(rest(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: s - total for ids, s in found.items()}


@pytest.mark.parametrize("near", [64, 1])
def test_draws_follow_the_distribution(vocabulary, monkeypatch, near):
    monkeypatch.setattr(sp_sample, "NEAR", near)
    text, n = "ab\nab", 12_000
    exact = every(vocabulary, text, 0.25)
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    drawn = sp_sample.sample_texts(vocabulary, [text] * n, keys, 3, 0.25)
    first, second = Counter(), Counter()
    for rows in drawn:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == 3 and rows[0][2] >= rows[1][2] >= rows[2][2]
        for i, r in zip(ids, rows):
            assert abs(exact[i] - r[1]) < 1e-9
        first[ids[0]] += 1
        second[ids[1]] += 1
    p = {i: math.exp(s) for i, s in exact.items()}
    after = {i: sum(p[j] * p[i] / (1 - p[j]) for j in p if j != i) for i in p}
    for seen, want in ((first, p), (second, after)):
        for i, q in want.items():
            assert abs(seen[i] - n * q) < 5 * math.sqrt(n * q) + 5


def test_all_segmentations_and_certain_inclusion(vocabulary):
    exact = every(vocabulary, "abab", 1.0)
    rows = sp_sample.sample_texts(vocabulary, ["abab"], np.array([7], np.uint64), 100, 1.0)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(exact)
    assert all(r[3] == 0.0 for r in rows)


def test_inclusion_scores_are_unbiased(vocabulary):
    """Horvitz-Thompson weights p / q estimate a total of 1."""
    keys = np.random.default_rng(2).integers(0, 2**63, 6000).astype(np.uint64)
    drawn = sp_sample.sample_texts(vocabulary, ["abab"] * 6000, keys, 2, 0.25)
    total = [sum(math.exp(r[1] - r[3]) for r in rows) for rows in drawn]
    assert abs(np.mean(total) - 1) < 5 * np.std(total) / math.sqrt(len(total))


def test_decoding_is_that_of_the_library(vocabulary):
    texts = ["Hello  world", " lead", "é 日本 😀\n\tx", "", "a" * 300, "▁x"]
    for rows, t in zip(sp_sample.sample_texts(vocabulary, texts, np.arange(6, dtype=np.uint64), 3, 0.2), texts):
        for ids, *_ in rows:
            assert vocabulary.decode(ids) == vocabulary.model.decode(ids.tolist()) == t.replace("▁", " ")


def test_documents_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(sp_sample.sample(docs, PATH, k=2).collect())
    b = sorted(sp_sample.sample(docs.repartition(7), PATH, k=2).collect())
    assert a == b and len(a) == 2 * docs.count() and all(r.decodes for r in a)
    back = sp_sample.decode(sp_sample.sample(docs, PATH, k=1), PATH).join(docs, "doc_id")
    assert back.filter("decoded = text").count() == docs.count()


def test_null_empty_repeated_and_no_rows(frame):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "x y"), (5, "word " * 30_000)]
    got = sp_sample.sample(frame(rows), PATH, k=2).collect()
    by = Counter(r.doc_id for r in got)
    assert by == {1: 1, 2: 1, 3: 4, None: 2, 5: 2} and all(r.decodes for r in got)
    assert len({(tuple(r.ids), r.perturbed) for r in got if r.doc_id == 3}) == 2
    assert sp_sample.sample(frame([]), PATH).count() == 0


def test_query_gives_four_whole_segmentations(spark, tmp_path):
    from autotab.llm import queries
    text = "the quick brown fox jumps over the lazy dog"
    spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_sentencepiece_topk(spark, str(tmp_path)).collect()
    first = [r for r in got if r.doc_id == 1]
    assert sorted(r.rank for r in first) == [1, 2, 3, 4] and len({tuple(r.ids) for r in first}) == 4
    assert all(r.decodes and len(r.ids) == r.n_pieces for r in got)
    assert [r.ids for r in got if r.doc_id == 2] == [[]]
