import random
import signal
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from autotab.llm import langid
from autotab.llm.common import fold_of

VOICES = {"aa": "abcde", "bb": "efghi", "cc": "ijklm", "dd": "mnopa"}


def texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(VOICES))
        words = ["".join(rnd.choices(VOICES[lang], k=rnd.randint(2, 6))) for _ in range(rnd.randint(3, 40))]
        out.append((i, " ".join(words), lang))
    return out


def test_codewords_are_apart():
    for n in (1, 2, 4, 6, 9, 30):
        code = langid.codewords(n)
        for a, b in combinations(range(n), 2):
            assert (code[a] != code[b]).sum() >= (code.shape[1] + 1) // 4


def test_codewords_of_every_small_number_of_languages():
    def late(*_):
        raise TimeoutError("codewords() does not end")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        for n in range(1, 13):
            code = langid.codewords(n)
            assert code.shape == (n, min(63, max(1, 2 ** (n - 1) - 1)))
            for a, b in combinations(range(n), 2):
                assert (code[a] != code[b]).sum() >= (code.shape[1] + 1) // 4
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_margins_against_plain_counting():
    rng = np.random.default_rng(1)
    model = langid.Ecoc(["x", "y"], langid.codewords(2), rng.normal(size=(langid.FEATURES, 1)).astype(np.float32),
                        np.zeros(1, np.float32), np.ones(1))
    docs = ["Ab ab é\tc", "", "one " * 400]
    got = model.margins(*langid.word_table([d.split() for d in docs]))
    for d, m in zip(docs, got):
        total, n = 0.0, 0
        for w in d.lower().split():
            padded = " " + w + " "
            for i in range(1, len(padded) - 1):
                at = langid.grams([w])[0][i - 1]
                total += sum(model.weights[b, 0] for b in at)
                n += 1
        assert abs(m[0] - total / max(n, 1)) < 1e-4


def test_held_out_accuracy(spark):
    rows = texts(600, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, fold_of(F.col("doc_id"), 4) != 2).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs, fold_of(F.col("doc_id"), 4) != 2).join(docs, "doc_id")
    held = got.filter(fold_of(F.col("doc_id"), 4) == 2)
    assert held.filter("lang_pred = lang").count() / held.count() > 0.93


def test_null_empty_repeated_and_no_rows(spark):
    rows = texts(80, 3) + [(900, None, "aa"), (901, "", None), (902, "12 -- 3! ² ½", "bb"), (None, "abc", None),
                           (903, "a" * 50_000, "aa"), (1, "abc abc", "aa"), (1, "abc abc", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.identify(df, fold_of(F.col("doc_id"), 4) != 2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    kept = langid.keep_known(df, langid.train(df, F.lit(True)))
    assert kept.columns == df.columns and kept.filter("doc_id BETWEEN 900 AND 902").count() == 0
    none = langid.identify(df.limit(0), F.lit(True))
    assert none.count() == 0
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}


def test_without_a_model_only_letterless_texts_go(spark):
    rows = [(1, "abc def", None), (2, None, None), (3, "", None), (4, "12 -- 3! ² ½", None), (None, "é 1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert model is None
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == ["abc def", "é 1"]
