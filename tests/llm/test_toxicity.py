import random

import numpy as np
from pyspark.sql import functions as F

from autotab.llm import toxicity
from autotab.llm.common import fold_of, word_table


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(900)]
    bad = {"xx": ["zorble", "Quxly"], "yy": ["vompish", "wrenky."]}
    docs, labels = [], []
    for i in range(n):
        lang, toxic = rnd.choice(["xx", "yy"]), rnd.random() < 0.25
        words = rnd.choices(vocabulary, k=rnd.randint(5, 120))
        if toxic:
            for w in rnd.sample(bad[lang], rnd.randint(1, 2)):
                words.insert(rnd.randrange(len(words)), w)
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("x")),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_responses_against_plain_convolution():
    rng = np.random.default_rng(2)
    net = toxicity.Cnn([rng.normal(size=(toxicity.ROWS, toxicity.SIZE)).astype(np.float32) for _ in range(4)],
                       [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                       [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
                       rng.normal(size=25).astype(np.float32))
    docs = ["a b c d e f a b", "", "x", "x y", "p q r", ""]
    words, ids, offsets = word_table([d.split() for d in docs])
    got = net.logits(toxicity.word_codes(words), ids, offsets)
    for d, value in zip(docs, got):
        e = net.embed(toxicity.word_codes(d.split())) if d else np.zeros((0, toxicity.SIZE))
        top = []
        for k, w in enumerate(toxicity.WIDTHS):
            conv = [sum(e[i + j] @ net.filters[k][j] for j in range(w)) + net.bias[k] for i in range(len(e) - w + 1)]
            top.append(np.maximum(np.max(conv, axis=0), 0) if conv else np.zeros(toxicity.FILTERS))
        assert abs(np.concatenate(top) @ net.out[:-1] + net.out[-1] - value) < 1e-3


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 4)
    df, lab = frames(spark, docs, labels)
    net = toxicity.train(df, lab, fold_of(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.predict(df, net).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, y in labels]
    assert np.mean(held) > 0.97
    assert toxicity.keep_clean(df, net).columns == df.columns
    assert toxicity.keep_clean(df, net).count() == sum(s < 0.5 for s in got.values())


def test_null_empty_repeated_and_no_rows(spark):
    docs, labels = corpus(200, 5)
    docs += [(900, None, None), (901, "", "xx"), (None, "a b", None), (3, docs[3][1], "xx"), (902, "word " * 20_000, "xx")]
    labels += [(None, 1), (900, 1), (901, None), (3, 0)]
    df, lab = frames(spark, docs, labels)
    net = toxicity.train(df, lab, F.lit(True))
    got = toxicity.predict(df, net).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score < 0.5 for r in got if r.doc_id in (900, 901))
    assert toxicity.predict(df.limit(0), net).count() == 0
    assert toxicity.train(df, lab.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.predict(df, None).collect()} == {0.0}


def test_every_labelled_text_is_learnt_from(spark):
    """Words of one text in a hundred of a class of 6,000 count: each touches its rows, and its texts are told apart."""
    rnd = random.Random(7)
    docs = [(i, " ".join(rnd.choices(["ab", "cd", "ef", "gh"], k=6)) + (" zorble" if i % 100 == 0 else ""), "xx") for i in range(6500)]
    docs.append((6500, "gh " * 17_000 + "quxly", "xx"))
    docs += [(6501 + i, "quxly ab", "xx") for i in range(3)]
    df, lab = frames(spark, docs, [(i, int(i % 100 == 0 or i >= 6500)) for i, *_ in docs])
    seen = {}
    totals = toxicity._totals

    def watched(texts, run, width):
        out = totals(texts, run, width)
        if width == 2:
            seen["rows"], seen["n"] = out, texts.count()
        return out

    toxicity._totals = watched
    try:
        net = toxicity.train(df, lab, F.lit(True), aside=0.0)
    finally:
        toxicity._totals = totals
    assert seen["n"] == len(docs)
    count = [int(seen["rows"][toxicity.word_codes([w])[0, 0]].sum()) for w in ("zorble", "quxly")]
    assert count == [65, 4]
    logit = [net.logits(toxicity.word_codes(t.split()), np.arange(3), np.array([0, 3]))[0] for t in ("ab cd zorble", "ab cd ef")]
    assert logit[0] > logit[1]


def test_blocks_do_not_depend_on_how_rows_lie(spark):
    docs, labels = corpus(2500, 6)
    df, lab = frames(spark, docs, labels)
    nets = [toxicity.train(d, lab, F.lit(True)) for d in (df, df.repartition(5, "text"))]
    assert all(np.array_equal(a, b) for a, b in zip(*(n.tables + n.filters + [n.out] for n in nets)))
    assert nets[0].shift == nets[1].shift
