import random
import re
from collections import Counter

import numpy as np
import pytest

from autotab.llm import phrases


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, top, swallowed=80):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = set()
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= swallowed * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr(
        "*", "1 AS a", "2 AS b", "3 AS n", "'x' AS phrase", "4 AS rank", "5 AS doc_id")


def found(df):
    return {tuple(r) for r in df.collect()}


def made(seed, n=300):
    rnd = random.Random(seed)
    vocab = ["The", "of", "a\x1cb", "ünd", "x-y", "É", "no", "new york", "in the\tend", "end", "k" * 30]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", ", ", ".", "\n", "\t"]) for _ in range(rnd.randrange(0, 25)))
        rows.append((rnd.choice(["en", "en", "de", None]), text))
    rows += [("en", "Copied line of words that many hold. Yes")] * 40 + [("de", None), (None, ""), ("xx", "...")]
    return rows


@pytest.mark.parametrize("sample, count", [(4, 2), (1, 30), (64, 1), (2, 10 ** 6)])
def test_against_brute_force(spark, sample, count):
    """Any sample gives the same result, also an empty proposal: the border and the openings bring the rest."""
    rows = made(1)
    assert found(phrases.mine(frame(spark, rows), least=8, top=25, sample=sample, sample_count=count)) == brute(rows, 8, 25)


def test_expansion_finds_what_the_sample_missed(spark):
    rows = made(2)
    counts, named = phrases.frequent_phrases(frame(spark, rows), least=8, sample=2, sample_count=10 ** 6)
    want = Counter()
    for lang, text in rows:
        for w in pieces(text):
            want.update((lang or "und", " ".join(w[i:i + k])) for k in range(2, 5) for i in range(len(w) - k + 1))
    assert {((r.lang, r.phrase), r.n) for r in named.collect()} == {(p, a) for p, a in want.items() if a >= 8}
    assert counts.count() == counts.select("a", "b").distinct().count()


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    rows = made(3, 60) + [("en", " ".join(["a b c d e f, g"] * 200)), ("en", "z" * 400 + " tail end " + "y" * 300)]
    cut = [w for words, skip in phrases.windows(rows[-2][1], 50) for w in words[skip:]]
    assert cut == phrases.words_of(rows[-2][1])
    assert found(phrases.mine(frame(spark, rows), least=5, top=50)) == brute(rows, 5, 50)


def test_keys_that_share_half_are_told_apart():
    a, b = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    first, n = phrases._summed(a, b)
    assert sorted(zip(a[first].tolist(), b[first].tolist(), n.tolist())) == [(5, 1, 2), (5, 2, 1), (7, 1, 1)]


def test_no_rows(spark):
    assert phrases.mine(frame(spark, [])).count() == 0
    assert phrases.mine(frame(spark, [("en", None), (None, "")])).count() == 0


def test_a_task_hands_over_each_key_once(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    src = frame(spark, [("en", "one two three four five")] * 300).select("lang", "text").coalesce(1)
    rows = phrases._pass(src).collect()
    assert sorted(r.n for r in rows) == [300] * (5 + 4 + 3 + 2)
    assert len({(r.a, r.b) for r in rows}) == len(rows)


@pytest.mark.parametrize("sample", [2, 64])
def test_a_full_pool_loses_no_count(spark, monkeypatch, sample):
    monkeypatch.setattr(phrases, "SLICE", 50)
    monkeypatch.setattr(phrases, "POOL", 8)
    rows = made(4)
    assert found(phrases.mine(frame(spark, rows), least=8, top=25, sample=sample)) == brute(rows, 8, 25)


def test_the_pool_gives_back_its_coldest_keys():
    pool = phrases.Pool(4)
    keys = lambda *x: (np.array(x, np.uint64), np.zeros(len(x), np.int32), np.ones(len(x), np.int32))
    assert pool.add([keys(1, 2, 3, 4)]) is None
    a, _, n = pool.add([keys(1, 9), keys(5)])
    given = Counter(dict(zip(a.tolist(), n.tolist()))) + Counter(dict(zip(pool.held[0].tolist(), pool.held[2].tolist())))
    assert given == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 9: 1} and pool.held[0].tolist() == [1]
