import hashlib
import math
import random
import re

from autotab.llm import pii

KINDS = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain_seeds(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def name(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


TEXTS = [None, "", "nothing here", "a@b@c.d e.f@g.h_i@j.k.l.", "x@y.z%q@r.s", "@a.b .@a.b a@b", "é😀 bob.42@mail8.example.com,",
         "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0003.255 1.2.3", "9" * 5000 + ".1.1.1", "4785380592391139 4785380592391138 4111 1111-1111 1111",
         "+1 (988) 555-2485 +1((( +123456789 +1234567890 +1 2345678901 23456", "1234567890123456789012 0000 0000 0000 00",
         "+1 (988) 555-2485 4111111111111111", "1 2 3 4-5-6 7 8 9 0 1 2 3 4 5"]


def test_seeds_against_plain_expressions():
    rnd = random.Random(3)
    made = ["".join(rnd.choices("a1.@-+ ()%_9é0", k=rnd.randrange(1, 60))) for _ in range(4000)]
    for t in TEXTS + made:
        assert pii.seeds(t or "") == plain_seeds(t), t


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + "(" * 400_000, "1 " * 200_000, "a1.-" * 100_000):
        pii.candidates(t, pii.seeds(t))


def brute(texts, least_values, pattern_score, value_trust, rounds):
    """{row: added spans} of the same rules over plain dictionaries."""
    edges, loose = {}, []
    for row, t in enumerate(texts):
        t = t or ""
        spans = plain_seeds(t)
        for s, e, seed in [(s, e, 1) for s, _, e in spans] + [(s, e, 0) for s, e in pii.candidates(t, spans)]:
            for p in pii.contexts(t, s, e):
                v = t[s:e].lower()
                edges.setdefault(p, {})[v] = max(seed, edges.get(p, {}).get(v, 0))
                if not seed:
                    loose.append((row, s, e, p))
    edges = {p: v for p, v in edges.items() if len(v) >= least_values}
    sure = {v for vs in edges.values() for v, s in vs.items() if s}
    trust, accepted = {v: 1000 for v in sure}, {}
    for _ in range(rounds + 1):
        accepted = {}
        for p, vs in edges.items():
            score = sum(trust.get(v, 0) for v in vs) // (len(vs) + 1)
            if sum(v in trust for v in vs) >= least_values and score >= pattern_score:
                accepted[p] = score
        weight = {}
        for p, s in accepted.items():
            for v, seed in edges[p].items():
                if not seed:
                    weight[v] = weight.get(v, 0) + round(-math.log(1 - s / 1000) * 1000)
        new = {v: round((1 - math.exp(-w / 1000)) * 1000) for v, w in weight.items()}
        now = {v: t for v, t in new.items() if t >= value_trust} | {v: 1000 for v in sure}
        done, trust = len(now) == len(trust), now
        if done:
            break
    out = {}
    for row, s, e, p in loose:
        if p in accepted:
            out.setdefault(row, set()).add((s, 4, e))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    texts = list(TEXTS)
    for i in range(60):
        texts.append(f"Please call the office phone: +1 ({200 + i}) 555-{1000 + i} today {rnd.random()}")
    for i in range(12):      # numbers without a country code: unknown shape, known context
        texts.append(f"Please call the office phone: {200 + i}-555-{2000 + i} today")
        texts.append(f"Office phone: {200 + i}-555-{2000 + i} now or badge number {200 + i}-555-{2000 + i} here")
    for i in range(5):
        texts.append(f"order number {10 ** 6 + i} shipped, badge number X{70000 + i}9 here")
    texts += texts[-3:]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr(
        "*", "'x' AS pattern", "1 AS row", "2 AS value", "3 AS base", "4 AS found", "5 AS seed")


def test_bootstrapping_against_brute_force(spark):
    texts = corpus(1)
    got = pii.find_personal(frame(spark, texts)).collect()
    added = brute(texts, 3, 600, 700, 4)
    want = []
    for i, t in enumerate(texts):
        base = plain_seeds(t)
        want.append((i if i % 9 else None, *[sum(k == n for _, k, _ in base) for n in range(4)],
                     hashlib.sha256(name(base).encode()).hexdigest(), name(set(base) | added.get(i, set())), len(added.get(i, ()))))
    order = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert sum(len(v) for v in added.values()) >= 24      # office phones, and badge numbers by their values
    assert not any("order number" in (texts[r] or "") and s < 25 for r, v in added.items() for s, _, _ in v)


def test_patterns_carry_their_scores(spark):
    found = {r.pattern: r for r in pii.learn(pii.scan(frame(spark, corpus(2)))).collect()}
    assert found["office phone: _"].values > found["office phone: _"].known / 2 and found["office phone: _"].score >= 600
    assert "order number _" not in found


def test_no_rows_and_no_seeds(spark):
    assert pii.find_personal(frame(spark, [])).count() == 0
    r = pii.find_personal(frame(spark, ["badge number 123456 here"] * 4 + [None])).collect()
    assert [x.spans for x in r] == [""] * 5 and all(x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in r)


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal(docs).collect():
        assert r.base_sha256 == hashlib.sha256(name(plain_seeds(texts[r.doc_id])).encode()).hexdigest()
        assert set(filter(None, name(plain_seeds(texts[r.doc_id])).split(","))) <= set(filter(None, r.spans.split(",")))
