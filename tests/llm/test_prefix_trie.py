import hashlib
import random
import zlib

import numpy as np
import pytest

from autotab.llm import prefix_trie as pt


def rebuilt(rows, group=5, heads=9):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = convs.get(c - c % group, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS part", "'x' AS key", "2 AS depth", "3 AS seq", "4 AS before")


def nodes(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
            for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(90):
        if rnd.random() < 0.1:
            continue
        for t in range(rnd.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]),
                         rnd.choice(["a", "é", "", None, "long " * 20])))
    rows += rows[:20]
    got = pt.prefix_trie(frame(spark, rows))
    assert nodes(got) == brute(rebuilt(rows))
    assert got.count() == len(brute(rebuilt(rows)))


def test_copies_over_many_partitions_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    rows += [(1000, t, "user", f"turn {t}") for t in range(400)] + [(2001, 0, "user", "turn 0")]
    got = nodes(pt.trie(pt.plain(pt.sequences(frame(spark, rows)))))
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((r, x))
    assert got == brute(convs)


def test_given_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert nodes(pt.prefix_trie(df)) == brute(rebuilt(rows))


def test_null_ids_turnless_and_no_rows(spark):
    rows = [(None, 1, "user", "x"), (1, 0, "user", "only"), (7, None, None, None), (7, None, None, None)]
    assert nodes(pt.prefix_trie(frame(spark, rows))) == brute(rebuilt(rows))
    assert pt.prefix_trie(frame(spark, [])).count() == 0
    assert pt.prefix_trie(frame(spark, rows[:1])).count() == 0


def test_binary_searches():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        x = rng.integers(0, 4, n)
        m = pt.Minima(x)
        at, d = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        right, left = m.right(at, d), m.left(at, d)
        for i, k, r, lo in zip(at, d, right, left):
            assert (x[i + 1:r + 1] >= k).all() and (r == n - 1 or x[r + 1] < k)
            assert (x[lo + 1:i + 1] >= k).all() and (lo == 0 or x[lo] < k)
        assert (m.over(left, right) == [x[a:b + 1].min() for a, b in zip(left, right)]).all()
