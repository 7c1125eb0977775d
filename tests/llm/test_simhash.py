import random
import re

import numpy as np
import xxhash

from autotab.llm import graph, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(nodes, radius):
    """{node: smallest reachable} over all pairs within radius."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def planted(n, seed):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for x in out[:n // 2]:
        for _ in range(3):
            x ^= 1 << rnd.randrange(64)
            out.append(x)
    return sorted(set(out))


def test_near_pairs_against_popcount():
    fps = np.array(planted(300, 1), np.uint64)
    for radius in (1, 2, 3, 5):
        a, b = simhash.near_pairs(fps, fps, radius)
        want = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
        assert sorted(zip(a, b)) == sorted(map(tuple, want))
        a, b = simhash.near_pairs(fps, fps, radius, upper=True)
        assert {(min(x, y), max(x, y)) for x, y in zip(a, b)} == {(min(x, y), max(x, y)) for x, y in want}


def test_links_connect_what_is_near(spark):
    centre = 0x0123456789ABCDEF
    rnd = random.Random(5)
    crowd = {centre ^ (rnd.getrandbits(16) << 48) for _ in range(3000)}    # one large bucket
    fps = sorted(set(planted(400, 2)) | crowd)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {}
    for r in graph.components(simhash.links(df, 2)).collect():
        got[r.u % 2**64] = r.v % 2**64
    want = plain_components(fps, 2)
    parts = {}
    for f in fps:
        parts.setdefault(got.get(f, f), set()).add(f)
    expect = {}
    for f, r in want.items():
        expect.setdefault(r, set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, expect.values()))


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    part = plain_components(set(prints.values()), 2)
    low = {}
    for i, f in prints.items():
        low[part[f]] = min(i, low.get(part[f], i))
    for i, f in prints.items():
        assert got[i].fp % 2**64 == f and got[i].component_id == low[part[f]]
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    assert sorted(kept) == sorted(low.values())


def test_null_empty_repeated_and_no_rows(frame):
    rows = [(4, None), (2, ""), (2, ""), (None, "A b"), (None, "a B"), (7, "a b c d"), (8, "word " * 30000), (9, "A\x0bB\x1c")]
    got = simhash.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    by = [(r.doc_id, r.fp % 2**64, r.component_id) for r in got]
    assert by.count((2, 0, 2)) == 2 and (4, 0, 2) in by
    for i, t in rows:
        assert (i, plain_fingerprint(t)) in {(a, b) for a, b, _ in by}
    assert all(c is None for i, _, c in by if i is None)
    kept = simhash.deduplicate(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 2), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert simhash.near_duplicates(frame([])).count() == 0
    assert simhash.deduplicate(frame([])).count() == 0


def test_unrelated_texts_without_or_with_one_id_all_stay(frame):
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(30)) for _ in range(12)]
    rows = [(None, t) for t in texts[:8]] + [(5, t) for t in texts[8:10]] + [(6, texts[10]), (7, texts[11])]
    again = [(None, texts[0]), (None, texts[8]), (5, texts[9]), (8, texts[10]), (None, texts[11])]
    kept = simhash.deduplicate(frame(rows + again))
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted(((i or 0), t) for i, t in rows)
    found = simhash.near_duplicates(frame(rows + again)).collect()
    assert len({r.component for r in found}) == len(texts)


def test_a_dense_bucket_gives_fewer_links_than_fingerprints():
    rnd = random.Random(8)
    fps = np.array(sorted({0x0123456789AB0000 | rnd.getrandbits(16) for _ in range(18000)})[:16384 // 2], np.uint64)
    u, v = simhash._links(fps, np.array([len(fps)]), 2)
    assert 0 < len(u) < len(fps) and len(set(u.tolist())) == len(u)
    want = plain_components([int(x) for x in fps[:1500]], 2)
    u, v = simhash._links(fps[:1500].copy(), np.array([1500]), 2)
    got = dict(zip(u.tolist(), v.tolist()))
    assert {int(f): got.get(int(f), int(f)) for f in fps[:1500]} == want


def test_columns_named_like_inner_ones_stay(spark):
    rows = [(1, "a b c d", "keep", 7), (2, "a b c d", "drop", 8), (2, "a b c d", "drop", 8), (3, "x y z", "also", 9),
            (3, "x y z", "also", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key long").selectExpr(
        "*", "'n' AS _name", "true AS _none", "'r' AS root", "5 AS u", "6 AS v", "'c' AS component")
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r._id, r._key, r._name) for r in got.collect()) == [(1, "keep", 7, "n"), (3, "also", 9, "n")]
