import hashlib

import numpy as np

from autotab.llm import order_minhash as om

M = 2**64 - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_signature(text, k=8, slots=32):
    """The same definition with Python integers and full sorting."""
    odd = [int(x) for x in om._ODD]
    if not text:
        return [0] * slots
    if len(text) < k:
        h = len(text)
        for c in text:
            h = (h * odd[0] + ord(c) * odd[1]) & M
        grams = [mix(h)]
    else:
        def rolled(s):
            if len(s) == 1:
                return (ord(s) + 1) * odd[2] & M
            half = len(s) // 2
            return (rolled(s[:half]) * odd[3 + half] + rolled(s[half:])) & M
        grams = [mix(rolled(text[i:i + k])) for i in range(len(text) - k + 1)]
    seen, base = {}, []
    for g in grams:
        g >>= 24
        seen[g] = seen.get(g, -1) + 1
        base.append(mix((g * odd[0] + seen[g] * odd[1] + 1) & M))
    out = []
    for s in range(slots):
        picked = sorted(sorted(range(len(base)), key=lambda i: base[i] * odd[16 + s] & M)[:2])
        v = 0
        for i in picked:
            v = mix((v * odd[0] + base[i]) & M)
        out.append(v >> 32)
    return out


TEXTS = ["", "a", "short", "exactly8", "abcabcabcabcabcabc" * 20, "é😀" * 40, "x" * 500,
         "The order of k-mers matters to an edit distance. " * 7]


def test_signature_against_plain_form():
    for t in TEXTS:
        assert om.signature(t).tolist() == plain_signature(t), t


def test_long_text_chunks_and_order_matters():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60_000)]
    a = " ".join(words)
    assert len(a) > 1 << 17
    half = len(words) // 2
    moved = " ".join(words[half:] + words[:half])
    same, swapped = om.likeness(om.signature(a), om.signature(a)), om.likeness(om.signature(a), om.signature(moved))
    assert same == 1 and swapped < 0.95


def expected(rows):
    """Digest rows by brute force over the sorted list."""
    done = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (doc, text) in enumerate(done):
        text, following = text or "", done[(i + 1) % len(done)][1] or ""
        e = om.edited(text, following)
        a, b, c = map(plain_signature, (text, e, following))
        same = [(sum(x == y for x, y in zip(a, z)) / 32) ** 0.5 for z in (b, c)]
        out.append((doc, len(text), hashlib.sha256(e.encode()).hexdigest(),
                    np.array(a, np.uint32).tobytes().hex(), np.array(b, np.uint32).tobytes().hex(), *same))
    return out


def test_edited_pairs_against_brute_force(spark, frame):
    rows = [(i * 3 % 41, t * (1 + i % 3)) for i, t in enumerate(TEXTS * 5)] + [(100, None), (None, "null id text")]
    for parts in (1, 7):
        df = frame(rows).repartition(parts)
        got = om.edited_pairs(df).collect()
        assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(r for r in expected(rows) if r[0] is not None)
        assert sum(r.doc_id is None for r in got) == 1


def test_small_tables_and_repeated_rows(frame):
    assert om.edited_pairs(frame([])).count() == 0
    one = om.edited_pairs(frame([(5, "only one here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(om.edited_pairs(frame([(1, "same"), (1, "same"), (2, "")])).collect()) == 3
    assert len({r.fingerprint for r in om.fingerprints(frame([(1, "same"), (2, "same")])).collect()}) == 1
