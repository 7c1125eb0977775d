import random
import zlib
from array import array

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from autotab.llm import packing

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_ids_are_those_of_tokenizers():
    bpe = packing.load_bpe(*PATHS)
    full = Tokenizer.from_file(PATHS[0])
    full.encode_special_tokens = True
    every = [chr(c) for c in range(0x250)]
    texts = ["", " ", "a  b\n\n c", "it's 12 34ab", "<|endoftext|>", "日本 語", "x" * 3000]
    texts += [f"a{c}b {c}{c} 1{c}" for c in every]
    rnd = random.Random(1)
    texts += ["".join(rnd.choices(every, k=40)) for _ in range(200)]
    for t in texts:
        assert list(bpe.ids(t)) == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_inside_texts_are_those_of_the_plain_tokenizer(frame):
    plain = Tokenizer.from_file(PATHS[0])
    assert plain.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    end = "<|endoftext|>"
    texts = ["hello <|endoftext|> world", end, end * 3, f"a{end}b\n{end} ", f"日本 {end}語", "語", "<|endoftext|", "<|ENDOFTEXT|>",
             f"word {end} " * 900]
    bpe = packing.load_bpe(*PATHS)
    for t in texts + texts[::-1]:
        assert list(bpe.encode(t)) == plain.encode(t, add_special_tokens=False).ids, repr(t)
    by = {}
    for r in packing.pack(frame(list(enumerate(texts))), *PATHS, keep_ids=True).collect():
        by.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
    for i, t in enumerate(texts):
        want = plain.encode(t, add_special_tokens=False).ids + [0]
        assert [x for r in sorted(by[i], key=lambda r: r.start) for x in r.ids] == want
        assert {r.doc_tokens for r in by[i]} == {len(want)}


def test_pieces_cover_and_windows_hold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, *PATHS, keep_ids=True).collect()
    full = Tokenizer.from_file(PATHS[0])
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
    for doc in docs.collect():
        got = [i for r in sorted(by[doc.doc_id], key=lambda r: r.start) for i in r.ids]
        assert got == full.encode(doc.text, add_special_tokens=False).ids + [0]
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    used = sum(r.length for r in rows)
    assert used / (1024 * len(seqs)) > 0.97


def test_best_fit_decreasing_against_plain_scan(spark):
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 64) for _ in range(400)]
    pieces = spark.createDataFrame([(i, 0, n, i, n) for i, n in enumerate(sizes)],
                                   "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack_pieces(pieces, 400, window=64)
    windows = []
    for n in sorted(sizes, reverse=True):
        fit = [w for w in windows if w[0] >= n]
        if fit:
            min(fit, key=lambda w: w[0])[0] -= n
        else:
            windows.append([64 - n])
    left = got.groupBy("sequence_id").agg((64 - F.sum("length")).alias("l")).collect()
    assert sorted(r.l for r in left) == sorted(w[0] for w in windows)


def test_null_empty_repeated_and_no_rows(frame):
    df = frame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 3000)])
    rows = packing.pack(df, *PATHS).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows if r.doc_tokens < 9) == [(-1, 3), (1, 1), (2, 1), (2, 1)]
    assert sum(r.length for r in rows if r.doc_id == 3) == next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert packing.pack(df.limit(0), *PATHS).count() == 0
