"""The piece file as a real unigram model with the scores of ``unigram.Vocabulary``:
the reference for the operators that rebuild its search."""

import struct

import sentencepiece

from autotab.llm.unigram import UNITS


def varint(b, i):
    v = s = 0
    while True:
        v |= (b[i] & 127) << s
        s, i = s + 7, i + 1
        if b[i - 1] < 128:
            return v, i


def fields(b, i, end):
    """(field, wire type, value start, value end) of a message."""
    while i < end:
        tag, i = varint(b, i)
        kind = tag & 7
        if kind == 0:
            j = varint(b, i)[1]
        elif kind == 2:
            n, i = varint(b, i)
            j = i + n
        else:
            j = i + (4 if kind == 5 else 8)
        yield tag >> 3, kind, i, j
        i = j


def as_unigram(path, vocabulary):
    raw = bytearray(open(path, "rb").read())
    piece = 0
    for field, _, i, j in list(fields(raw, 0, len(raw))):
        for f, kind, a, b in list(fields(raw, i, j)):
            if field == 1 and f == 2:
                raw[a:b] = struct.pack("<f", vocabulary.scores[piece] / UNITS)
            elif field == 2 and f == 3:
                raw[a] = 1    # model type: unigram
        piece += field == 1
    model = sentencepiece.SentencePieceProcessor()
    model.LoadFromSerializedProto(bytes(raw))
    return model
