"""Unigram lattices over a SentencePiece vocabulary.

The piece file's normal pieces get unigram log-probabilities by Zipf's law over
their order in the file, in whole units of 1/64 nat, so sums of scores are exact
integers and ties are real ties.  A character that is no piece scores 10 nats
below the worst piece and becomes its bytes.

No piece holds a blank mark after another character, so a normalised text falls
apart at its blanks into segments whose lattices are independent.  The lattices
of many distinct segments are built together: an Aho-Corasick automaton over
UTF-8 bytes (the blank mark is one byte) steps through all segments at once and
its output lists give all matches; programs over them run level by level.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

UNITS = 64
MARK = "▁"
_MARK_BYTES = MARK.encode()
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LOADED: dict = {}
SLICE = 1_000_000


def as_bytes(text: str) -> bytes:
    """UTF-8 with the blank mark as the single byte FF."""
    return text.encode("utf-8", "surrogatepass").replace(_MARK_BYTES, b"\xff")


class Automaton:
    """Aho-Corasick over bytes as a full transition table.

    ``table`` [states, 256] holds the next state; ``outputs`` lists the patterns
    that end in a state, longest first, from ``first[state]`` on, ``count`` of them.
    """

    def __init__(self, patterns: dict[int, bytes]):
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for key, pattern in patterns.items():
            at = 0
            for b in pattern:
                at = nodes.setdefault((at, b), len(nodes) + 1)
            ends[at] = key
        n = len(nodes) + 1
        parent, byte = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for (p, b), child in nodes.items():
            parent[child], byte[child] = p, b
        depth = np.zeros(n, np.int64)
        for child in range(1, n):    # a parent is numbered before its children
            depth[child] = depth[parent[child]] + 1
        by_depth = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 2)]
        self.table = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int64)
        for d, level in enumerate(by_depth[:-1]):
            if d > 1:
                fail[level] = self.table[fail[parent[level]], byte[level]]
            if d:
                self.table[level] = self.table[fail[level]]
            below = by_depth[d + 1]
            self.table[parent[below], byte[below]] = below
        found: list[list[int]] = [[] for _ in range(n)]
        for level in by_depth:
            for s in level:
                found[s] = ([ends[s]] if s in ends else []) + (found[fail[s]] if s else [])
        self.count = np.array([len(f) for f in found], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.outputs = np.array([k for f in found for k in f], np.int64)
        self.length = np.zeros(max(patterns) + 1, np.int64)
        for key, pattern in patterns.items():
            self.length[key] = len(pattern)

    def matches(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of all matches inside the runs text[begin:begin + size],
        by end position, longest first."""
        order = np.argsort(-size, kind="stable")
        at, left = begin[order], -size[order]
        state = np.zeros(len(text) + 1, np.int32)
        now = np.zeros(len(at), np.int32)
        for step in range(-int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(left, -step, side="left"))
            here = at[:live] + step
            now = self.table[now[:live], text[here]]
            state[here + 1] = now
        many = self.count[state]
        end = np.repeat(np.arange(len(state)), many)
        return end, self.outputs[np.arange(len(end)) + np.repeat(self.first[state] - np.cumsum(many) + many, many)]


class Vocabulary:
    """Pieces and scores of one file; ``scores`` are in units by piece id."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i)
                                              or self.model.is_byte(i) or self.model.is_unused(i))]
        split = [p for i in normal for p in [self.pieces[i]] if MARK in p.lstrip(MARK)]
        if split:
            raise ValueError(f"pieces that cross a blank cannot be used: {split[:3]}")
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
        self.scores = np.zeros(n, np.int64)
        for rank, i in enumerate(normal):
            self.scores[i] = -round(UNITS * (math.log(rank + 1) + total))
        self.unknown = int(min(self.scores[i] for i in normal)) - 10 * UNITS
        if MARK not in (self.pieces[i] for i in normal):
            raise ValueError("the blank mark must be a piece")
        self.finder = Automaton({i: as_bytes(self.pieces[i]) for i in normal})
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], np.int64)
        surface = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size

    def segments(self, text: str) -> list[str]:
        """Segments of the normalised text."""
        return self.split(self.model.normalize(text))

    def split(self, normal: str) -> list[str]:
        """Segments of a normalised text."""
        return _SEGMENT.findall(normal)

    def decode(self, ids: np.ndarray) -> str:
        """Text of piece ids: the pieces' surfaces without the leading blank."""
        size = self.surface_size[ids]
        at = np.repeat(self.surface_at[ids] - np.cumsum(size) + size, size)
        text = self.surface[at + np.arange(len(at))].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def load(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


@dataclass
class Lattice:
    """Edges of the lattices of several segments laid end to end, in byte positions,
    with one spare position between them: the pieces by end position, longest first,
    then the unknown characters in the same way.

    ``piece`` is -1 for an unknown character, ``width`` its number of bytes (1 for
    a piece); ``raw`` holds the bytes.
    """

    begin: np.ndarray    # [segments] first position
    finish: np.ndarray   # [segments] end position
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    piece: np.ndarray
    width: np.ndarray
    raw: np.ndarray

    @property
    def positions(self) -> int:
        return int(self.finish[-1]) + 2 if len(self.finish) else 1


#: Bytes of a character by its first byte (FF is the blank mark; 0 inside a character).
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 8 + [0] * 7 + [1], np.int64)


def lattice(vocabulary: Vocabulary, segments: list[str]) -> Lattice:
    # a lone surrogate, which no text from UTF-8 holds, becomes the spare byte FE
    joined = np.frombuffer(as_bytes("\udc80".join(segments)).replace(b"\xed\xb2\x80", b"\xfe"), np.uint8)
    finish = np.append(np.flatnonzero(joined == 0xFE), len(joined))
    begin = np.concatenate([[0], finish[:-1] + 1])
    end, piece = vocabulary.finder.matches(joined, begin, finish - begin)
    length = vocabulary.finder.length[piece]
    size = _WIDTH[joined]
    bare = size > 0
    bare[(end - length)[length == size[end - length]]] = False
    bare = np.flatnonzero(bare)
    width = size[bare]
    return Lattice(
        begin, finish, np.concatenate([end - length, bare]), np.concatenate([end, bare + width]),
        np.concatenate([vocabulary.scores[piece], np.full(len(bare), vocabulary.unknown)]),
        np.concatenate([piece, np.full(len(bare), -1)]),
        np.concatenate([np.ones(len(piece), np.int64), width]), joined)


def sorted_by(key: np.ndarray) -> np.ndarray:
    """Stable order of keys below 2^31: key and place sorted as one value."""
    packed = key << 32 | np.arange(len(key))
    packed.sort()
    return packed & 0xFFFFFFFF


def levels(depth: np.ndarray):
    """Index arrays of equal depth in ascending order, each in the given order."""
    if len(depth) == 0:
        return
    small = depth.astype(np.uint16) if depth.max() < 1 << 16 else depth
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    yield from np.split(order, cuts)


def heads(keys: np.ndarray) -> np.ndarray:
    """Offsets at which a new run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def best_counts(lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """(best score, pieces on the best path) of every segment.

    The tokenizer's tie rule: candidates for an end position come by ascending
    start, and only a strictly better one replaces the last; so of equal scores
    the longest last piece stays.
    """
    score = np.zeros(lat.positions, np.int64)
    count = np.zeros(lat.positions, np.int64)
    origin = np.zeros(lat.positions, np.int64)
    origin[lat.begin] = lat.begin
    origin = np.maximum.accumulate(origin)
    order = sorted_by(lat.end)      # of equal ends an unknown character comes last, as the shortest
    starts, ends, scores, widths = lat.start[order], lat.end[order], lat.score[order], lat.width[order]
    for edges in levels(ends - origin[starts]):
        start, end = starts[edges], ends[edges]
        candidate = score[start] + scores[edges]
        run = heads(end)
        top = np.maximum.reduceat(candidate, run)
        own = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(end))))
        first = np.flatnonzero(candidate == top[own])
        first = first[heads(own[first])]
        score[end[run]] = top
        count[end[run]] = count[start[first]] + widths[edges][first]
    return score[lat.finish], count[lat.finish]
