"""Phrase mining by Toivonen's sampling.

Phrases of up to four words are counted per language.  A sample of the rows
proposes phrases; its negative border is every phrase that was not proposed but
whose two parts without the last and without the first word were (for single words:
every word).  One pass over all rows counts the proposals and the border exactly.  Border
phrases that turn out frequent are failures: an expansion pass counts
what they open, and passes go on until nothing is open.

Neither border nor openings are listed: a pass looks at each phrase of its texts and
asks two bitmaps of bounded size whether the parts are known.  A bitmap may
say yes wrongly, which only counts a phrase too many; it never says no wrongly.  The expansion
pass takes a phrase whose parts are frequent or themselves not yet counted, so
phrases grown from new ones are counted in the same pass and one pass closes.

A phrase's key is 128 bits of hash over its language and words, of which 96 are shuffled;
slices of a task are counted on their own first and merged in a pool of bounded size that
keeps the keys met most often, so only keys and counts are shuffled.  The words of a frequent
phrase come from the sample where it occurs there; the last pass carries those of the others.

Defined cases: a null text is the empty text, a null language is ``und``; repeated rows
count each; texts without words and an empty table give nothing; very long texts are
cut at word ends, with the words before the cut as context; other columns are
not read.  Languages' words never mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autotab.llm.common import mix, stored, strings
from autotab.session import release

LONGEST = 4
SLICE = 2_500_000        # characters counted together in a task
POOL = 1_000_000         # keys whose counts a task holds from slice to slice
BATCH = 65_536           # rows a task hands over at once
MAX_BITS = 28            # a bitmap has at most 2^28 bits (32 MB)

#: Fixed values of the contract: what ends a piece, and the blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_STOP = b"."
_TABLE = bytes.maketrans(ENDS + b"\t", _STOP * len(ENDS) + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of ``text`` with a stop between pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(_STOP, b" . ").split()


def windows(text: str, limit: int):
    """(words, number of leading words that are only context) of parts of about
    ``limit`` characters, cut where a word ends."""
    if len(text) <= limit:
        yield words_of(text), 0
        return
    cuts = (ENDS + BLANKS).decode()
    at, context = 0, []
    while at < len(text):
        end = at + limit
        if end < len(text):
            back = max(text.rfind(c, at, end) for c in cuts)
            ahead = [x for x in (text.find(c, end) for c in cuts) if x >= 0] if back < at else [back]
            end = (min(ahead) if ahead else len(text) - 1) + 1
        words = words_of(text[at:end])
        yield context + words, len(context)
        context, at = (context + words)[1 - LONGEST:], end


class Slice:
    """Keys of all phrases of some texts: per length the two halves of the key of the phrase
    that ends at each position, and whether there is one."""

    def __init__(self, groups: list[tuple[str, list[bytes], int]]):
        import xxhash
        flat, fresh, seeds = [], [], []
        for lang, words, skip in groups:
            flat += words
            flat.append(_STOP)
            size = len(words) + 1
            fresh.append(np.arange(size) >= skip)
            seeds.append((np.frombuffer(xxhash.xxh3_128_digest(lang.encode("utf-8", "surrogatepass")), np.uint64), size))
        table = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.words, self.langs = list(table), [g[0] for g in groups]
        self.ids = np.fromiter(map(table.__getitem__, flat), np.int64, len(flat))
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), np.uint64).reshape(-1, 2)
        self.sizes = np.array([s for _, s in seeds])
        plain = self.ids != table[_STOP]
        self.fresh = np.concatenate(fresh) & plain
        self.keys, self.ok = [], []
        for half in (0, 1):
            word = digest[self.ids, half]
            state = np.repeat(np.array([s[half] for s, _ in seeds], np.uint64), self.sizes)
            for k in range(1, LONGEST + 1):
                state = mix(state * _STEP + word)
                if half == 0:
                    self.keys.append((state, None))
                else:
                    self.keys[k - 1] = (self.keys[k - 1][0], state)
                state = np.concatenate([state[:1], state[:-1]])
        for k in range(LONGEST):
            self.ok.append(plain if not k else _before(self.ok[-1]) & plain)

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.words[i] for i in self.ids[at - k + 1:at + 1]).decode("utf-8", "surrogatepass")

    def totals(self):
        """(language, number of words)."""
        new = np.add.reduceat(self.fresh.astype(np.int64), np.cumsum(self.sizes) - self.sizes)
        out: dict[str, int] = {}
        for lang, n in zip(self.langs, new):
            out[lang] = out.get(lang, 0) + int(n)
        return out


def _low(x: np.ndarray) -> np.ndarray:
    """The lower 32 bits of a key's second half, as they are shuffled and joined."""
    return np.ascontiguousarray(x).view(np.uint64).astype(np.uint32).view(np.int32)


def _before(x: np.ndarray) -> np.ndarray:
    """The value one position earlier, False at the start."""
    return np.concatenate([np.zeros(1, bool), x[:-1]])


def lang_key(lang: str) -> np.ndarray:
    import xxhash
    return np.frombuffer(xxhash.xxh3_128_digest(lang.encode("utf-8", "surrogatepass")), np.uint64)


def phrase_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """[n, n] keys (two halves): entry (i, j) is that of the words i to j."""
    import xxhash
    n, seed = len(words), lang_key(lang)
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    out = np.zeros((n, n, 2), np.uint64)
    for i in range(n):
        state = seed
        for j in range(i, n):
            state = mix(state * _STEP + digest[j])
            out[i, j] = state
    return out


class Bitmap:
    """Whether a key may be in a set: two bits a key."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = None
        for half in keys:
            at = half & self.mask
            hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def bitmap(keys: DataFrame) -> Bitmap:
    """Bitmap over ``keys`` (a, b): 16 bits a key, 2^MAX_BITS at most."""
    power = min(MAX_BITS, max(16, int(16 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*[F.col(c).bitwiseAND(F.lit((1 << power) - 1)) for c in ("a", "b")])).alias("p"))
    rows = at.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << power - 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return Bitmap(out.view(np.uint8))


def _summed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, number) of every distinct key."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    new = np.flatnonzero(x[1:] != x[:-1]) + 1
    inner = x[1:] == x[:-1]
    if (y[1:][inner] != y[:-1][inner]).any():      # two keys share their first half
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
    starts = np.concatenate([[0], new])
    return order[starts], np.diff(np.concatenate([starts, [len(a)]]))


class Pool:
    """Counts of the keys of a task's slices, sorted by the first half."""

    def __init__(self, limit: int):
        self.limit = limit
        self.held = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def add(self, parts: list[tuple]):
        """Add (a, b, n) arrays; beyond the limit, the keys with the lowest counts are given back until half of it is left.
        Keys that share their first half may stay apart, which only hands them over twice."""
        a, b, n = (np.concatenate([own, *more]) for own, more in zip(self.held, zip(*parts)))
        order = np.argsort(a, kind="stable")      # few sorted runs
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        a, b, n = a[new], b[new], np.add.reduceat(n, new, dtype=np.int32) if len(new) else n
        self.held = (a, b, n)
        if len(a) <= self.limit:
            return None
        hot = n > np.partition(n, -(self.limit // 2))[-(self.limit // 2)]
        self.held = (a[hot], b[hot], n[hot])
        return a[~hot], b[~hot], n[~hot]


def _wanted(s: Slice, proposed: Bitmap | None, frequent: Bitmap | None, untold: Bitmap | None = None):
    """(length, positions to count, positions whose words are wanted) of one pass."""
    if proposed is None:      # the sample: every phrase, or the words of the frequent ones
        for k in range(LONGEST):
            if frequent is None:
                yield k + 1, s.ok[k], None
            elif k:
                yield k + 1, np.zeros(len(s.ids), bool), frequent.has(s.keys[k]) & s.ok[k]
        return
    known = [proposed.has(s.keys[k]) & s.ok[k] for k in range(LONGEST - 1)]
    first = [s.ok[0]] + [s.ok[k] & _before(known[k - 1]) & known[k - 1] for k in range(1, LONGEST)]
    if frequent is None:      # proposals and border
        for k in range(LONGEST):
            yield k + 1, first[k], None
        return
    maybe = None
    for k in range(LONGEST):
        found = frequent.has(s.keys[k]) & first[k]
        if not k:
            maybe = found
            continue
        open_ = s.ok[k] & ~first[k] & _before(maybe) & maybe
        told = np.zeros(len(found), bool)
        at = np.flatnonzero(found)
        told[at] = untold.has(tuple(half[at] for half in s.keys[k]))
        yield k + 1, open_, told
        maybe = found | open_


def _pass(src: DataFrame, proposed=None, frequent=None, untold=None, words: bool = False) -> DataFrame:
    """(a, b, n) or, with ``words``, (a, b, n, lang, phrase): counts of a task's slices."""
    spark = src.sparkSession
    held = spark.sparkContext.broadcast((proposed, frequent, untold))      # three bitmaps of bounded size

    def count(s):
        if held.value[0] is not None and held.value[1] is None:
            for lang, n in s.totals().items():
                key = lang_key(lang)
                yield key[:1], _low(key[1:]), np.array([n], np.int32), None, None
        for k, take, told in _wanted(s, *held.value):
            at = np.flatnonzero(take & s.fresh)
            named = np.flatnonzero(told & s.fresh) if told is not None else at[:0]
            both = np.concatenate([at, named])
            if not len(both):
                continue
            a, b = (half[both] for half in s.keys[k - 1])
            first, n = _summed(a, b)
            n = np.where(first < len(at), n, 0).astype(np.int32)      # a key is in one of the two parts
            names = ends = None
            if words:
                spot = both[first]
                names = [s.phrase(i, k) for i in spot]
                ends = np.searchsorted(np.cumsum(s.sizes), spot, side="right")
                ends = [s.langs[i] for i in ends]
            yield a[first], _low(b[first]), n, ends, names

    def slices(batches):
        for batch in batches:
            groups, size = [], 0
            for lang, text in zip(strings(batch.column("lang")), strings(batch.column("text"))):
                for part, skip in windows(text, SLICE):
                    groups.append((lang, part, skip))
                    size += 6 * len(part) + 1
                    if size >= SLICE:
                        yield Slice(groups)
                        groups, size = [], 0
            if groups:
                yield Slice(groups)

    def run(batches):
        pool = Pool(POOL)
        for s in slices(batches):
            if words:
                for found in count(s):
                    yield from out(*found)
                continue
            parts = [found[:3] for found in count(s)]
            over = pool.add(parts) if parts else None
            if over is not None:
                yield from out(*over)
        yield from out(*pool.held)

    def out(a, b, n, langs=None, names=None):
        for at in range(0, len(a), BATCH):
            own = slice(at, at + BATCH)
            cols = [pa.array(np.ascontiguousarray(a[own]).view(np.int64)), pa.array(b[own]), pa.array(n[own])]
            if words:
                cols += [pa.array(langs[own], pa.string()), pa.array(names[own], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n", "lang", "phrase"][:len(cols)])

    return src.mapInArrow(run, "a long, b int, n int" + (", lang string, phrase string" if words else ""))


def frequent_phrases(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30,
                     sample: int = 16, sample_count: int = 2) -> tuple[DataFrame, DataFrame]:
    """((a, b, n) of every frequent phrase, single words and, with the key of the language
    alone, all words of it included; (a, b, n, lang, phrase) of the phrases of two words or more).

    One row of ``sample`` proposes the phrases it holds ``sample_count`` times or more; neither
    changes the result.
    """
    src = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    def summed(rows: DataFrame):      # the keys of a slice are distinct already: they are shuffled as they are
        return rows.repartition("a", "b").groupBy("a", "b")

    few = src.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(sample)) == 0)
    proposed = stored(summed(_pass(few)).agg(F.sum("n").alias("n")).filter(F.col("n") >= sample_count))
    first_map = bitmap(proposed.select("a", "b"))
    release(proposed)
    first = stored(summed(_pass(src, first_map)).agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    frequent = bitmap(first.select("a", "b"))

    def worded(rows: DataFrame):
        return summed(rows).agg(F.sum("n").alias("n"), F.max(F.struct("lang", "phrase")).alias("p"))

    def named_by(rows: DataFrame, of: DataFrame):
        return rows.select("a", "b", "p").join(of, ["a", "b"]).select("a", "b", "n", "p")

    seen = stored(named_by(worded(_pass(few, None, frequent, words=True)), first))
    unseen = stored(first.join(seen.select("a", "b"), ["a", "b"], "left_anti"))      # exactly: a bitmap's wrong yes names nothing twice
    second = stored(worded(_pass(src, first_map, frequent, bitmap(unseen.select("a", "b")), words=True)))
    opened = second.filter(F.col("n") >= least)
    told = named_by(second.filter("n = 0"), unseen)
    named = seen.unionByName(told).unionByName(opened).select("a", "b", "n", "p.lang", "p.phrase")
    return first.unionByName(opened.select("a", "b", "n")), named


def _parts(batches):
    """Keys of the cuts of each phrase and of the phrases inside it."""
    for batch in batches:
        cuts, inner = [], []
        for lang, phrase in zip(strings(batch.column("lang")), strings(batch.column("phrase"))):
            w = phrase.encode("utf-8", "surrogatepass").split(b" ")
            keys, k = phrase_keys(lang, w).view(np.int64), len(w)
            low = _low(keys[:, :, 1])
            cuts.append([{"k": i, "la": int(keys[0, i - 1, 0]), "lb": int(low[0, i - 1]), "ra": int(keys[i, k - 1, 0]),
                          "rb": int(low[i, k - 1])} for i in range(1, k)])
            inner.append([{"a": int(keys[i, j, 0]), "b": int(low[i, j])} for i in range(k) for j in range(i + 1, k)
                          if j - i + 1 < k])
        kind = pa.struct([(c, pa.int32() if c in ("lb", "rb") else pa.int64()) for c in ("k", "la", "lb", "ra", "rb")])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("a", "b", "n", "lang", "phrase")]
            + [pa.array(cuts, pa.list_(kind)), pa.array(inner, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int32())])))],
            names=["a", "b", "n", "lang", "phrase", "cuts", "inner"])


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def mine(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
         swallowed: int = 80, sample: int = 16, sample_count: int = 2) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    a is the phrase's count, l and r those of the two parts at the cut of the lowest score
    floor(2000000 a / (l + r)); phrases inside a longer one with ``swallowed`` percent of
    their count or more are left out.  Parts of a frequent phrase are frequent, so every count
    is at hand.  Ranks are found per language and hash part first.
    """
    counts, named = frequent_phrases(df, text_col=text_col, lang_col=lang_col, least=least, sample=sample,
                                     sample_count=sample_count)
    shape = ("a long, b int, n long, lang string, phrase string, cuts array<struct<k:long,la:long,lb:int,ra:long,rb:int>>, "
             "inner array<struct<a:long,b:int>>")
    phrases = stored(named.mapInArrow(_parts, shape))
    cuts = phrases.select("a", "b", F.col("n").alias("f"), F.explode("cuts").alias("c")).select("a", "b", "f", "c.*")
    left = counts.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("n").alias("l"))
    right = counts.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("n").alias("r"))
    scored = cuts.join(left, ["la", "lb"]).join(right, ["ra", "rb"]).withColumn(
        "score", F.expr("cast((cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as bigint)"))
    lowest = scored.groupBy("a", "b").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = phrases.select(F.col("n").alias("f"), F.explode("inner").alias("i")).groupBy("i.a", "i.b").agg(F.max("f").alias("over"))
    kept = (phrases.select("a", "b", "n", "lang", "phrase").join(longer, ["a", "b"], "left")
            .filter(F.col("over").isNull() | (_wide("over") * 100 < _wide("n") * swallowed)).drop("over"))
    rows = kept.join(lowest, ["a", "b"]).select(
        "lang", "phrase", F.col("n").alias("a"), F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)
    totals = totals_of(df, lang_col, counts)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def totals_of(df: DataFrame, lang_col: str, counts: DataFrame) -> DataFrame:
    """(lang, n): all words of every language, from the counts under the keys of the languages."""
    langs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).distinct()

    def keyed(batches):
        for batch in batches:
            keys = [lang_key(x) for x in strings(batch.column("lang"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([int(k.view(np.int64)[0]) for k in keys], pa.int64()),
                                              pa.array([int(_low(k[1:])[0]) for k in keys], pa.int32())], names=["lang", "a", "b"])

    return langs.mapInArrow(keyed, "lang string, a long, b int").join(counts, ["a", "b"]).select("lang", "n")
