"""Personal data by bootstrapped contextual extraction.

E-mail addresses, IP addresses, card numbers and phone numbers of fixed shapes are the
seed entities.  The words around every entity make lexical patterns: the two words
before it, or the word before and the word after it, with what stands between.
Other tokens that look like identifiers (four digits or more) are the candidates;
patterns and the values they surround form a bipartite graph over the whole corpus.
Spark scores it in rounds: a pattern is worth the mean confidence of the distinct values it
surrounds (seeds count fully, unknown ones nothing), a candidate what its accepted patterns say together;
candidates of high confidence count in the next round.  Every candidate that an accepted
pattern surrounds is reported as ``context``, beside the seeds.

Scores are integers (thousandths), so they do not depend on the order of addition.  Only
digests of entities are shuffled; edges are distinct (pattern, value) pairs, so
copies of a passage count once, and patterns with too few values for acceptance leave before the rounds.

Defined cases: a null text is the empty text and has no spans; repeated rows get the same spans each; a null
id is kept; tokens that touch a seed are no candidates; without seeds nothing is
added; an empty table gives no rows; other columns are not read; work is linear in a text's length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import stored, strings
from autotab.session import release

KINDS = ("email", "ip", "card", "phone", "context")

#: Fixed values of the query contract (without retries inside a run that cannot match).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates: runs of these characters with three digits in a row, at least this long and with so many digits.
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/#-")
TOKEN_LENGTH, TOKEN_DIGITS = 6, 4
_THREE = re.compile("[0-9]{3}")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s+")
FILE_ROWS = 250_000                 # entities per file of the graph
BEFORE, AFTER, GAP = 64, 32, 6      # characters looked at around an entity, and between it and a word


def emails(text: str) -> list[tuple[int, int, int]]:
    """Spans of addresses; from each @ the local part is read backwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            s = at
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append((s, 0, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities of fixed shape, by start and kind."""
    out = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                parts = [p.lstrip("0") for p in m[0].split(".")]
                if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                    out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of identifier-like tokens that touch none of ``taken``."""
    out, done, at = [], 0, 0
    held = sorted((s, e) for s, _, e in taken)
    m = _THREE.search(text)
    while m:
        s, e, n = m.start(), m.end(), len(text)
        while s > done and text[s - 1] in TOKEN:
            s -= 1
        while e < n and text[e] in TOKEN:
            e += 1
        done = e
        a, b = s, e
        while text[a] in "._/#-":
            a += 1
        while text[b - 1] in "._/#-":
            b -= 1
        while at < len(held) and held[at][1] <= a:
            at += 1
        free = all(x >= b or y <= a for x, y in held[at:at + len(KINDS)])
        if free and b - a >= TOKEN_LENGTH and len(_DIGIT.findall(text, a, b)) >= TOKEN_DIGITS:
            out.append((a, b))
        m = _THREE.search(text, e)
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of the entity at ``start``: two words before; the words on both sides."""
    words = list(_WORD.finditer(text, max(0, start - BEFORE), start))[-2:]
    if not words or start - words[-1].end() > GAP:
        return []
    gap = _BLANK.sub(" ", text[words[-1].end():start])
    out = []
    if len(words) == 2:
        out.append(f"{words[0][0]} {words[1][0]}{gap}_".lower())
    after = _WORD.search(text, end, min(len(text), end + AFTER))
    if after and after.start() - end <= GAP:
        out.append(f"{words[-1][0]}{gap}_{_BLANK.sub(' ', text[end:after.start()])}{after[0]}".lower())
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.int64()),
                             ("patterns", pa.list_(pa.string()))]))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, found) per row, written once to the shared folder: a number of its own, the
    seed spans, and of seeds and candidates with a context the value's hash and the patterns."""
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash
        for b in batches:
            base, found = [], []
            for text in strings(b.column("text")):
                spans = seeds(text)
                base.append([{"start": s, "ord": k, "end": e} for s, k, e in spans])
                rows = [(s, e, True) for s, _, e in spans] + [(s, e, False) for s, e in candidates(text, spans)]
                own = []
                for s, e, seed in rows:
                    patterns = contexts(text, s, e)
                    if patterns:
                        value = xxhash.xxh3_64_intdigest(text[s:e].lower().encode("utf-8", "surrogatepass"))
                        own.append({"start": s, "end": e, "seed": seed, "value": value - (1 << 63), "patterns": patterns})
                found.append(own)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, _SPANS), pa.array(found, _FOUND)],
                                             names=["doc_id", "base", "found"])

    out = src.mapInArrow(run, f"doc_id {kind}, base array<struct<start:int,ord:int,end:int>>, "
                              "found array<struct<start:int,end:int,seed:boolean,value:long,patterns:array<string>>>")
    return stored(out.withColumn("row", F.monotonically_increasing_id()))


def graph(scanned: DataFrame, least_values: int) -> DataFrame:
    """(pattern, value, seed): distinct edges of the patterns around ``least_values`` values or more."""
    each = scanned.select(F.explode("found").alias("f")).select(
        F.explode("f.patterns").alias("pattern"), F.col("f.value").alias("value"), F.col("f.seed").cast("int").alias("seed"))
    edges = each.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.max("seed").alias("known")).filter(
        F.col("values") >= least_values).select("pattern")
    return edges.join(enough, "pattern")


def score_patterns(edges: DataFrame, trusted: DataFrame, least_values: int, pattern_score: int) -> DataFrame:
    """(pattern, values, known, score) of the accepted patterns, given (value, trust) of known values."""
    near = edges.join(trusted, "value", "left").withColumn("trust", F.coalesce("trust", F.lit(0).cast("long")))
    return (near.groupBy("pattern").agg(F.count("*").alias("values"), F.sum((F.col("trust") > 0).cast("long")).alias("known"),
                                        F.sum("trust").alias("trust"))
            .withColumn("score", F.expr("trust div (`values` + 1L)"))
            .filter((F.col("known") >= least_values) & (F.col("score") >= pattern_score))
            .select("pattern", "values", "known", "score"))


def trust_values(edges: DataFrame, accepted: DataFrame, value_trust: int) -> DataFrame:
    """(value, trust): seeds with 1000, and candidates whose accepted patterns together make them likely enough."""
    weight = F.round(-F.log(F.lit(1.0) - F.col("score") / 1000.0) * 1000).cast("long")
    said = (edges.filter("seed = 0").join(accepted.select("pattern", "score"), "pattern")
            .groupBy("value").agg(F.sum(weight).alias("w"))
            .select("value", F.round((F.lit(1.0) - F.exp(-F.col("w") / 1000.0)) * 1000).cast("long").alias("trust"))
            .filter(F.col("trust") >= value_trust))
    sure = edges.filter("seed = 1").select("value", F.lit(1000).cast("long").alias("trust"))
    return sure.union(said).groupBy("value").agg(F.max("trust").alias("trust"))


def learn(scanned: DataFrame, *, least_values: int = 3, pattern_score: int = 600, value_trust: int = 700,
          rounds: int = 4) -> DataFrame:
    """(pattern, values, known, score) of the patterns accepted after at most ``rounds`` rounds; rounds
    end early when no further value is trusted."""
    found = scanned.agg(F.sum(F.size("found"))).first()[0] or 0
    parts = max(8, found // FILE_ROWS)      # few files for few entities
    edges = stored(graph(scanned, least_values).coalesce(parts))
    none = edges.select("pattern", F.lit(0).alias("score")).limit(0)
    trusted = stored(trust_values(edges, none, value_trust).coalesce(parts))
    count = trusted.count()
    for _ in range(rounds):
        accepted = score_patterns(edges, trusted, least_values, pattern_score)
        now = stored(trust_values(edges, accepted, value_trust).coalesce(parts))
        last, count = count, now.count()
        if count == last:      # what was trusted already makes the same patterns
            release(now)
            break
        release(trusted)
        trusted = now
    accepted = stored(score_patterns(edges, trusted, least_values, pattern_score).coalesce(parts))
    release(edges, trusted)
    return accepted


def find_personal(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_values: int = 3,
                  pattern_score: int = 600, value_trust: int = 700, rounds: int = 4) -> DataFrame:
    """Per row of ``df``: doc_id, numbers of the seed kinds, base_sha256, spans and the number of added spans.

    A pattern is accepted with ``least_values`` known values and a score of ``pattern_score`` thousandths; a
    candidate counts as known from ``value_trust`` thousandths on.
    """
    scanned = scan(df, id_col=id_col, text_col=text_col)
    accepted = learn(scanned, least_values=least_values, pattern_score=pattern_score, value_trust=value_trust, rounds=rounds)
    loose = scanned.select("row", F.explode(F.filter("found", lambda f: ~f.seed)).alias("f")).select(
        "row", F.struct(F.col("f.start").alias("start"), F.lit(4).alias("ord"), F.col("f.end").alias("end")).alias("span"),
        F.explode("f.patterns").alias("pattern"))
    added = loose.join(accepted.select("pattern"), "pattern").groupBy("row").agg(F.collect_set("span").alias("added"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", names[s.ord], s.start.cast("string"), s.end.cast("string"))), ",")

    def of(k: int):
        return F.size(F.filter("base", lambda s: s.ord == k)).cast("bigint")

    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return scanned.select("row", "doc_id", "base").join(added, "row", "left").select(
        "doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_context"))
