"""Secret scan with corpus-wide ownership frequency.

Every text is searched for assignments, access keys and long hexadecimal runs
(the base kinds), and for bare tokens that look like credentials.  The values
found are hashed; per hash the corpus is asked how many distinct owners and
repositories hold it.  A value held by ``copied_owners`` owners or ``copied_repositories``
repositories or more is a widely copied example; one held by a single owner, in fewer repositories, is
owner-specific.  A bare token is reported only if it is owner-specific and touches no base span; base
spans are always reported, with their class counted beside them.

Everything is DataFrame functions: positions come from the lengths of the
matches and of the text between them, block by block, so the work is linear in a text's hits.  Only
digests of the hits are shuffled; values that many rows hold are joined in parts.

Defined cases: a null text is the empty text and has no spans; a null owner or
repository counts as one value of its own; repeated rows get the same result each; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import id_text, stored, unused

#: Fixed values of the query contract, in the order in which spans are listed.
ASSIGN = ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX_LONG = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "token")

#: Bare tokens: runs of at least this length with a digit, both letter cases and
#: at least this many distinct characters.
TOKEN = "[A-Za-z0-9+/_-]{20,}"
TOKEN_DISTINCT = 10

_SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"

#: Hits or spans of a text handled in one go; longer lists go block by block, so work stays linear.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _blocks(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))


def _of_block(b: Column, n: Column) -> Column:
    """Positions (from 0) of block ``b`` of a list of ``n``."""
    return F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, n) - 1)


def _spans(text: Column, seen: Column, pattern: str, ord_: int, value_group: int, keep) -> Column:
    """Structs (start, ord, end, md5 of the value) of the matches that ``keep`` accepts;
    ``seen`` is a cheap test that a text without any match fails."""
    parts = {"hit": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "gap": F.split(text, pattern, -1)}
    if value_group:
        parts["value"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    found = F.struct(*[c.alias(k) for k, c in parts.items()])

    def step(f, i):
        return F.length(f.gap[i]) + F.length(f.hit[i])

    def walk(f, n, begin, b):
        """Spans of one block, whose text begins at ``begin``."""
        start = F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("out"))
        value = (lambda i: f.value[i]) if value_group else (lambda i: f.hit[i])
        return F.aggregate(_of_block(b, n), start, lambda a, i: F.struct(
            (a.at + step(f, i)).alias("at"),
            F.when(keep(value(i)), F.concat(a.out, F.array(F.struct(
                (a.at + F.length(f.gap[i])).alias("start"), F.lit(ord_).alias("ord"),
                (a.at + step(f, i)).alias("end"), F.md5(value(i)).alias("value"))))).otherwise(a.out).alias("out")),
            lambda a: a.out)

    def place(f):
        n = F.size(f.hit)
        sizes = F.transform(_blocks(n), lambda b: F.aggregate(_of_block(b, n), F.lit(0), lambda a, i: a + step(f, i)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        many = _let(begins, lambda at: F.flatten(F.transform(_blocks(n), lambda b: walk(f, n, at[b], b))))
        return F.when(n > BLOCK, many).when(n > 0, walk(f, n, F.lit(0), F.lit(0))).otherwise(F.array().cast(_SPAN))

    return F.when(seen, _let(found, place)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds, by start and kind."""
    return F.array_sort(F.concat(
        _spans(text, text.rlike(ASSIGN), ASSIGN, 0, 1, lambda v: F.length(v) >= 8),
        _spans(text, text.contains("AKIA"), ACCESS, 1, 0, lambda v: F.length(v) >= 16),
        _spans(text, text.rlike(HEX_LONG), HEX_LONG, 2, 0, lambda v: F.length(v) >= 32)))


def token_spans(text: Column, base: Column) -> Column:
    """Credential-looking bare tokens that touch no base span."""
    looks = (lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
             & (F.size(F.array_distinct(F.split(v, ""))) >= TOKEN_DISTINCT))
    found = _spans(text, text.rlike(TOKEN), TOKEN, 3, 0, looks)
    return F.filter(found, lambda t: ~F.exists(base, lambda b: (b.start < t.end) & (t.start < b.end)))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kind[s.ord], s.start.cast("string"), s.end.cast("string"))), ",")


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, key, owner, repository, base, token) per row, written once to the shared
    folder; ``key`` stands for the id and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    src = df.select(
        F.col(id_col).alias("doc_id"), text.alias("text"),
        F.md5(F.concat(F.col(id_col).isNull().cast("string"), id_text(F.col(id_col)),
                       F.lit("\n"), text)).alias("key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        base_spans(text).alias("base"))
    return stored(src.select("doc_id", "key", "owner", "repository", "base",
                             token_spans(F.col("text"), F.col("base")).alias("token")))


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, owners, repositories, rows): distinct holders of every candidate hash, and its hits."""
    held = scanned.filter((F.size("base") > 0) | (F.size("token") > 0)).select(
        "owner", "repository", F.explode(F.concat("base", "token")).alias("s"))
    return (held.select("owner", "repository", F.col("s.value").alias("value"))
            .groupBy("value", "owner", "repository").agg(F.count("*").alias("rows"))
            .groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("rows").alias("rows"))
            .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                  F.sum("rows").alias("rows")))


def specific(copied_repositories: int) -> Column:
    """Whether a value belongs to one owner and is not spread over its repositories."""
    return (F.col("owners") == 1) & (F.col("repositories") < copied_repositories)


def classified(scanned: DataFrame, copied_owners: int = 3, copied_repositories: int = 4) -> DataFrame:
    """(key, spans, n_token, n_owner_specific, n_copied, max_repositories) per key with a reported span.

    A value that holds more than 1/200 of the hits (at most 200 of them) is joined in 32 parts.
    """
    hits = (scanned.filter((F.size("base") > 0) | (F.size("token") > 0))
            .select("key", F.explode(F.concat("base", "token")).alias("s"))
            .select("key", F.col("s.value").alias("value"), "s"))
    held = stored(ownership(scanned))
    total = held.agg(F.sum("rows")).first()[0] or 0
    hot = [r.value for r in held.filter(F.col("rows") * 200 > total).select("value").collect()]
    parts = F.when(F.col("value").isin(hot), F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("value").isin(hot), F.pmod(F.xxhash64("key"), F.lit(32)).cast("int")).otherwise(0)
    rated = hits.withColumn("salt", salt).join(held.withColumn("salt", F.explode(parts)), ["value", "salt"]).filter(
        (F.col("s.ord") < 3) | specific(copied_repositories))
    spans = rated.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(
        "s.start", "s.ord", "s.end", "owners", "repositories"))).alias("spans"))
    return spans.select(
        "key", "spans",
        F.size(F.filter("spans", lambda s: s.ord == 3)).cast("bigint").alias("n_token"),
        F.size(F.filter("spans", lambda s: (s.owners == 1) & (s.repositories < copied_repositories))).cast("bigint")
        .alias("n_owner_specific"),
        F.size(F.filter("spans", lambda s: (s.owners >= copied_owners) | (s.repositories >= copied_repositories)))
        .cast("bigint").alias("n_copied"),
        F.array_max(F.transform("spans", lambda s: s.repositories)).alias("max_repositories"))


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 owner: Column | None = None, repository: Column | None = None,
                 copied_owners: int = 3, copied_repositories: int = 4) -> DataFrame:
    """Per row of ``df``: doc_id, counts of the base kinds, base_sha256, spans, the counts of added,
    owner-specific and widely copied spans, and the largest number of repositories that hold one of its values."""
    scanned = scan(df, id_col=id_col, text_col=text_col, owner=owner, repository=repository)
    rated = classified(scanned, copied_owners, copied_repositories)

    def of(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s.ord == k)).cast("bigint")

    none = F.lit(0).cast("bigint")
    return scanned.join(rated, "key", "left").select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"),
        *[F.coalesce(c, none).alias(c) for c in ("n_token", "n_owner_specific", "n_copied", "max_repositories")])


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """``df`` with every reported span of its texts replaced by ``mark`` (overlapping
    spans by one mark); columns, rows and null texts stay as they are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = scan(df, id_col=id_col, text_col=text_col, owner=owner, repository=repository)
    tokened = scanned.filter(F.size("token") > 0)
    key, spans = unused(df, "_key", "_spans")
    rated = classified(scanned).join(tokened.select("key").distinct(), "key", "left_semi").select(
        F.col("key").alias(key), F.col("spans").alias(spans))

    def bare(c: Column) -> Column:
        return F.transform(c, lambda s: F.struct(s.start.alias("start"), s.ord.alias("ord"), s.end.alias("end")))

    def cleaned(out: DataFrame) -> DataFrame:
        return out.withColumn(text_col, F.when(F.size(spans) > 0, masked(text, F.col(spans), mark)).otherwise(
            F.col(text_col))).select(*df.columns)

    # texts without a run that could be a bare token hold base spans only: no join, no shuffle of texts
    maybe = text.rlike(TOKEN)
    plain = df.filter(~maybe).withColumn(spans, bare(base_spans(text)))
    own = F.md5(F.concat(F.col(id_col).isNull().cast("string"), id_text(F.col(id_col)), F.lit("\n"), text))
    joined_ = df.filter(maybe).withColumn(key, own).join(rated, key, "left").withColumn(
        spans, F.coalesce(bare(F.col(spans)), bare(base_spans(text))))
    return cleaned(plain).unionByName(cleaned(joined_))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its sorted ``spans`` replaced, overlapping ones by one mark; each block of spans reads
    its own part of the text."""
    empty = F.array().cast("array<string>")

    def block(b: Column, n: Column, before: Column) -> Column:
        """Pieces up to the last span of a block; ``before``: how far earlier spans reach."""
        def cut(part: Column) -> Column:
            start = F.struct(before.alias("at"), empty.alias("out"))
            return F.aggregate(_of_block(b, n), start, lambda a, i: F.when(spans[i].start < a.at, F.struct(
                F.greatest(a.at, spans[i].end).alias("at"), a.out.alias("out"))).otherwise(F.struct(
                    spans[i].end.alias("at"),
                    F.concat(a.out, F.array(F.substring(part, a.at - before + 1, spans[i].start - a.at), F.lit(mark))).alias("out"))),
                lambda a: a.out)
        return _let(F.substring(text, before + 1, spans[F.least(b * BLOCK + BLOCK, n) - 1].start - before), cut)

    n = F.size(spans)
    reach = F.transform(_blocks(n), lambda b: F.array_max(F.transform(_of_block(b, n), lambda i: spans[i].end)))
    all_ = _let(reach, lambda r: F.concat(
        F.array_join(F.flatten(F.transform(_blocks(n), lambda b: block(b, n, F.when(
            b > 0, F.array_max(F.slice(r, F.lit(1), b))).otherwise(0)))), ""),
        F.substring(text, F.array_max(r) + 1, F.length(text))))
    return all_
