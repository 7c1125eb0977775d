"""Registered queries of the text operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autotab.llm import (langid, mtree, order_minhash, packing, phrases, pii, prefix_trie, secret_scan, shards, simhash,
                          sp_sample, token_counts, toxicity)
from autotab.llm.common import fold_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers as P
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def _piece_model() -> str:
    import public_tokenizers as P
    return P.path("piece_bpe_32k.model")


def op1_sentencepiece_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sampled segmentations of every document, without replacement, with their piece ids."""
    return sp_sample.sample(_table(spark, sf_dir, "documents"), _piece_model(), k=4)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of all documents with the smallest doc_id reachable over links of 2 bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of fold 0 of 5 are held out."""
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return toxicity.predict(docs, net).select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of all documents and of their edited texts."""
    return order_minhash.edited_pairs(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _piece_model())


def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector."""
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, scale=256.0, k=5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) AS r
WHERE rank <= 5
"""


def op7_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; fold 2 of 4 is held out."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, fold_of(F.col("doc_id"), 4) != 2).select(
        "doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 24 shards of row counts at most one apart."""
    return shards.shard_rows(_table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; owner: the source, repository: the source and language."""
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH src AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
         concat_ws('/', source, lang) AS repository FROM documents),
found AS (
  SELECT rid, text, ord, least FROM src, (VALUES (0, 8), (1, 16), (2, 32), (3, 20)) AS k(ord, least)),
lists AS (
  SELECT rid, ord, least, CASE ord
      WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 0)
      WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0)
      WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]{32,}', 0)
      ELSE regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}', 0) END AS hit,
    CASE ord
      WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1)
      WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0)
      WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]{32,}', 0)
      ELSE regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}', 0) END AS val,
    CASE ord
      WHEN 0 THEN string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]+')
      WHEN 2 THEN string_split_regex(text, '[0-9a-f]{32,}')
      ELSE string_split_regex(text, '[A-Za-z0-9+/_-]{20,}') END AS gap
  FROM found),
each AS (
  SELECT rid, ord, least, unnest(range(1, len(hit) + 1)) AS i, hit, val, gap FROM lists WHERE len(hit) > 0),
spans AS (
  SELECT rid, ord, val[i] AS value,
    coalesce(list_sum([length(g) for g in gap[1:i]]), 0) + coalesce(list_sum([length(h) for h in hit[1:i-1]]), 0) AS s,
    coalesce(list_sum([length(g) for g in gap[1:i]]), 0) + coalesce(list_sum([length(h) for h in hit[1:i]]), 0) AS e
  FROM each WHERE length(val[i]) >= least),
wanted AS (
  SELECT * FROM spans WHERE ord < 3
  UNION ALL
  SELECT t.* FROM spans t WHERE ord = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]')
    AND regexp_matches(value, '[A-Z]') AND len(list_distinct(string_split(value, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.rid = t.rid AND b.ord < 3 AND b.s < t.e AND t.s < b.e)),
held AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT {'o': owner, 'r': repository}) AS repositories
  FROM wanted JOIN src USING (rid) GROUP BY value),
rated AS (
  SELECT w.*, owners, repositories, ['assign', 'access', 'hex', 'token'][ord + 1] || ':' || s || ':' || e AS name
  FROM wanted w JOIN held USING (value) WHERE ord < 3 OR (owners = 1 AND repositories < 4)),
rows AS (
  SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access,
    count(*) FILTER (ord = 2) AS n_hex, string_agg(name, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
    string_agg(name, ',' ORDER BY s, ord) AS spans, count(*) FILTER (ord = 3) AS n_token,
    count(*) FILTER (owners = 1 AND repositories < 4) AS n_owner_specific,
    count(*) FILTER (owners >= 3 OR repositories >= 4) AS n_copied, max(repositories) AS max_repositories
  FROM rated GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_token, 0) AS n_token,
  coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_copied, 0) AS n_copied,
  coalesce(max_repositories, 0) AS max_repositories
FROM src LEFT JOIN rows USING (rid)
"""


def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into windows of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), *_byte_bpe(), window=1024)


def op11_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: fixed shapes and what learned contexts add."""
    return pii.find_personal(_table(spark, sf_dir, "documents"))


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents."""
    return phrases.mine(_table(spark, sf_dir, "documents"), least=30, top=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)),
counted AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counted WHERE a >= 30),
cuts AS (
  SELECT o.lang, o.phrase, c.cut, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * o.a) // (x.a + y.a) AS BIGINT) AS score
  FROM often o JOIN (VALUES (1), (2), (3)) AS c(cut) ON c.cut < o.k
  JOIN often x ON x.lang = o.lang AND x.phrase = array_to_string(o.w[1:c.cut], ' ')
  JOIN often y ON y.lang = o.lang AND y.phrase = array_to_string(o.w[c.cut + 1:o.k], ' ')),
low AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts) AS t WHERE nth = 1),
inside AS (
  SELECT o.lang, array_to_string(o.w[i:j], ' ') AS phrase, max(o.a) AS longer
  FROM often o, (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS p(i, j) WHERE p.j <= o.k AND p.j - p.i + 1 < o.k GROUP BY ALL),
kept AS (
  SELECT o.lang, o.phrase, o.a FROM often o LEFT JOIN inside s ON s.lang = o.lang AND s.phrase = o.phrase
  WHERE o.k >= 2 AND (s.longer IS NULL OR 100 * s.longer::HUGEINT < 80 * o.a::HUGEINT)),
ranked AS (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY l.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, l.l, l.r, l.score
  FROM kept k JOIN low l ON l.lang = k.lang AND l.phrase = k.phrase)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), group=5, heads=9)


#: CRC-32 bit by bit over the digits of an id.
_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))")

OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT *, conv_id - conv_id % 5 AS base, xor({_CRC}, 4294967295) % 9 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:c.h] END, c.turns[c.h + 1:len(c.turns)]) AS t
  FROM headed c LEFT JOIN own b ON b.conv_id = c.base),
member AS (SELECT conv_id, d AS depth, t[1:d] AS p, len(t) = d AS ended FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
    FILTER (ended), '')) AS ends_sha256 FROM member GROUP BY depth, p),
child AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.p[n.depth].text)) END AS saved
  FROM node n LEFT JOIN child c ON c.depth = n.depth AND c.p = n.p),
subtree AS (
  SELECT u AS depth, p[1:u] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM full_node) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  n.ends_sha256
FROM full_node n JOIN subtree s ON s.depth = n.depth AND s.p = n.p
LEFT JOIN node q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]
"""


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece_topk,
    op2_simhash_dedup,
    op3_toxicity_cnn,
    op4_order_minhash,
    op5_token_counts,
    op6_mtree_topk,
    op7_language_ecoc,
    op8_hypergeometric_shards,
    op9_secret_scan,
    op10_bestfit_packing,
    op11_pii_bootstrap,
    op12_toivonen_phrases,
    op13_prefix_trie,
)}

ORACLES: dict[str, str] = {
    "op6_mtree_topk": OP6_SQL,
    "op9_secret_scan": OP9_SQL,
    "op12_toivonen_phrases": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
