"""Neighbour, clustering, reduction and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from autotab.operators import anomaly as A
from autotab.operators import cluster as C
from autotab.operators import layout as L
from autotab.operators import neighbours as N
from autotab.operators import reduce as RD
from autotab.plans import fixtures as X
from autotab.plans.registry import plan

PS = f"({X.PART_SQL})"
EMB = "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


def blobs(spark, d):
    """part rows as 2-D points (x, y) with their planted blob."""
    p = X.part(spark, d)
    return p.select("p_partkey", F.array("x", "y").alias("features"),
                    F.col("blob").alias("cluster"))


def emb(spark, d):
    return X.table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def spikes(spark, d):
    e = X.events(spark, d)
    return e.select("event_id", F.array(F.col("spiked")).alias("features"), "spiked", "truth")


# --------------------------------------------------------------- neighbours
KNN_SQL = f"""
SELECT vec_id, neighbor, rank, dist FROM (
  SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS dist,
         cast(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)
              as integer) AS rank
  FROM {EMB} a JOIN {EMB} b ON a.vec_id <> b.vec_id) WHERE rank <= 5"""


@plan("knn_join", rnd=("dist",), sql=KNN_SQL)
def q_knn_join(spark, d):
    e = emb(spark, d)
    return N.knn_join(e, e, 5, "vec_id", "features", exclude_self=True)


@plan("range_join", sql=f"""
SELECT a.p_partkey, count(*) AS n_within FROM {PS} a JOIN {PS} b
  ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05
GROUP BY a.p_partkey""")
def q_range_join(spark, d):
    return N.neighbour_counts(blobs(spark, d), 0.05, "p_partkey", "features")


# ---------------------------------------------------------------- clusters
#: The planted blobs, numbered by their smallest member.
BLOB_SQL = f"""
SELECT p_partkey, cast(dense_rank() OVER (ORDER BY first) - 1 as integer) AS cluster
FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY blob) AS first FROM {PS})"""


@plan("cluster_kmeans", sql=BLOB_SQL)
def q_cluster_kmeans(spark, d):
    return C.renumber_clusters(C.cluster_kmeans(blobs(spark, d), ["p_partkey"], k=3), "p_partkey")


@plan("cluster_gmm", sql=BLOB_SQL)
def q_cluster_gmm(spark, d):
    return C.renumber_clusters(C.cluster_gmm(blobs(spark, d), ["p_partkey"], k=3), "p_partkey")


@plan("cluster_hierarchical", sql=BLOB_SQL)
def q_cluster_hierarchical(spark, d):
    return C.renumber_clusters(C.cluster_hierarchical(blobs(spark, d), ["p_partkey"], k=3), "p_partkey")


DBSCAN_SQL = f"""
WITH RECURSIVE p AS (SELECT p_partkey AS id, x, y FROM {PS}),
e AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON abs(a.x - b.x) <= 0.1
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.1),
core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 5),
ce AS (SELECT i, j FROM e WHERE i IN (FROM core) AND j IN (FROM core)),
reach(root, i) AS (
  SELECT i, i FROM core
  UNION SELECT r.root, ce.j FROM reach r JOIN ce ON r.i = ce.i WHERE r.root <= ce.j),
lab AS (SELECT i, min(root) AS c FROM reach GROUP BY i),
mem AS (SELECT i AS id, c FROM lab UNION ALL
  SELECT e.i, min(lab.c) FROM e JOIN lab ON e.j = lab.i WHERE e.i NOT IN (FROM core) GROUP BY e.i),
num AS (SELECT c, dense_rank() OVER (ORDER BY first) - 1 AS cluster
        FROM (SELECT c, min(id) AS first FROM mem GROUP BY c))
SELECT p.id AS p_partkey, cast(coalesce(num.cluster, -1) as integer) AS cluster
FROM p LEFT JOIN mem ON mem.id = p.id LEFT JOIN num ON num.c = mem.c"""


@plan("cluster_dbscan", sql=DBSCAN_SQL)
def q_cluster_dbscan(spark, d):
    return C.cluster_dbscan(blobs(spark, d), "p_partkey", eps=0.1, min_samples=5)


@plan("attach_labels", sql=f"SELECT p_partkey, p_name, p_size, blob AS cluster FROM {PS}")
def q_attach_labels(spark, d):
    raw = X.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return C.attach_labels(raw, blobs(spark, d).select("p_partkey", "cluster"), ["p_partkey"])


@plan("cluster_sizes", sql=f"""
SELECT blob AS cluster, count(*) AS n, (SELECT count(DISTINCT blob) FROM {PS} WHERE blob <> -1)
  AS n_clusters FROM {PS} GROUP BY blob""")
def q_cluster_sizes(spark, d):
    return C.cluster_sizes(blobs(spark, d))


SIL_SQL = f"""
WITH p AS (SELECT p_partkey AS id, blob AS c, x, y FROM {PS}),
m AS (SELECT a.id, a.c AS own, b.c, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS md
      FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.c, b.c),
ab AS (SELECT id, max(CASE WHEN c = own THEN md END) AS a, min(CASE WHEN c <> own THEN md END) AS b
       FROM m GROUP BY id)
SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
FROM ab"""


@plan("silhouette", rnd=("silhouette",), sql=SIL_SQL)
def q_silhouette(spark, d):
    return C.silhouette(blobs(spark, d), "p_partkey", "cluster", "features")


@plan("calinski_harabasz", rnd=("calinski_harabasz",), digits=3, sql=f"""
WITH p AS (SELECT blob AS c, x, y FROM {PS}),
g AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p),
cc AS (SELECT c, avg(x) AS cx, avg(y) AS cy, count(*) AS nc FROM p GROUP BY c),
b AS (SELECT sum(nc * ((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) AS b, count(*) AS k FROM cc, g),
w AS (SELECT sum((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS w FROM p JOIN cc USING (c))
SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM b, w, g""")
def q_calinski_harabasz(spark, d):
    return C.calinski_harabasz(blobs(spark, d))


@plan("davies_bouldin", rnd=("davies_bouldin",), sql=f"""
WITH p AS (SELECT blob AS c, x, y FROM {PS}),
cc AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY c),
s AS (SELECT c, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS s FROM p JOIN cc USING (c)
      GROUP BY c),
cs AS (SELECT * FROM cc JOIN s USING (c))
SELECT avg(r) AS davies_bouldin FROM (
  SELECT a.c, max((a.s + b.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS r
  FROM cs a JOIN cs b ON a.c <> b.c GROUP BY a.c)""")
def q_davies_bouldin(spark, d):
    return C.davies_bouldin(blobs(spark, d))


# --------------------------------------------------------------- reduction
PCA_CTE = f"""
WITH p AS (SELECT p_partkey, x, y FROM {PS}),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM p),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
                (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM m),
v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS v1x, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS v1y,
                b / sqrt(b * b + (l2 - a) * (l2 - a)) AS v2x, (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) AS v2y
      FROM e),
f AS (SELECT *, CASE WHEN (CASE WHEN abs(v1x) >= abs(v1y) THEN v1x ELSE v1y END) < 0 THEN -1 ELSE 1 END AS s1,
                CASE WHEN (CASE WHEN abs(v2x) >= abs(v2y) THEN v2x ELSE v2y END) < 0 THEN -1 ELSE 1 END AS s2
      FROM v)"""


@plan("reduce_pca", rnd=("Component_1", "Component_2"), digits=5, sql=PCA_CTE + """
SELECT p_partkey, ((x - mx) * v1x + (y - my) * v1y) * s1 AS Component_1,
       ((x - mx) * v2x + (y - my) * v2y) * s2 AS Component_2 FROM p, f""")
def q_reduce_pca(spark, d):
    return RD.reduce_pca(blobs(spark, d), ["p_partkey"], 2)


EV_SQL = PCA_CTE + """
SELECT 1 AS component, l1 / (l1 + l2) AS explained_variance_ratio FROM f
UNION ALL SELECT 2, l2 / (l1 + l2) FROM f"""


@plan("explained_variance", rnd=("explained_variance_ratio",), sql=EV_SQL)
def q_explained_variance(spark, d):
    return RD.explained_variance(blobs(spark, d), 2)


@plan("cumulative_variance", rnd=("explained_variance_ratio", "cumulative"), sql=f"""
SELECT component, explained_variance_ratio,
  sum(explained_variance_ratio) OVER (ORDER BY component) AS cumulative,
  sum(explained_variance_ratio) OVER (ORDER BY component) >= 0.95 AS reaches_mark FROM ({EV_SQL})""")
def q_cumulative_variance(spark, d):
    return RD.cumulative_variance(RD.explained_variance(blobs(spark, d), 2))


@plan("project_2d")
def q_project_2d(spark, d):
    e = emb(spark, d)
    return RD.project_2d(e, ["vec_id"], ["label"])


@plan("reduce_ica")
def q_reduce_ica(spark, d):
    return RD.reduce_ica(blobs(spark, d), ["p_partkey"], 2)


@plan("reduce_nmf")
def q_reduce_nmf(spark, d):
    p = X.table(spark, d, "part").select(
        "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"))
    return RD.reduce_nmf(p, ["p_partkey"], 2)


# ----------------------------------------------------------------- anomaly
LOF_SQL = f"""
WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d
           FROM {EMB} a JOIN {EMB} b ON a.vec_id <> b.vec_id),
nb AS (SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM p)
       WHERE rn <= 20),
kd AS (SELECT i, max(d) AS kdist FROM nb GROUP BY i),
lrd AS (SELECT nb.i, 1.0 / avg(greatest(kd.kdist, nb.d)) AS lrd FROM nb JOIN kd ON nb.j = kd.i GROUP BY nb.i),
lof AS (SELECT nb.i AS vec_id, avg(l2.lrd) / any_value(l1.lrd) AS anomaly_score
        FROM nb JOIN lrd l1 ON nb.i = l1.i JOIN lrd l2 ON nb.j = l2.i GROUP BY nb.i)
SELECT vec_id, anomaly_score,
  cast(anomaly_score > (SELECT quantile_cont(anomaly_score, 0.9) FROM lof) AS integer) AS is_anomaly
FROM lof"""


@plan("anomaly_lof", rnd=("anomaly_score",), sql=LOF_SQL)
def q_anomaly_lof(spark, d):
    return A.anomaly_lof(emb(spark, d), "vec_id", 20, 0.1)


@plan("anomaly_isolation_forest")
def q_anomaly_isolation_forest(spark, d):
    return A.anomaly_isolation_forest(spikes(spark, d), "event_id", 0.01)


@plan("anomaly_elliptic")
def q_anomaly_elliptic(spark, d):
    return A.anomaly_elliptic(spikes(spark, d), "event_id", 0.01)


@plan("anomaly_one_class")
def q_anomaly_one_class(spark, d):
    return A.anomaly_one_class(spikes(spark, d), "event_id", 0.01)


FLAG_SQL = f"""
SELECT event_id, spiked AS anomaly_score,
  cast(spiked > (SELECT quantile_cont(spiked, 0.99) FROM {X.EVENTS_SQL.join('()')}) AS integer) AS is_anomaly
FROM ({X.EVENTS_SQL})"""


@plan("flag_anomalies", sql=FLAG_SQL)
def q_flag_anomalies(spark, d):
    s = spikes(spark, d).select("event_id", F.col("spiked").alias("anomaly_score"))
    return A.flag_anomalies(s, "event_id", 0.01)


@plan("anomaly_summary", rnd=("anomaly_pct",), sql=f"""
SELECT cast(sum(is_anomaly) as bigint) AS n_anomalies, count(*) AS n_rows, avg(is_anomaly) * 100 AS anomaly_pct
FROM ({FLAG_SQL})""")
def q_anomaly_summary(spark, d):
    s = spikes(spark, d).select("event_id", F.col("spiked").alias("anomaly_score"))
    return A.anomaly_summary(A.flag_anomalies(s, "event_id", 0.01))


def _attached(spark, d):
    s = spikes(spark, d).select("event_id", F.col("spiked").alias("anomaly_score"))
    raw = X.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return A.attach_anomalies(raw, A.flag_anomalies(s, "event_id", 0.01), "event_id")


ATTACHED_SQL = f"""
SELECT e.event_id, e.user_id, e.event_type, e.value, f.anomaly_score, f.is_anomaly
FROM events e JOIN ({FLAG_SQL}) f USING (event_id)"""


@plan("attach_anomalies", sql=ATTACHED_SQL)
def q_attach_anomalies(spark, d):
    return _attached(spark, d)


@plan("top_anomalies", sql=f"""
SELECT * FROM ({ATTACHED_SQL}) WHERE is_anomaly = 1 ORDER BY anomaly_score DESC, event_id LIMIT 20""")
def q_top_anomalies(spark, d):
    return A.top_anomalies(_attached(spark, d), "event_id", 20)


# ------------------------------------------- detectors against planted spikes
DETECTORS = {"isolation_forest": A.anomaly_isolation_forest, "elliptic": A.anomaly_elliptic,
             "one_class": A.anomaly_one_class}


def _finds(name):
    def build(spark, d):
        rows = spikes(spark, d)
        flags = DETECTORS[name](rows, "event_id", 0.01)
        j = flags.join(rows.select("event_id", "truth"), "event_id")
        true, hit = F.col("truth") == 1, F.col("is_anomaly") == 1
        return j.agg(F.count_if(true).alias("n_planted"),
                     (F.count_if(true & hit) >= 0.9 * F.count_if(true)).alias("found"),
                     (F.count_if(~true & hit) <= 0.01 * F.count_if(~true)).alias("precise"))
    return build


for _name in DETECTORS:
    plan(f"anomaly_{_name}_finds", sql=f"""
SELECT count_if(truth = 1) AS n_planted, true AS found, true AS precise FROM ({X.EVENTS_SQL})""")(_finds(_name))


@plan("neighbour_embedding")
def q_neighbour_embedding(spark, d):
    return L.neighbour_embedding(blobs(spark, d), "p_partkey")


@plan("neighbour_embedding_trust", sql=f"SELECT count(*) AS n_rows, true AS trusted FROM {PS}")
def q_neighbour_embedding_trust(spark, d):
    rows = blobs(spark, d)
    placed = L.neighbour_embedding(rows, "p_partkey")
    return L.trustworthiness(rows, placed, 10, "p_partkey").select("n_rows", (F.col("trustworthiness") > 0.9).alias("trusted"))


@plan("cluster_spectral", sql=BLOB_SQL)
def q_cluster_spectral(spark, d):
    return C.renumber_clusters(C.cluster_spectral(blobs(spark, d), "p_partkey", 3), "p_partkey")
