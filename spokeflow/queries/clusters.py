"""Clustering and neighbours over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spokeflow.operators import components, dbscan, knn
from spokeflow.queries import query, table

_PAIRS = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= 1.15 * 1.15),
d AS (SELECT v.id, count(p.b) AS n FROM v LEFT JOIN p ON p.a = v.id GROUP BY 1)"""


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query(f"WITH {_PAIRS} SELECT id, n FROM d WHERE n > 0")
def radius_neighbours(spark, sf):
    return dbscan.neighbour_counts(_points(spark, sf), 1.15)


@query(f"WITH {_PAIRS} SELECT a, b FROM p")
def radius_pairs(spark, sf):
    return dbscan.neighbour_pairs(_points(spark, sf), 1.15)


def _dbscan_sql(self_counts: int) -> str:
    return f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT id FROM d WHERE n + {self_counts} >= 4), e AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach), k AS (SELECT id, min(reach) AS cluster FROM r GROUP BY 1),
o AS (SELECT p.b AS id, min(k.cluster) AS cluster FROM p JOIN k ON k.id = p.a WHERE p.b NOT IN (SELECT id FROM c) GROUP BY 1)
SELECT d.id, coalesce(k.cluster, o.cluster) AS cluster, d.n + {self_counts} >= 4 AS core FROM d LEFT JOIN k USING (id) LEFT JOIN o ON o.id = d.id"""


@query(_dbscan_sql(1))
def dbscan_counting_self(spark, sf):
    return dbscan.dbscan(_points(spark, sf), 1.15, 4)


@query(_dbscan_sql(0))
def dbscan_excluding_self(spark, sf):
    return dbscan.dbscan(_points(spark, sf), 1.15, 4, count_self=False)


@query(f"SELECT cluster, count(*) AS points, count(CASE WHEN core THEN 1 END) AS cores FROM ({_dbscan_sql(1)}) GROUP BY 1")
def cluster_sizes(spark, sf):
    return dbscan.cluster_sizes(dbscan.dbscan(_points(spark, sf), 1.15, 4))


def _nearest_sql(which: str, k: int) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
d AS (SELECT q.id AS query, v.id, list_sum(list_transform(list_zip(q.x, v.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v q JOIN v ON q.id <> v.id WHERE {which}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM d)
SELECT query, id, round(sqrt(d), 6) AS distance, rank::INT AS rank FROM r WHERE rank <= {k}"""


@query(_nearest_sql("q.id % 20 = 0", 9))
def nearest_neighbours(spark, sf):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    pts = _points(spark, sf)
    out = dbscan.nearest_neighbours(pts, pts.where("id % 20 = 0"), 9)
    return out.withColumn("distance", F.round("distance", 6))


@query(_nearest_sql("true", 5))
def nearest_neighbour_join(spark, sf):
    """All points against all, by cells and their bounds."""
    out = knn.nearest_neighbour_join(_points(spark, sf), 5, block=256)
    return out.withColumn("distance", F.round("distance", 6))


@query(f"WITH {_PAIRS}, c AS (SELECT d.id, k.cluster, d.n + 1 >= 4 AS core FROM d LEFT JOIN ({_dbscan_sql(1)}) k USING (id)), s AS (SELECT cluster FROM c WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT id, CASE WHEN cluster IN (SELECT cluster FROM s) THEN cluster END AS cluster, core AND cluster IN (SELECT cluster FROM s) AS core FROM c")
def dbscan_lone_points_noise(spark, sf):
    """A cluster of one point is noise, as where clusters are trees of at least two."""
    return dbscan.dbscan(_points(spark, sf), 1.15, 4, lone_is_noise=True)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey::BIGINT AS a, (c_nationkey * 7 + 3) % 25 AS b FROM customer), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT DISTINCT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def graph_components(spark, sf):
    """The edges of all customers."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("src"), ((F.col("c_nationkey") * 7 + 3) % 25).cast("bigint").alias("dst"))
    return components.connected_components(c)
