"""The registered queries and their SQL. Every query runs library operators; its DuckDB text is written apart from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, routing
from ..sources import adapters as own
from . import answers, graphs, images, network, summaries
from .dialect import duck_text, spark_text
from .images import _CHORD, _META, _AHEAD, rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_EDGE = f"({own.EDGES}) e"


def _read(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(spark_text(sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of the UTM zone of places all over the world."""
    return rows(spark, sf_dir, f"SELECT event_id AS id, {geo.utm_epsg('lon', 'lat')} AS epsg FROM (SELECT event_id, event_id % 360 - 180.0 AS lon, event_id % 160 - 80.0 AS lat FROM {{events}}) e")


QUERIES["utm_zone"] = utm_zone
ORACLES["utm_zone"] = duck_text("SELECT event_id AS id, CAST((CASE WHEN event_id % 160 < 80 THEN '327' ELSE '326' END) || lpad(CAST(event_id % 360 // 6 + 1 AS VARCHAR), 2, '0') AS INT) AS epsg FROM {events}")


def haversine_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to each image from the one before it, on the sphere."""
    before = f"SELECT id, lon, lat, coalesce(lag(lon) OVER w, lon) AS lon1, coalesce(lag(lat) OVER w, lat) AS lat1 FROM {_META} WINDOW w AS (PARTITION BY sequence ORDER BY captured_at, ord)"
    return rows(spark, sf_dir, f"SELECT id, round({geo.haversine('lon1', 'lat1', 'lon', 'lat')}, 3) AS hop_m FROM ({before}) b")


QUERIES["haversine_hops"] = haversine_hops
ORACLES["haversine_hops"] = duck_text(f"SELECT id, round(2 * 6371008.8 * asin({_CHORD.format('lon1', 'lat1', 'lon', 'lat')} / 2), 3) AS hop_m FROM ({_AHEAD}) a")


def edge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the network without steps and unsuitable edges, with nodes and length; the label is the smallest node."""
    nodes, edges = _read(spark, sf_dir, own.NODES, "customer"), _read(spark, sf_dir, own.EDGES, "customer").where("NOT steps AND NOT wheelchair_no")
    found = graph.components(nodes.select(F.col("node").alias("id")), edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    length = edges.join(found, edges["u"] == found["id"]).groupBy("component").agg(F.sum("length").alias("metres"))
    return found.groupBy("component").agg(F.count("*").alias("nodes")).join(length, "component", "left").select("component", "nodes", F.coalesce("metres", F.lit(0.0)).alias("metres"))


QUERIES["edge_components"] = edge_components
ORACLES["edge_components"] = duck_text(f"""WITH RECURSIVE n AS ({own.NODES}), e AS (SELECT * FROM ({own.EDGES}) e0 WHERE NOT steps AND NOT wheelchair_no),
s AS (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e), r(id, reach) AS (SELECT node, node FROM n UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.reach),
c AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
SELECT component, count(*) AS nodes, coalesce(max(m.metres), 0.0) AS metres FROM c LEFT JOIN (SELECT c.component AS k, sum(e.length) AS metres FROM e JOIN c ON c.id = e.u GROUP BY c.component) m ON m.k = c.component GROUP BY component""")


_REQUESTS = "SELECT s_suppkey AS request, s_suppkey * 37 % n AS start, s_suppkey * 53 % n AS end_ FROM {supplier}, (SELECT count(*) AS n FROM {customer}) c"
_COSTED = f"SELECT edge, u, v, length, greatest(0.1 * length, length * CASE surface WHEN 'MACHINERY' THEN 2.0 ELSE 1.0 END) AS cost, steps OR wheelchair_no AS blocked FROM {_EDGE}"


def accessible_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest against accessible routes of a batch of requests over the walking lattice."""
    requests = _read(spark, sf_dir, _REQUESTS, "supplier", "customer").withColumnRenamed("end_", "end")
    found = routing.routes(requests, _read(spark, sf_dir, _COSTED, "customer"), _read(spark, sf_dir, own.NODES, "customer"), paths=False)
    return found.select("request", "baseline_m", "accessible_m", "violations", "same_route", "warning")


def network_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least walking lengths from two nodes to all others, by distributed relaxation."""
    requests = spark.sql("SELECT * FROM VALUES (0L, 0L), (1L, 57L) AS r(request, start)")
    return routing.relax(requests, _read(spark, sf_dir, _COSTED, "customer").select("u", "v", F.col("length").alias("cost"))).select("request", "node", "dist")


QUERIES |= {"accessible_routes": accessible_routes, "network_distances": network_distances}
#: On the lattice without gaps a shortest path is as long as the steps between rows and columns (all rows are full, so none is cut off).
ORACLES["network_distances"] = duck_text(f"""SELECT r.request, n.node, 40.0 * (abs(n.node % 40 - r.start % 40) + abs(n.node // 40 - r.start // 40)) AS dist FROM ({own.NODES}) n CROSS JOIN (VALUES (0, 0), (1, 57)) AS r(request, start)""")

for _part in (images, graphs, answers, network, summaries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
