"""Queries of the network and routing operators, with oracles that say the same in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines
from ..operators import coverage, journeys, roadgraph
from ..sources import adapters as own
from ..sources import files
from .images import QUERIES as _images  # noqa: F401 - one way to make relations
from .images import SEGMENT, lined, rows
from .dialect import duck_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def mark(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck_text(oracle)
        return f

    return mark


_EDGE = f"({own.EDGES}) e"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as a directed network lists it: every street both ways, tags as lists."""
    e = rows(spark, sf_dir, f"SELECT * FROM {_EDGE}")
    tags = [F.lit("0").alias("key"), F.array(F.when(F.col("steps"), F.lit("steps")).otherwise(F.lit("footway")), F.lit("path")).alias("highway"), F.when(F.col("edge") % 5 != 0, F.array("surface", F.lit("gravel"), "surface")).alias("surface"), F.when(F.col("wheelchair_no"), F.array(F.lit("no"))).alias("wheelchair"), F.array(F.concat(F.lit("street "), F.col("u").cast("string"))).alias("name"), F.array(F.col("edge").cast("string"), F.lit("7")).alias("osmid")]
    there = e.select((F.col("edge") * 2).alias("ord"), "u", "v", "length", *tags, F.lit(None).cast("array<struct<x:double,y:double>>").alias("line"))
    bend = F.array(*[lines.xy(F.col(a), F.col(b)) for a, b in (("x1", "y1"), ("x2", "y2"))])
    back = e.select((F.col("edge") * 2 + 1).alias("ord"), F.col("v").alias("u"), F.col("u").alias("v"), "length", *[t for t in tags], bend.alias("line"))
    return there.unionByName(back)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, own.NODES).select("node", F.col("x").alias("lon"), F.col("y").alias("lat"))


@query(f"SELECT row_number() OVER (ORDER BY edge) - 1 AS edge, u, v, 40.0 AS len, CASE WHEN edge % 5 = 0 THEN '' ELSE least(surface, 'gravel') || '|' || greatest(surface, 'gravel') END AS surface, wheelchair_no, steps, 'street ' || u AS name, x1 || ' ' || y1 || ',' || x2 || ' ' || y2 AS coords FROM {_EDGE}")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing graph's edges with their tags, numbered."""
    made = roadgraph.edge_list(places(spark, sf_dir), listed(spark, sf_dir))
    at = F.array_join(F.transform("coords", lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ",")
    return made.select("edge", "u", "v", "len", F.array_join("surface", "|").alias("surface"), "wheelchair_no", "steps", "name", at.alias("coords"))


_NAMED = "SELECT s_suppkey AS id, s_suppkey * 7 % n AS a, s_suppkey * 7 % n + CASE WHEN s_suppkey % 3 = 0 THEN 40 ELSE 1 END AS b FROM {supplier}, (SELECT count(*) AS n FROM {customer}) c"


@query(f"SELECT id, (SELECT min(k.n) FROM (SELECT u, v, row_number() OVER (ORDER BY edge) - 1 AS n FROM {_EDGE}) k WHERE (k.u = s.a AND k.v = s.b) OR (k.u = s.b AND k.v = s.a)) AS edge FROM ({_NAMED}) s")
def matched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barriers that name an edge by its ends, in either direction; null for edges that the graph has not."""
    bars = rows(spark, sf_dir, _NAMED).select("id", *[F.when(F.col("id") % 2 == 0, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("edge_u", "a", "b"), ("edge_v", "b", "a"))], F.lit("0").alias("edge_key"))
    return roadgraph.matched(bars, roadgraph.edge_list(places(spark, sf_dir), listed(spark, sf_dir))).select("id", "edge")


_STEPS = f"SELECT 'osm-steps-' || n AS id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, n AS edge FROM (SELECT *, row_number() OVER (ORDER BY edge) - 1 AS n FROM {_EDGE}) k WHERE steps"
_KERBS = "SELECT p_partkey AS osm_id, CASE p_size % 4 WHEN 0 THEN 'raised' WHEN 1 THEN 'flush' WHEN 2 THEN 'lowered' ELSE 'no' END AS kerb, p_partkey * 37 % 1600 + 0.37 AS x, p_partkey * 53 % 1500 + 0.61 AS y FROM {part}"
_NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY edge) - 1 AS n FROM {_EDGE}) k"
_KERBED = f"SELECT osm_id, kerb, arg_min(n, (round(d, 6), n)) AS edge FROM (SELECT p.osm_id, p.kerb, k.n, {SEGMENT.format(px='p.x', py='p.y', ax='k.x1', ay='k.y1', bx='k.x2', by='k.y2')} AS d FROM ({_KERBS}) p JOIN {_NUMBERED} ON p.x BETWEEN k.x1 - 5 AND k.x2 + 5 AND p.y BETWEEN k.y1 - 5 AND k.y2 + 5 WHERE p.kerb <> 'no') q WHERE d <= 5 GROUP BY osm_id, kerb"
_ON = f"SELECT 0 AS g, 0 AS k, 'd' || s_suppkey AS id, 'narrow' AS type, 'detected' AS source, s_suppkey % 100 AS edge FROM {{supplier}} UNION ALL SELECT 1, edge, id, 'stairs', 'osm', edge FROM ({_STEPS}) s UNION ALL SELECT 2, osm_id, 'osm-kerb-' || osm_id, CASE kerb WHEN 'raised' THEN 'raised_curb' ELSE 'curb_ramp' END, 'osm', edge FROM ({_KERBED}) t"


def _on(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = roadgraph.edge_list(places(spark, sf_dir), listed(spark, sf_dir)).withColumn("line", F.transform("coords", lambda p: lines.xy(p["lon"], p["lat"])))
    seen = rows(spark, sf_dir, "SELECT concat('d', s_suppkey) AS id, 'narrow' AS type, s_suppkey % 100 / 100.0 AS conf, s_suppkey % 100 AS edge, 0.25 AS t FROM {supplier}")
    return made, roadgraph.on_edges(seen, made, rows(spark, sf_dir, _KERBS))


@query(f"SELECT row_number() OVER (ORDER BY g, k, id) - 1 AS ord, id, type, source, edge FROM ({_ON}) o")
def steps_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All barriers of the routing graph in order: detected, steps, kerbs of the map."""
    return _on(spark, sf_dir)[1].select("ord", "id", "type", "source", "edge")


@query(f"SELECT (SELECT count(*) FROM ({own.NODES}) n) AS nodes, count(*) AS edges, (SELECT count(*) FROM ({_ON}) o) AS barriers, (SELECT count(*) FROM {{supplier}}) AS detected_on_graph, (SELECT count(*) FROM ({_KERBED}) t) AS osm_kerbs, count_if(steps) AS osm_steps_edges, count_if(wheelchair_no) AS wheelchair_no_edges FROM {_EDGE}")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing graph in numbers."""
    made, bars = _on(spark, sf_dir)
    return roadgraph.graph_stats(rows(spark, sf_dir, own.NODES), made, bars)


@query("SELECT u, v, min(ord) AS ord, any_value(n) AS n FROM (SELECT least(o_custkey, o_orderkey % 1500) AS u, greatest(o_custkey, o_orderkey % 1500) AS v, o_orderkey AS ord, count(*) OVER (PARTITION BY least(o_custkey, o_orderkey % 1500), greatest(o_custkey, o_orderkey % 1500)) AS n FROM {orders}) o GROUP BY u, v")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that are listed both ways, once: the first of each."""
    both = rows(spark, sf_dir, "SELECT o_orderkey AS ord, o_custkey AS a, o_orderkey % 1500 AS b FROM {orders}")
    ways = both.select("ord", F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("key"))
    kept = roadgraph.undirected(ways).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "ord")
    n = ways.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"))
    return kept.join(n, ["u", "v"])


@query("SELECT l_partkey % 40 + l_suppkey % 40 AS ends, length, count(*) AS n, sum(ord) AS ords FROM (SELECT least(l_partkey % 40, l_suppkey % 40) AS l_partkey, greatest(l_partkey % 40, l_suppkey % 40) AS l_suppkey, round(l_quantity / 3.0, 1) AS length, min(l_orderkey * 10 + l_linenumber) AS ord, l_linenumber % 2 AS id FROM {lineitem} GROUP BY ALL HAVING true) q GROUP BY ALL".replace("min(l_orderkey * 10 + l_linenumber) AS ord, l_linenumber % 2 AS id", "l_linenumber % 2 AS id, min(l_orderkey * 10 + l_linenumber) AS ord"))
def physical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets of equal ends, ids in any order, and length, once."""
    ways = rows(spark, sf_dir, "SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey % 40 AS u, l_suppkey % 40 AS v, CASE WHEN l_orderkey % 2 = 0 THEN array(l_linenumber % 2, 9) ELSE array(9, l_linenumber % 2) END AS osmid, l_quantity / 3.0 AS length FROM {lineitem}")
    kept = roadgraph.physical(ways)
    return kept.groupBy((F.col("u") + F.col("v")).alias("ends"), F.round("length", 1).alias("length")).agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


@query(f"SELECT surface AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(edge)) AS pos FROM {_EDGE} GROUP BY surface")
def surface_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces, the commonest first."""
    return coverage.by_first(rows(spark, sf_dir, f"SELECT edge AS ord, surface FROM {_EDGE}"), F.col("surface"))


@query(f"SELECT surface, count(*) AS edges, round(sum(length), 1) AS metres, round(count(*) / (SELECT count(*) FROM {_EDGE}), 6) AS edge_share, round(sum(length) / (SELECT sum(length) FROM {_EDGE}), 6) AS length_share FROM {_EDGE} GROUP BY surface")
def surface_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and metres by surface."""
    e = rows(spark, sf_dir, f"SELECT * FROM {_EDGE}")
    each = e.groupBy("surface").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 1).alias("metres"))
    whole = e.agg(F.count("*").alias("_n"), F.sum("length").alias("_m"))
    return each.crossJoin(F.broadcast(whole)).select("surface", "edges", "metres", F.round(F.col("edges") / F.col("_n"), 6).alias("edge_share"), F.round(F.col("metres") / F.col("_m"), 6).alias("length_share"))


@query(f"SELECT node, (SELECT count(*) FROM {_EDGE} WHERE e.u = n.node) + (SELECT count(*) FROM {_EDGE} WHERE e.v = n.node) AS degree FROM ({own.NODES}) n WHERE degree > 0")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edge ends each crossing has."""
    return rows(spark, sf_dir, f"SELECT u, v FROM {_EDGE}").select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


@query(f"WITH RECURSIVE s AS (SELECT u AS a, v AS b FROM {_EDGE} WHERE surface <> 'MACHINERY' UNION SELECT v, u FROM {_EDGE} WHERE surface <> 'MACHINERY'), r(id, reach) AS (SELECT node, node FROM ({own.NODES}) n UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.reach), c AS (SELECT id, min(reach) AS c FROM r GROUP BY id) SELECT c AS component, count(*) AS nodes, (SELECT coalesce(sum(length), 0) FROM {_EDGE} WHERE surface <> 'MACHINERY' AND e.u IN (SELECT id FROM c d WHERE d.c = c.c)) AS length FROM c GROUP BY c ORDER BY length DESC, c LIMIT 5")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest pieces of the network without one surface."""
    return coverage.top_components(rows(spark, sf_dir, own.NODES), rows(spark, sf_dir, f"SELECT * FROM {_EDGE} WHERE surface <> 'MACHINERY'"))


_POINTS = "SELECT p_partkey AS pid, p_partkey * 37 % 1600 + 0.37 AS x, p_partkey * 53 % 1500 + 0.61 AS y FROM {part}"


@query(f"SELECT pid, edge, round(d, 4) AS distance_m FROM (SELECT p.pid, e.edge, {SEGMENT.format(px='p.x', py='p.y', ax='e.x1', ay='e.y1', bx='e.x2', by='e.y2')} AS d FROM ({_POINTS}) p JOIN {_EDGE} ON p.x BETWEEN e.x1 - 12 AND e.x2 + 12 AND p.y BETWEEN e.y1 - 12 AND e.y2 + 12) q WHERE d <= 12")
def snap_to_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges within twelve metres of each point."""
    return roadgraph.near_edges(rows(spark, sf_dir, _POINTS), lined(rows(spark, sf_dir, f"SELECT * FROM {_EDGE}")), 12.0).select("pid", "edge", F.round("d", 4).alias("distance_m"))


@query(f"SELECT pid, node, round(d, 3) AS distance_m FROM (SELECT p.pid, n.node, sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2)) AS d, row_number() OVER (PARTITION BY p.pid ORDER BY round(sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2)), 6), n.node) AS k FROM ({_POINTS}) p JOIN ({own.NODES}) n ON abs(n.x - p.x) <= 10 AND abs(n.y - p.y) <= 10) q WHERE k = 1 AND d <= 10")
def snap_to_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest crossing within ten metres of each point."""
    others = rows(spark, sf_dir, own.NODES).select(F.col("node").alias("ord"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return roadgraph.nearest_point(rows(spark, sf_dir, _POINTS), others, 10.0).select("pid", F.col("o_ord").alias("node"), F.round("o_m", 3).alias("distance_m"))


#: Up to three barriers an edge: their place, type and confidence follow from the edge.
_BARS = f"SELECT edge * 10 + k AS ord, 'b' || (edge * 10 + k) AS id, CASE (edge + k) % 4 WHEN 0 THEN 'stairs' WHEN 1 THEN 'rough_surface' WHEN 2 THEN 'curb_ramp' ELSE 'raised_curb' END AS type, (edge * 7 + k * 31) % 100 / 100.0 AS conf, ((edge + k * 3) % 11) / 10.0 AS t, edge FROM ({own.EDGES}) e, (VALUES (0), (1), (2), (4)) AS z(k) WHERE (edge + k) % 3 = 0"
_TOP = f"SELECT e.edge, e.length, e.surface, e.wheelchair_no, b.type, max(b.conf) AS conf FROM ({own.EDGES}) e LEFT JOIN ({_BARS}) b ON b.edge = e.edge AND b.t >= 0.2 AND b.t <= 0.9 GROUP BY e.edge, e.length, e.surface, e.wheelchair_no, b.type"
_RULES = "(VALUES ('wheelchair', 'stairs', true, 0.0), ('wheelchair', 'raised_curb', true, 0.0), ('wheelchair', 'rough_surface', false, 150.0), ('wheelchair', 'curb_ramp', false, -5.0), ('stroller', 'stairs', true, 0.0), ('stroller', 'raised_curb', false, 40.0), ('stroller', 'rough_surface', false, 60.0), ('stroller', 'curb_ramp', false, -3.0), ('suitcase', 'stairs', false, 250.0), ('suitcase', 'rough_surface', false, 80.0), ('suitcase', 'raised_curb', false, 0.0), ('suitcase', 'curb_ramp', false, 0.0)) AS r(profile, type, forbidden, penalty)"
_FACTORS = "(VALUES ('wheelchair', 'BUILDING', 1.5), ('wheelchair', 'MACHINERY', 2.0), ('stroller', 'MACHINERY', 1.8), ('suitcase', 'MACHINERY', 1.2)) AS f(profile, surface, factor)"


@query(f"""SELECT profile, edge, round(CASE WHEN way * factor + due < way / 10 THEN way / 10 ELSE way * factor + due END, 3) AS cost, shut OR (wheelchair_no AND profile = 'wheelchair') AS blocked FROM (
  SELECT p.profile, t.edge, t.wheelchair_no, t.length * 0.7 AS way, coalesce(any_value(f.factor), 1.0) AS factor, coalesce(sum(CASE WHEN r.forbidden THEN CASE WHEN t.conf < 0.6 THEN 400 ELSE 0 END ELSE r.penalty * t.conf END), 0) AS due, coalesce(bool_or(r.forbidden AND t.conf >= 0.6), false) AS shut
  FROM ({_TOP}) t CROSS JOIN (VALUES ('wheelchair'), ('stroller'), ('suitcase')) AS p(profile) LEFT JOIN {_RULES} ON r.profile = p.profile AND r.type = t.type LEFT JOIN {_FACTORS} ON f.profile = p.profile AND f.surface = t.surface GROUP BY p.profile, t.edge, t.wheelchair_no, t.length) c""")
def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it costs each profile to walk from a fifth to nine tenths of each edge, by the strongest barriers met."""
    from .network import PROFILES

    known = F.broadcast(journeys.profile_rows(spark, PROFILES))  # settings
    return _met(spark, sf_dir).join(known, how="cross").withColumn("factor", journeys.surface_factor(F.array("surface"), F.col("multipliers"), {})).select(
        "profile", "edge", journeys.priced(F.lit(0.7), F.col("met"), 0.6, 400.0).alias("c")).select("profile", "edge", F.round("c.cost", 3).alias("cost"), "c.blocked")


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = rows(spark, sf_dir, _BARS).groupBy("edge").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "id", "type", F.col("conf").cast("double").alias("conf"), "t"))).alias("bars"))
    e = rows(spark, sf_dir, f"SELECT edge, length AS len, surface, wheelchair_no FROM {_EDGE}").join(bars, "edge", "left")
    none = F.array().cast("array<string>")
    return e.withColumn("met", F.coalesce(journeys.strongest(F.col("bars"), F.lit(0.9), F.lit(0.2), none), F.slice(journeys.strongest(F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("ord", "long"), ("id", "string"), ("type", "string"), ("conf", "double"), ("t", "double"))])), F.lit(0.0), F.lit(1.0), none), 1, 0)))


@query(f"SELECT edge, type, id AS barrier, conf AS confidence FROM ({_BARS}) b WHERE t BETWEEN 0.2 AND 0.9 QUALIFY row_number() OVER (PARTITION BY edge, type ORDER BY conf DESC, ord) = 1")
def strongest_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest barrier of each type that a walk along a part of each edge meets."""
    return _met(spark, sf_dir).select("edge", F.explode("met").alias("m")).select("edge", "m.type", F.col("m.id").alias("barrier"), F.col("m.conf").alias("confidence"))


@query(f"SELECT e.edge, coalesce(string_agg(n || ' ' || type, ', ' ORDER BY type), 'none') AS problems FROM ({own.EDGES}) e LEFT JOIN (SELECT edge, type, count(*) AS n FROM ({_BARS}) b GROUP BY edge, type) g ON g.edge = e.edge GROUP BY e.edge")
def problem_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barriers of each edge in words."""
    bars = rows(spark, sf_dir, _BARS).groupBy("edge").agg(F.collect_list("type").alias("kinds"))
    e = rows(spark, sf_dir, f"SELECT edge FROM {_EDGE}").join(bars, "edge", "left")
    return e.select("edge", journeys.problem_text(journeys._counted(F.coalesce("kinds", F.array().cast("array<string>")))).alias("problems"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 52 + (o_custkey % 1000) / 1000.0 END AS lat, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 8.5 END AS lon FROM {orders}")
def parse_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from text; what is not two numbers has none."""
    df = rows(spark, sf_dir, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN concat('52.', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), ', 8.5') WHEN o_orderkey % 2 = 0 THEN '52.0' WHEN o_orderkey % 3 = 0 THEN 'x,8.5' ELSE '1,2,3' END AS t FROM {orders}")
    return df.select("id", journeys.parsed_place(F.col("t")).alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("SELECT layer, count(*) AS n FROM (SELECT unnest([CASE WHEN p_size % 2 = 0 THEN 'kerbs' END, CASE WHEN p_size % 3 = 0 THEN 'crossings' END, CASE WHEN p_size % 5 = 0 THEN 'barriers' END]) AS layer FROM {part} WHERE p_partkey % 4 > 0 UNION ALL SELECT CASE p_size % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'major_roads' END FROM {part} WHERE p_partkey % 4 = 0) x WHERE layer IS NOT NULL GROUP BY layer")
def osm_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements by layer; one may be in several."""
    df = rows(spark, sf_dir, "SELECT p_partkey AS osm_id, p_size AS k FROM {part}")
    node, k = F.col("osm_id") % 4 > 0, F.col("k")
    pair = lambda when, key, value: F.when(when, F.struct(F.lit(key), F.lit(value)))
    tags = F.map_from_entries(F.array_compact(F.array(pair(node & (k % 2 == 0), "kerb", "raised"), pair(node & (k % 3 == 0), "highway", "crossing"), pair(node & (k % 5 == 0), "barrier", "gate"), pair(~node & (k % 3 == 0), "highway", "steps"), pair(~node & (k % 3 == 1), "highway", "motorway_link"), pair(~node & (k % 3 == 2), "highway", "footway"))))
    return files.layers(df.select("osm_id", F.when(node, "node").otherwise("way").alias("osm_type"), F.when(node, "Point").otherwise("LineString").alias("geom_type"), tags.alias("tags"))).groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT 'kerbs' AS selector, count_if(p_size % 2 = 0) AS total FROM {part} UNION ALL SELECT 'large', count_if(p_size > 40) FROM {part} UNION ALL SELECT 'none', 0")
def counts_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements each selector finds."""
    return coverage.counted(rows(spark, sf_dir, "SELECT p_size FROM {part}"), {"kerbs": F.col("p_size") % 2 == 0, "large": F.col("p_size") > 40, "none": F.lit(None).cast("boolean")})
