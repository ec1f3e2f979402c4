"""Walking network: undirected edges, largest component, snapping in two steps, barriers on edges, and the routing graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines
from .graph import components
from .ordered import numbered

KERBS = {"raised": "raised_curb", "lowered": "curb_ramp", "flush": "curb_ramp"}
SNAP_M, CURB_M, KERB_M = 12.0, 10.0, 5.0


def undirected(edges: DataFrame) -> DataFrame:
    """Edges (ord, u, v, key, ...) once per way: of (u, v, key) and (v, u, key) the first by ord."""
    first = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), "key").orderBy("ord")
    return edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def physical(edges: DataFrame) -> DataFrame:
    """Edges (ord, u, v, osmid array, length, ...) once per street: of equal ends, sorted ids and length to a decimetre the first
    by ord, whichever way it runs."""
    first = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), F.array_join(F.array_sort("osmid"), ","), F.round(F.coalesce("length", F.lit(0.0)), 1)).orderBy("ord")
    return edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def united(*layers: DataFrame) -> DataFrame:
    """Elements (osm_type, osm_id, ...) of several selections, each once."""
    both = layers[0]
    for x in layers[1:]:
        both = both.unionByName(x)
    return both.dropDuplicates(["osm_type", "osm_id"])


def first(values: Column) -> Column:
    """The first of a merged tag's values; null of none."""
    return F.get(values, F.lit(0))


def values(tag: Column) -> Column:
    """All values of a merged tag; none for null."""
    return F.coalesce(tag, F.array().cast("array<string>"))


def joined(tag: Column) -> Column:
    """Sorted distinct values in one text, null of none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(values(tag))), ", "), F.lit(""))


def as_text(df: DataFrame) -> DataFrame:
    """`df` with array columns as JSON text, for formats without lists."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() == "array"})


def edge_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The routing graph's edges, numbered from 0 in order of ord. nodes: node, lon, lat; edges: ord, u, v, key, length, highway,
    surface, wheelchair and name as array<string>, line (of x, y in degrees) or null.

    Gives edge, u, v, key, len, surface (sorted), wheelchair_no, steps, name, coords from u to v to six digits."""
    end = lambda c, p: nodes.select(F.col("node").alias(c), F.struct("lon", "lat").alias(p))
    own = undirected(edges).join(end("u", "_u"), "u").join(end("v", "_v"), "v")
    straight = F.array(*[lines.xy(F.col(f"{p}.lon"), F.col(f"{p}.lat")) for p in ("_u", "_v")])
    line = lines.rounded(lines.oriented(F.coalesce(F.col("line"), straight), F.col("_u.lon"), F.col("_u.lat")))
    own = own.select(
        "ord", "u", "v", "key", F.round("length", 2).alias("len"), F.array_sort(F.array_distinct(values(F.col("surface")))).alias("surface"), F.array_contains(values(F.col("wheelchair")), "no").alias("wheelchair_no"),
        F.array_contains(values(F.col("highway")), "steps").alias("steps"), joined(F.col("name")).alias("name"), F.transform(line, lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat"))).alias("coords"),
    )
    return numbered(own, [F.col("ord")], "edge").withColumn("edge", F.col("edge") - 1).drop("ord")


def matched(detected: DataFrame, edges: DataFrame) -> DataFrame:
    """Snapped barriers (edge_u, edge_v, edge_key, ...) with the `edge` (edge, u, v, key) they name, in either direction; null for
    those whose edge is not in the graph, so that misses can be counted."""
    names = edges.select("edge", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"), "key")
    names = names.groupBy(F.col("e.u").alias("edge_u"), F.col("e.v").alias("edge_v"), F.col("key").alias("edge_key")).agg(F.min("edge").alias("edge"))
    return detected.join(names, ["edge_u", "edge_v", "edge_key"], "left")


def graph_stats(nodes: DataFrame, edges: DataFrame, barriers: DataFrame) -> DataFrame:
    """One row: nodes, edges, barriers and those detected, edges with steps, kerbs of the map, edges that forbid wheelchairs."""
    own = edges.agg(F.count("*").alias("edges"), F.count_if("steps").alias("osm_steps_edges"), F.count_if("wheelchair_no").alias("wheelchair_no_edges"))
    bars = barriers.agg(F.count("*").alias("barriers"), F.count_if(F.col("source") == "detected").alias("detected_on_graph"), F.count_if(F.col("id").startswith("osm-kerb-")).alias("osm_kerbs"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(own).crossJoin(bars)  # one row each


def largest_component(nodes: DataFrame, edges: DataFrame, by: str = "length") -> DataFrame:
    """The nodes of the component with the greatest total edge length, or with by='nodes' the most nodes; ties: the smallest label."""
    found = components(nodes.select(F.col("node").alias("id")), edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("_nodes"))
    if by == "length":
        metres = edges.join(found, edges["u"] == found["id"]).groupBy("component").agg(F.sum("length").alias("_size"))
        sizes = sizes.join(metres, "component", "left").select("component", F.coalesce("_size", F.lit(0.0)).alias("_size"))
    else:
        sizes = sizes.select("component", F.col("_nodes").alias("_size"))
    top = sizes.orderBy(F.desc("_size"), "component").limit(1)
    kept = found.join(F.broadcast(top.select("component")), "component", "left_semi")
    return nodes.join(kept.select(F.col("id").alias("node")), "node", "left_semi")


def near_edges(points: DataFrame, edges: DataFrame, reach: float, least: float = 25.0) -> DataFrame:
    """(pid, edge, d, t, x, y) of all edges (edge, line) within `reach` of points (pid, x, y): distance, fraction and place of
    the nearest point of each, on the first of equally near segments.

    Segments go to the cells of their boxes widened by `reach`, points to one cell of `least` at least: an equi-join by cell,
    no pair of all."""
    size = max(reach * 2, least)
    seg = edges.select("edge", F.inline(lines.runs(F.col("line"))))
    span = lambda f, k, d: F.floor((f(f"a.{k}", f"b.{k}") + d) / size)
    dealt = seg.withColumn("cx", F.explode(F.sequence(span(F.least, "x", -reach), span(F.greatest, "x", reach)))).withColumn("cy", F.explode(F.sequence(span(F.least, "y", -reach), span(F.greatest, "y", reach))))
    near = points.select("pid", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).join(dealt, ["cx", "cy"])
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    f = F.coalesce(F.try_divide((F.col("px") - F.col("a.x")) * dx + (F.col("py") - F.col("a.y")) * dy, F.col("size") * F.col("size")), F.lit(0.0))
    near = near.withColumn("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))).withColumn("x", F.col("a.x") + F.col("f") * dx).withColumn("y", F.col("a.y") + F.col("f") * dy)
    near = near.withColumn("d", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).where(F.col("d") <= reach)
    t = F.coalesce(F.try_divide(F.col("run") + F.col("f") * F.col("size"), F.col("total")), F.lit(0.0))
    best = near.groupBy("pid", "edge").agg(F.min(F.struct("d", "nth", t.alias("t"), "x", "y")).alias("b"))
    return best.select("pid", "edge", "b.d", "b.t", "b.x", "b.y")


def nearest_edge(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """Points (pid, x, y) with edge, snap_m and t of the nearest edge (edge, line) within `reach`; a tie takes the smallest edge."""
    best = near_edges(points, edges, reach).groupBy("pid").agg(F.min(F.struct(F.round("d", 6).alias("d"), "edge", F.struct("t", "x", "y").alias("at"))).alias("b"))
    return points.join(best, "pid").select(points["*"], F.col("b.edge").alias("edge"), F.col("b.d").alias("snap_m"), F.col("b.at.t").alias("t"), F.col("b.at.x").alias("on_x"), F.col("b.at.y").alias("on_y"))


def nearest_point(points: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """Points (pid, x, y) with the nearest of `others` (ord, ox, oy) within `reach`, as o_ord, ox, oy, o_m; ties by ord."""
    c = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    dealt = others.withColumns({"cx": F.floor(F.col("ox") / reach), "cy": F.floor(F.col("oy") / reach)}).withColumn("i", c).withColumn("j", c)
    dealt = dealt.select("ord", "ox", "oy", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    near = points.select("pid", "x", "y", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy")).join(dealt, ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
    best = near.where(F.col("d") <= reach).groupBy("pid").agg(F.min(F.struct(F.round("d", 6).alias("d"), "ord", "ox", "oy")).alias("b"))
    return points.join(best, "pid").select(points["*"], F.col("b.ord").alias("o_ord"), "b.ox", "b.oy", F.col("b.d").alias("o_m"))


def snapped(barriers: DataFrame, edges: DataFrame, curb_points: DataFrame, max_m: float = SNAP_M, curb_m: float = CURB_M) -> DataFrame:
    """Barriers (pid, type, x, y) with target, edge, snap_m, on_x and on_y.

    Kerbs go to the nearest curb point (ord, kind crossing or node, ox, oy) within `curb_m`, and to the edge nearest to
    that point within `curb_m` (null if none); kerbs without a point, and other types, to the nearest edge within
    `max_m`. Without a target: nulls. `curb_points` hold the network's nodes and the mapped crossings."""
    kerb = F.col("type").isin("curb_ramp", "raised_curb")
    at_point = nearest_point(barriers.where(kerb).select("pid", "x", "y"), curb_points, curb_m).join(curb_points.select(F.col("ord").alias("o_ord"), F.col("kind").alias("target")), "o_ord")
    at_point = at_point.select("pid", "target", F.col("o_m").alias("snap_m"), F.col("ox").alias("on_x"), F.col("oy").alias("on_y"))
    then = nearest_edge(at_point.select("pid", F.col("on_x").alias("x"), F.col("on_y").alias("y")), edges, curb_m).select("pid", "edge")
    first = at_point.join(then, "pid", "left")
    rest = barriers.select("pid", "x", "y").join(at_point.select("pid"), "pid", "left_anti")
    direct = nearest_edge(rest, edges, max_m).select("pid", F.lit("edge").alias("target"), "snap_m", "on_x", "on_y", "edge")
    return barriers.join(first.unionByName(direct), "pid", "left")


def on_edges(detected: DataFrame, edges: DataFrame, kerbs: DataFrame) -> DataFrame:
    """All barriers of the routing graph (ord, id, type, conf, source, t, edge): detected ones, by id, then steps, then mapped kerbs.

    detected: id, type, conf, edge, t; edges: edge, steps, line; kerbs: osm_id, kerb, x, y."""
    own = detected.select(F.lit(0).alias("_g"), F.lit(0).cast("long").alias("_k"), "id", "type", "conf", F.lit("detected").alias("source"), "t", "edge").join(edges.select("edge"), "edge", "left_semi")
    steps = edges.where("steps").select(F.lit(1).alias("_g"), F.col("edge").alias("_k"), F.concat(F.lit("osm-steps-"), F.col("edge").cast("string")).alias("id"), F.lit("stairs").alias("type"), F.lit(1.0).alias("conf"), F.lit("osm").alias("source"), F.lit(0.5).alias("t"), "edge")
    kind = F.create_map(*[F.lit(x) for kv in KERBS.items() for x in kv])
    named = kerbs.withColumn("type", F.try_element_at(kind, "kerb")).where("type IS NOT NULL").withColumn("pid", F.col("osm_id"))
    mapped = nearest_edge(named, edges, KERB_M).select(F.lit(2).alias("_g"), F.col("osm_id").alias("_k"), F.concat(F.lit("osm-kerb-"), F.col("osm_id").cast("string")).alias("id"), "type", F.lit(1.0).alias("conf"), F.lit("osm").alias("source"), "t", "edge")
    together = own.unionByName(steps.withColumn("_k", F.col("_k").cast("long"))).unionByName(mapped.withColumn("_k", F.col("_k").cast("long")))
    return numbered(together, [F.col("_g"), F.col("_k"), F.col("id")], "ord").drop("_g", "_k").withColumn("ord", F.col("ord") - 1)


def tag_shares(edges: DataFrame, tags: list[str]) -> DataFrame:
    """(tag, edge_share, length_share): how much of `edges` (length and a column per tag) bears each tag, in one pass; 0 without edges."""
    sums = [F.count("*").alias("_n"), F.sum("length").alias("_m")]
    for t in tags:
        sums += [F.count(t).alias(f"n_{t}"), F.sum(F.when(F.col(t).isNotNull(), F.col("length"))).alias(f"m_{t}")]
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 3)
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), share(f"n_{t}", "_n").alias("edge_share"), share(f"m_{t}", "_m").alias("length_share")) for t in tags])
    return edges.agg(*sums).select(F.inline(rows))
