"""A project's settings and folders, and its commands over files: what a person runs, as functions that return DataFrames or text.

    python -m wheelgraph COMMAND PROJECT.yaml [options]

Folders below the settings file: raw (map layers, image metadata), processed (frames, detections, barriers, routing graph),
reports. Commands that would have to fetch from a service read what was fetched; without it they say what is missing.
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, lines
from .operators import cluster, coverage, evaluate, imagery, journeys, pictures, roadgraph, samples, vision
from .plans.dialect import spark_text
from .sources import files, sinks
from .storage import written
from .streaming import feedback as votes

#: Types that a model may report: fixed values of the answer format.
TYPES = ["raised_curb", "curb_ramp", "stairs", "steep", "narrow", "rough_surface", "obstacle", "construction", "step", "no_sidewalk"]
CURBS = ("curb_ramp", "raised_curb")


@dataclass(frozen=True)
class Settings:
    """Checked settings; unknown keys are ignored, missing ones have defaults."""

    root: Path
    name: str
    bbox: tuple[float, float, float, float]
    profiles: list[str] = field(default_factory=lambda: ["wheelchair", "stroller", "suitcase"])
    types: list[str] = field(default_factory=lambda: list(TYPES))
    model: str | None = None
    prompt: str = "v1"
    max_images: int = 800
    max_calls: int = 4000
    max_age_years: float = 6.0
    pano_crops: int = 4
    snap_curb_m: float = 10.0
    snap_other_m: float = 12.0
    max_detour: float | None = 0.5
    languages: list[str] = field(default_factory=lambda: ["en"])
    features: list[str] = field(default_factory=lambda: ["map_routes", "feedback"])

    def path(self, *parts: str) -> str:
        return str(self.root.joinpath(*parts))


def settings(path: str) -> Settings:
    """Settings of a YAML file; what cannot be is a ValueError that names it."""
    import yaml

    with open(path, encoding="utf-8") as f:
        held = yaml.safe_load(f) or {}
    part = lambda k: held.get(k) or {}
    west, south, east, north = box = tuple(float(x) for x in part("area").get("bbox", ()) or (0, 0, 0, 0))
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError(f"area.bbox {list(box)} is not west, south, east, north")
    if unknown := sorted(set(part("detection").get("types", [])) - set(TYPES)):
        raise ValueError(f"detection.types has unknown {unknown}")
    taken = {
        "profiles": held.get("profiles"), "types": part("detection").get("types"), "model": part("model").get("name"), "prompt": part("model").get("prompt"), "max_images": part("budget").get("max_images"), "max_calls": part("budget").get("max_calls"),
        "max_age_years": part("imagery").get("max_age_years"), "pano_crops": part("imagery").get("pano_crops"), "snap_curb_m": part("geo").get("snap_curb_m"), "snap_other_m": part("geo").get("snap_other_m"), "languages": part("ui").get("languages"), "features": part("app").get("features"),
    }
    own = {k: v for k, v in taken.items() if v is not None}
    if "max_detour" in part("routing"):
        own["max_detour"] = part("routing")["max_detour"]
    for k in ("max_images", "max_calls", "pano_crops"):
        if own.get(k, 1) < 1:
            raise ValueError(f"{k} must be 1 at least")
    return Settings(Path(path).resolve().parent, str(part("area").get("name", "")), box, **own)


def metres(df: DataFrame, bbox: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """`df` with UTM metres of the zone of the area's middle."""
    middle = (bbox[0] + bbox[2]) / 2
    sql = spark_text(geo.to_utm("SELECT * FROM {own}", lon, lat, str(float(6 * ((middle + 180) // 6) - 177))))
    return df.sparkSession.sql(sql, own=df).withColumnsRenamed({"east": x, "north": y})


def metre_lines(df: DataFrame, bbox: tuple[float, float, float, float], key: str = "edge") -> DataFrame:
    """Rows (key, coords) with `line` in UTM metres."""
    spots = df.select(key, F.posexplode("coords").alias("nth", "p")).select(key, "nth", "p.lon", "p.lat")
    made = metres(spots, bbox).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "x", "y"))).alias("l"))
    return df.join(made.select(key, F.transform("l", lambda p: lines.xy(p["x"], p["y"])).alias("line")), key)


META = "id string, captured_at long, geometry struct<coordinates:array<double>>, computed_geometry struct<coordinates:array<double>>, compass_angle double, computed_compass_angle double, is_pano boolean, camera_type string, camera_parameters array<double>, width int, height int, sequence string, on_foot boolean, quality_score double"


def images(spark: SparkSession, s: Settings) -> DataFrame | None:
    """Image metadata that was fetched for this very box, None otherwise; the index keeps the box it was fetched for."""
    index = Path(s.path("raw", "images", "bbox.json"))
    if not index.exists() or tuple(json.loads(index.read_text())) != s.bbox:
        return None
    raw = spark.read.schema(META).json(s.path("raw", "images", "images"))
    at = imagery.position(F.col("geometry.coordinates"), F.col("computed_geometry.coordinates"))
    df = raw.select("id", "captured_at", at.alias("p"), F.col("geometry.coordinates")[0].alias("raw_lon"), F.col("geometry.coordinates")[1].alias("raw_lat"), F.col("compass_angle").alias("compass"), F.col("computed_compass_angle").alias("compass_corrected"),
                    F.coalesce("is_pano", F.lit(False)).alias("is_pano"), "camera_type", F.get("camera_parameters", F.lit(0)).alias("focal"), "sequence", F.coalesce("on_foot", F.lit(False)).alias("on_foot"), F.coalesce("quality_score", F.lit(0.0)).alias("quality"))
    df = df.select("*", "p.lon", "p.lat", imagery.heading(F.col("compass"), F.col("compass_corrected")).alias("heading")).drop("p")
    return imagery.numbered_images(metres(metres(df, s.bbox), s.bbox, "raw_lon", "raw_lat", "raw_x", "raw_y"))


def needed(found: DataFrame | None, what: str) -> DataFrame:
    if found is None:
        raise FileNotFoundError(f"{what} of this area have not been fetched")
    return found


def layer(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    """Elements of a fetched map layer, coords and tags."""
    return files.layers(files.elements(spark, s.path("raw", "map.json"))).where(F.col("layer") == name)


def network(spark: SparkSession, s: Settings) -> DataFrame:
    """Fetched walking edges (ord, u, v, key, length, tags as lists, coords)."""
    return spark.read.json(s.path("raw", "walk", "edges"), "ord long, u long, v long, key string, osmid array<string>, length double, highway array<string>, surface array<string>, wheelchair array<string>, name array<string>, coords array<struct<lon:double,lat:double>>")


def selected(spark: SparkSession, s: Settings, now: Column) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, the chosen images) of the selection: funnel, thinning, spreading up to max_images."""
    own = needed(images(spark, s), "images")
    roads = layer(spark, s, "major_roads").select(F.col("osm_id").alias("edge"), "coords")
    walk = network(spark, s).select(F.col("ord").alias("edge"), "coords")
    passed = imagery.funnel(own, metre_lines(walk, s.bbox), metre_lines(roads, s.bbox), s.bbox, now, s.max_age_years)
    thin = imagery.thinned(passed.where("near_network").select(own.columns))
    chosen = imagery.spread(thin, s.max_images)
    counts = imagery.funnel_counts(passed).crossJoin(thin.agg(F.count("*").alias("thinned"))).crossJoin(chosen.agg(F.count("*").alias("selected")))  # one row each
    return counts, chosen


def fetch_images(spark: SparkSession, s: Settings, now: Column) -> DataFrame:
    """Frames of the selected images, written as the manifest; counts as the result."""
    counts, chosen = selected(spark, s, now)
    made = imagery.frames(chosen, s.pano_crops).select("frame_id", F.col("id").alias("image_id"), "lon", "lat", "heading", "fov", imagery.taken(F.col("captured_at")).alias("captured_at"), "is_pano", "crop", "sequence", F.lit("images").alias("source"), F.concat(F.lit("images/"), "frame_id", F.lit(".jpg")).alias("path"))
    made.write.mode("overwrite").parquet(s.path("processed", "frames.parquet"))
    return counts


def cut_panoramas(spark: SparkSession, s: Settings, chosen: DataFrame, side: int = 768) -> DataFrame:
    """PNG views of the panoramas among `chosen` images (frame_id, crop, heading, png, fault) at processed/views, cut out of raw/images/photos,
    whose files are called by image; numbers by fault, where a null fault is a view that was made."""
    photos = Path(s.path("raw", "images", "photos"))
    if not photos.is_dir():
        raise FileNotFoundError("photos of this area have not been fetched")
    wide = written(chosen.where("is_pano").select(F.col("id").cast("string").alias("id"), "heading"), "panoramas")
    named = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(photos.absolute().as_uri()).select(named.alias("name"), "content")
    there = content.join(wide, F.col("name") == F.col("id")).select("id", "heading", "content")
    missing = wide.join(content.select("name"), F.col("name") == F.col("id"), "left_anti").select("id", "heading", F.lit(None).cast("binary").alias("content"))
    sinks.replace(spark, s.path("processed", "views"), pictures.cropped(there.unionByName(missing), s.pano_crops, side=side))
    return spark.read.parquet(s.path("processed", "views")).groupBy("fault").agg(F.count("*").alias("n"))


def osm_summary(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """The walking network and the layers in numbers: components, lengths by highway and surface, tags, kerbs and steps."""
    edges = roadgraph.physical(network(spark, s))
    ends = network(spark, s)
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first = lambda c: roadgraph.first(F.col(c))
    flat = edges.select("ord", "length", *[first(c).alias(c) for c in ("highway", "surface", "wheelchair", "name")], F.array_contains(roadgraph.values(F.col("highway")), "steps").alias("steps"))
    kerbs, steps = layer(spark, s, "kerbs"), layer(spark, s, "steps")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    ramps = F.exists(F.map_entries("tags"), lambda e: e["key"].startswith("ramp") & (e["value"] == "yes"))
    return {
        "network": flat.agg(F.count("*").alias("edges"), F.round(F.sum("length") / 1000, 2).alias("length_km"), F.count_if("steps").alias("edges_with_steps")),
        "components": coverage.top_components(nodes, ends), "highway": coverage.by_first(flat, F.col("highway")), "surface": coverage.by_first(flat, F.coalesce("surface", F.lit("untagged"))),
        "tags": roadgraph.tag_shares(flat, ["surface", "wheelchair", "name"]), "kerbs": coverage.by_first(kerbs.withColumn("ord", F.col("osm_id")), tag("kerb")),
        "steps": steps.agg(F.count("*").alias("ways"), F.count_if(tag("step_count").isNotNull()).alias("with_step_count"), F.count_if(ramps).alias("with_ramp")),
    }


def coverage_report(spark: SparkSession, s: Settings, now: Column) -> DataFrame:
    own = needed(images(spark, s), "images")
    inside = own.where(F.col("lon").between(s.bbox[0], s.bbox[2]) & F.col("lat").between(s.bbox[1], s.bbox[3]))
    return coverage.report(metre_lines(network(spark, s).select(F.col("ord").alias("edge"), "ord", "coords"), s.bbox), inside, now, s.max_age_years)


def geolocate(spark: SparkSession, s: Settings, width: int = 1600, height: int = 1200) -> DataFrame:
    """Barriers from the detections, snapped to the network and written; the stages' counts as the result."""
    frames = files.detections(spark, s.path("processed", "detections.jsonl"))
    rows = files.detection_rows(frames.where("image_usable")).where("coalesce(permanence, 'permanent') = 'permanent'")
    rows = rows.withColumnsRenamed({"confidence": "raw_confidence", "estimated_distance_m": "model_m", "estimated_height_cm": "height_cm"}).withColumns({"width": F.lit(width), "height": F.lit(height)}).drop("source")
    seen = imagery.placed(rows).withColumns({"lon": F.col("feature_lon"), "lat": F.col("feature_lat"), "id": F.xxhash64("frame_id", "feature_index")})
    found = cluster.barriers(cluster.clusters(metres(seen, s.bbox)))
    spots = metres(found.where("lon IS NOT NULL"), s.bbox).withColumn("pid", F.col("barrier_id"))
    edges = network(spark, s)
    walk = metre_lines(roadgraph.undirected(edges).select(F.col("ord").alias("edge"), "coords"), s.bbox)
    ends = metres(edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("coords")[0].alias("p")), F.struct(F.col("v").alias("node"), F.element_at("coords", -1).alias("p")))).alias("n")).select("n.node", "n.p.lon", "n.p.lat").dropDuplicates(["node"]), s.bbox)
    crossings = metres(layer(spark, s, "crossings").select(F.col("osm_id").alias("node"), F.col("coords")[0]["lon"].alias("lon"), F.col("coords")[0]["lat"].alias("lat")), s.bbox)
    curbs = crossings.select("node", F.lit("crossing").alias("kind"), "x", "y").unionByName(ends.select("node", F.lit("node").alias("kind"), "x", "y")).select(F.concat_ws("-", "kind", F.col("node").cast("string")).alias("ord"), "kind", F.col("x").alias("ox"), F.col("y").alias("oy"))
    at = roadgraph.snapped(spots.select("pid", "type", "x", "y"), walk, curbs, s.snap_other_m, s.snap_curb_m).select(F.col("pid").alias("barrier_id"), "target", F.col("edge").alias("snap_ord"), F.round("snap_m", 2).alias("snap_distance_m"))
    ways = edges.select(F.col("ord").alias("snap_ord"), F.col("u").alias("edge_u"), F.col("v").alias("edge_v"), F.col("key").alias("edge_key"))
    out = found.join(at, "barrier_id", "left").join(ways, "snap_ord", "left").drop("snap_ord").withColumn("snapped", F.col("target").isNotNull())
    out.write.mode("overwrite").parquet(s.path("processed", "barriers"))
    return cluster.geolocation_stats(frames, seen, spark.read.parquet(s.path("processed", "barriers")))


def barriers(spark: SparkSession, s: Settings) -> DataFrame:
    return spark.read.parquet(s.path("processed", "barriers"))


def graph(spark: SparkSession, s: Settings) -> DataFrame:
    """The routing graph, written as nodes, edges and barriers; its numbers as the result."""
    edges = network(spark, s).withColumn("line", F.transform("coords", lambda p: lines.xy(p["lon"], p["lat"])))
    nodes = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("coords")[0].alias("p")), F.struct(F.col("v").alias("node"), F.element_at("coords", -1).alias("p")))).alias("n")).select("n.node", "n.p.lon", "n.p.lat").dropDuplicates(["node"])
    made = roadgraph.edge_list(nodes, edges)
    flat = metre_lines(made.select("edge", "steps", "coords"), s.bbox)
    own = roadgraph.matched(barriers(spark, s).where("snapped"), made)
    spots = metres(own.where("edge IS NOT NULL").select(F.col("barrier_id").alias("id"), "type", F.col("confidence").alias("conf"), "edge", "lon", "lat"), s.bbox)
    placed = spots.join(flat.select("edge", "line"), "edge").select("id", "type", "conf", "edge", F.round(lines.project(F.col("line"), F.col("x"), F.col("y"))["t"], 4).alias("t"))
    kerbs = metres(layer(spark, s, "kerbs").select("osm_id", F.try_element_at("tags", F.lit("kerb")).alias("kerb"), F.col("coords")[0]["lon"].alias("lon"), F.col("coords")[0]["lat"].alias("lat")), s.bbox)
    bars = roadgraph.on_edges(placed, flat, kerbs.select("osm_id", "kerb", "x", "y"))
    middle = made.select("edge", F.transform("coords", lambda p: lines.xy(p["lon"], p["lat"])).alias("l"))
    bars = bars.join(middle, "edge").withColumn("at", lines.at(F.col("l"), F.col("t"))).select("ord", "id", "type", "conf", "source", F.round("at.x", 6).alias("lon"), F.round("at.y", 6).alias("lat"), "t", "edge")
    sinks.routing_graph(nodes, made, bars, s.path("processed", "graph"))
    missed = own.agg(F.count_if(F.col("edge").isNull()).alias("unmatched"))
    return roadgraph.graph_stats(nodes, made, bars).crossJoin(missed)  # one row each


def routed(spark: SparkSession, s: Settings, requests: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Answers to requests (request, from_lon, from_lat, to_lon, to_lat, profile) on the written graph, without rejected barriers."""
    read = lambda n, schema: spark.read.schema(schema).json(s.path("processed", "graph", n))
    edges = read("edges", "edge long, u long, v long, len double, surface array<string>, wheelchair_no boolean, coords array<struct<lon:double,lat:double>>")
    bars = read("barriers", "ord long, id string, type string, conf double, source string, lon double, lat double, t double, edge long")
    if rejected is not None:
        bars = bars.join(rejected.select(F.col("barrier_id").alias("id")), "id", "left_anti")
    own = requests.withColumn("rejected", F.array().cast("array<string>"))
    return journeys.journeys(own, read("nodes", "node long, lon double, lat double"), edges, bars, files.profiles(spark, s.path("profiles.yaml"), s.profiles), max_detour=s.max_detour)


def route(spark: SparkSession, s: Settings, start: str, end: str, profile: str = "wheelchair") -> dict:
    """One answer to places in text, `lat,lon`."""
    asked = spark.range(1).select(F.col("id").alias("request"), F.lit(profile).alias("profile"), journeys.parsed_place(F.lit(start)).alias("a"), journeys.parsed_place(F.lit(end)).alias("b"))
    asked = asked.select("request", F.col("a.lon").alias("from_lon"), F.col("a.lat").alias("from_lat"), F.col("b.lon").alias("to_lon"), F.col("b.lat").alias("to_lat"), "profile")
    return routed(spark, s, asked, rejected(spark, s)).first().asDict(recursive=True)


def said(spark: SparkSession, s: Settings) -> DataFrame:
    path = Path(s.path("processed", "feedback"))
    schema = "barrier_id string, verdict string, comment string, created_at timestamp, ip_hash string"
    return spark.read.schema(schema).parquet(str(path)) if path.exists() else spark.createDataFrame([], schema)


def rejected(spark: SparkSession, s: Settings) -> DataFrame:
    return votes.summary(said(spark, s)).where("status = 'rejected'")


#: What a submission is answered with, by its fault: fixed values of HTTP.
CODES = {None: 201, "id": 422, "verdict": 422, "comment": 422, "unknown": 404, "limit": 429}


def submit(spark: SparkSession, s: Settings, rows: DataFrame, salt: str) -> DataFrame:
    """Submissions (barrier_id, verdict, comment, created_at, forwarded) with `code`; good ones are stored. Clients over the hour's
    limit get 429, and all get 404 where the project has no feedback."""
    if "feedback" not in s.features:
        return rows.withColumn("code", F.lit(404))
    checked = votes.checked(rows, salt, barriers(spark, s).select("barrier_id"))
    before = said(spark, s).select("ip_hash", "created_at", F.lit(False).alias("new"))
    count = votes.recent(before.unionByName(checked.where("fault IS NULL").select("ip_hash", "created_at", F.lit(True).alias("new"))))
    over = count.where("new AND limited").select("ip_hash", "created_at").distinct().withColumn("_over", F.lit(True))
    checked = checked.join(over, ["ip_hash", "created_at"], "left").withColumn("fault", F.coalesce("fault", F.when(F.col("_over"), "limit"))).drop("_over")
    sinks.append(checked.where("fault IS NULL").select("barrier_id", "verdict", "comment", "created_at", "ip_hash"), s.path("processed", "feedback"))
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() if k for x in (k, v)]), "fault"), F.lit(CODES[None]))
    return checked.withColumn("code", code)


def listed(spark: SparkSession, s: Settings, types: str | None = None, min_conf: float = 0.0, unsnapped: bool = True, rejected_: bool = True) -> DataFrame:
    """The barriers a map shows, with what people said of them."""
    return cluster.listed(cluster.with_feedback(barriers(spark, s), votes.summary(said(spark, s))), types.split(",") if types else None, min_conf, unsnapped, rejected_)


def frame(spark: SparkSession, s: Settings, frame_id: str) -> DataFrame:
    """One frame; no rows for an unknown one."""
    return spark.read.parquet(s.path("processed", "frames.parquet")).where(F.col("frame_id") == frame_id)


def public(s: Settings) -> dict:
    """The settings that a map needs."""
    return {"area": {"name": s.name, "bbox": list(s.bbox)}, "languages": s.languages, "types": s.types, "profiles": s.profiles, "features": s.features, "routing": Path(s.path("processed", "graph")).exists(), "max_detour": s.max_detour}


def export_site(spark: SparkSession, s: Settings, out: str) -> DataFrame:
    """A read-only bundle of barriers, network, ids and settings; which photos it needs, and whether there are frames of them."""
    own = barriers(spark, s)
    if own.isEmpty():
        raise FileNotFoundError("no barriers: geolocate first")
    slim = network(spark, s).select(F.transform("coords", lambda p: F.struct(F.round(p["lon"], 6).alias("lon"), F.round(p["lat"], 6).alias("lat"))).alias("coords"))
    ids = own.select("barrier_id").orderBy("barrier_id")
    sinks.site({"barriers": own, "network": slim, "ids": ids, "config": spark.createDataFrame([(json.dumps(public(s)),)], "config string")}, out)
    return cluster.view_frames(own, spark.read.parquet(s.path("processed", "frames.parquet")))


def excerpt(spark: SparkSession, s: Settings, bbox: tuple[float, float, float, float], out: str) -> DataFrame:
    """A smaller project of one box: barriers in it, edges with any vertex in it, frames that its barriers name; their numbers."""
    west, south, east, north = bbox
    own = barriers(spark, s).where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    inside = lines.inside(F.transform("coords", lambda p: lines.xy(p["lon"], p["lat"])), west, south, east, north)
    walk = network(spark, s).where(inside)
    kept = roadgraph.largest_component(walk.select(F.explode(F.array("u", "v")).alias("node")).distinct(), walk, by="nodes")
    walk = walk.join(kept.select(F.col("node").alias("u")), "u", "left_semi").join(kept.select(F.col("node").alias("v")), "v", "left_semi")
    wanted = cluster.view_frames(own, spark.read.parquet(s.path("processed", "frames.parquet"))).where("present").select("frame_id")
    parts = {"barriers": own, "network": walk, "frames": spark.read.parquet(s.path("processed", "frames.parquet")).join(wanted, "frame_id", "left_semi")}
    sinks.site(parts, out)
    return spark.createDataFrame([(k, spark.read.json(f"{out}/{k}").count()) for k in parts], "part string, n long")


def suggested(spark: SparkSession, s: Settings, photo: str = "photos/{image}.jpg") -> DataFrame:
    """Barriers that the map lacks, with tags; written as GeoJSON, the counts of reasons as the result."""
    mapped = layer(spark, s, "kerbs").select(F.lit("kerb").alias("kind"), F.col("osm_id").alias("shape"), "coords").unionByName(layer(spark, s, "steps").select(F.lit("steps").alias("kind"), F.col("osm_id").alias("shape"), "coords"))
    own = barriers(spark, s).where("lon IS NOT NULL").select(F.col("barrier_id").alias("id"), "type", F.lit("permanent").alias("permanence"), "confidence", "n_views", "lon", "lat", "best_frame", "last_seen", "height_cm", F.lit(None).cast("string").alias("description"))
    found = evaluate.suggestions(own, mapped)
    made = evaluate.suggestion_features(found, photo)
    sinks.geojson(made, s.path("processed", "suggestions"), F.array("lon", "lat"))
    return evaluate.suggestion_counts(found)


def evaluated(spark: SparkSession, s: Settings) -> DataFrame:
    """Scores of the detections against the labelled frames."""
    held = files.detections(spark, s.path("processed", "detections.jsonl"))
    rows = files.detection_rows(held).select("frame_id", F.col("image_usable").alias("usable"), "permanence", "type", "confidence")
    said_ = held.select("frame_id", F.col("image_usable").alias("usable")).join(evaluate.predicted_types(rows), "frame_id", "left")
    return evaluate.frame_scores(files.labels(spark, s.path("labels.json")), said_, s.types)[0]


def pilot(spark: SparkSession, s: Settings, n: int = 30) -> DataFrame:
    return samples.pilot(spark.read.parquet(s.path("processed", "frames.parquet")), n)


def trial_routes(spark: SparkSession, s: Settings, n: int = 10) -> DataFrame:
    """Routes of every profile between seeded pairs of crossings, with problems in words."""
    nodes = metres(spark.read.schema("node long, lon double, lat double").json(s.path("processed", "graph", "nodes")), s.bbox)
    pairs = samples.node_pairs(nodes, n)
    at = lambda side, a: nodes.select(F.col("node").alias(side), F.col("lon").alias(f"{a}_lon"), F.col("lat").alias(f"{a}_lat"))
    asked = pairs.join(at("a", "from"), "a").join(at("b", "to"), "b").withColumn("profile", F.explode(F.array(*[F.lit(p) for p in s.profiles])))
    asked = asked.withColumn("request", F.xxhash64("pair", "profile"))
    told = routed(spark, s, asked.select("request", "from_lon", "from_lat", "to_lon", "to_lat", "profile"))
    words = lambda c: journeys.problem_text(F.col(f"{c}.problems"))
    return told.where("error IS NULL").select("profile", F.col("baseline.length_m").alias("shortest_m"), words("baseline").alias("problems"), F.col("accessible.length_m").alias("accessible_m"), words("accessible").alias("left"), "same_route", F.array_join(F.transform("warnings", lambda w: w["code"]), ", ").alias("warnings")).orderBy("profile", "shortest_m")


def checks(s: Settings) -> list[tuple[str, bool, str]]:
    """(what, whether it is there, what to do) of all that the commands read."""
    there = lambda *p: Path(s.path(*p)).exists()
    index = there("raw", "images", "bbox.json") and tuple(json.loads(Path(s.path("raw", "images", "bbox.json")).read_text())) == s.bbox
    return [
        ("map", there("raw", "map.json"), "put the map's elements into raw/map.json"), ("network", there("raw", "walk", "edges"), "put walking edges into raw/walk/edges"), ("images", bool(index), "fetch image metadata for this very box"),
        ("frames", there("processed", "frames.parquet"), "run fetch-images"), ("detections", there("processed", "detections.jsonl"), "run the model over the frames"), ("barriers", there("processed", "barriers"), "run geolocate"), ("graph", there("processed", "graph"), "run build-graph"), ("profiles", there("profiles.yaml"), "write profiles.yaml"),
    ]


def _now() -> Column:
    return F.timestamp_seconds(F.lit(int(datetime.datetime.now(datetime.UTC).timestamp())))


COMMANDS = {
    "coverage": lambda spark, s, a: coverage_report(spark, s, _now()), "fetch-images": lambda spark, s, a: fetch_images(spark, s, _now()), "cut-panoramas": lambda spark, s, a: cut_panoramas(spark, s, selected(spark, s, _now())[1]), "geolocate": lambda spark, s, a: geolocate(spark, s), "build-graph": lambda spark, s, a: graph(spark, s),
    "evaluate": lambda spark, s, a: evaluated(spark, s), "export-osm": lambda spark, s, a: suggested(spark, s), "export-site": lambda spark, s, a: export_site(spark, s, a.out), "build-demo": lambda spark, s, a: excerpt(spark, s, tuple(map(float, a.bbox.split(","))), a.out),
    "pilot": lambda spark, s, a: pilot(spark, s, a.n), "route-demo": lambda spark, s, a: trial_routes(spark, s, a.n), "barriers": lambda spark, s, a: listed(spark, s, a.types, a.min_conf), "osm-summary": lambda spark, s, a: osm_summary(spark, s),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="wheelgraph", description=__doc__.split("\n")[0])
    p.add_argument("command", choices=[*COMMANDS, "check", "route"])
    p.add_argument("project")
    p.add_argument("--out")
    p.add_argument("--bbox")
    p.add_argument("--types")
    p.add_argument("--min-conf", type=float, default=0.0)
    p.add_argument("-n", type=int, default=10)
    p.add_argument("--from", dest="start")
    p.add_argument("--to", dest="end")
    p.add_argument("--profile", default="wheelchair")
    a = p.parse_args(argv)
    s = settings(a.project)
    if a.command == "check":
        rows = checks(s)
        print("\n".join(f"{'ok  ' if ok else 'none'} {what:<11}{'' if ok else todo}" for what, ok, todo in rows))
        return int(not all(ok for _, ok, _ in rows))
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "route":
            print(json.dumps(route(spark, s, a.start or "", a.end or "", a.profile), default=str))
        else:
            made = COMMANDS[a.command](spark, s, a)
            for name, df in (made if isinstance(made, dict) else {a.command: made}).items():
                print(sinks.markdown(df, name))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    return 0
