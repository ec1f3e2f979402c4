"""Queries of the image operators. Oracles say the same in another way: other algebra, windows for groups, all pairs for cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines
from ..operators import cluster, coverage, imagery
from ..sources import adapters as own
from .dialect import duck_text, spark_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AREA = (8.5290, 52.0185, 8.5380, 52.0295)


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived relation over the tables that its text names."""
    from .dialect import TABLES

    return spark.sql(spark_text(sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def query(oracle: str):
    """Register a query with its DuckDB text."""
    def mark(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck_text(oracle)
        return f

    return mark


def lined(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.array(lines.xy(F.col("x1"), F.col("y1")), lines.xy(F.col("x2"), F.col("y2"))))


def _now() -> Column:
    return F.timestamp_seconds(F.lit(own.NOW_S))


_META = f"({own.META}) m"
#: Angles by remainder of whole parts, differences by the shorter way round.
_WRAP = "({0} - 360 * floor(({0}) / 360.0))"
_APART = "least(abs({0} - {1}) % 360, 360 - abs({0} - {1}) % 360)"
#: Chord of two unit vectors.
_CHORD = "sqrt(pow(cos(radians({1})) * cos(radians({0})) - cos(radians({3})) * cos(radians({2})), 2) + pow(cos(radians({1})) * sin(radians({0})) - cos(radians({3})) * sin(radians({2})), 2) + pow(sin(radians({1})) - sin(radians({3})), 2))"
#: Metres east and north by the semi-axes (Gauss's middle latitude), and metres of a step from a place.
_M = "(6378137.0 * 6378137.0 * 6356752.314245179 * 6356752.314245179 / pow(pow(6378137.0 * cos(radians({0})), 2) + pow(6356752.314245179 * sin(radians({0})), 2), 1.5))"
_N = "(6378137.0 * 6378137.0 / sqrt(pow(6378137.0 * cos(radians({0})), 2) + pow(6356752.314245179 * sin(radians({0})), 2)))"
#: Distance to a segment: to its line where the foot lies on it, else to the nearer end.
SEGMENT = """(CASE WHEN ({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay}) <= 0 THEN sqrt(pow({px} - {ax}, 2) + pow({py} - {ay}, 2))
  WHEN ({px} - {bx}) * ({ax} - {bx}) + ({py} - {by}) * ({ay} - {by}) <= 0 THEN sqrt(pow({px} - {bx}, 2) + pow({py} - {by}, 2))
  ELSE abs(({bx} - {ax}) * ({ay} - {py}) - ({ax} - {px}) * ({by} - {ay})) / sqrt(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2)) END)"""


@query(f"SELECT id, round({_WRAP.format('heading')}, 6) AS heading, CASE WHEN heading IS NULL THEN -1 ELSE CAST(round({_WRAP.format('heading')} / 45 - 0.000000001) AS INT) % 8 END AS sector, round({_APART.format('heading', 'quality * 36')}, 6) AS turn, strftime(make_timestamp(captured_at * 1000), '%Y-%m-%d %H:%M:%S') AS taken, round(((1720000000000 - captured_at) // 86400000) * 4 / 1461, 9) AS age FROM {_META}")
def heading_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, directions of eight, turns, UTC times and ages of images."""
    h = imagery.heading(F.lit(None), F.col("heading"))
    sector = F.when(h.isNull(), -1).otherwise(F.pmod(F.floor((h + 22.5) / 45).cast("int"), F.lit(8)))
    df = rows(spark, sf_dir, f"SELECT * FROM {_META}")
    return df.select("id", F.round(h, 6).alias("heading"), sector.alias("sector"), F.round(imagery.turn(F.col("heading"), F.col("quality") * 36), 6).alias("turn"), F.date_format(imagery.taken(F.col("captured_at")), "yyyy-MM-dd HH:mm:ss").alias("taken"), F.round(imagery.age_years(F.col("captured_at"), _now()), 9).alias("age"))


@query(f"SELECT id, round(CASE WHEN f BETWEEN 20 AND 150 THEN f ELSE 70 END, 6) AS fov, coalesce(NOT f BETWEEN 20 AND 150, true) AS defaulted FROM (SELECT id, CASE WHEN focal > 0 THEN 360 / pi() * acos(focal / sqrt(focal * focal + 0.25)) END AS f FROM {_META}) f")
def camera_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of view of focal lengths, and which had to be assumed."""
    return rows(spark, sf_dir, f"SELECT * FROM {_META}").select("id", imagery.field_of_view(F.col("focal")).alias("f")).select("id", F.round("f.fov", 6).alias("fov"), "f.defaulted")


@query(f"SELECT id, CASE WHEN id % 3 = 0 OR id % 4 = 1 THEN lon ELSE lon + 0.001 END AS lon, CASE WHEN id % 3 = 0 OR id % 4 = 1 THEN lat ELSE lat - 0.001 END AS lat, CASE WHEN id % 5 = 0 THEN heading ELSE id * 1.0 % 360 END AS heading FROM {_META}")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and headings, corrected ones first; an empty correction is none."""
    df = rows(spark, sf_dir, f"SELECT id, heading, array(lon, lat) AS raw, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 4 = 1 THEN slice(array(lon), 1, 0) ELSE array(lon + 0.001, lat - 0.001) END AS corrected, CASE WHEN id % 5 <> 0 THEN id * 1.0 END AS turned FROM {_META}")
    return df.select("id", imagery.position(F.col("raw"), F.col("corrected")).alias("p"), imagery.heading(F.col("heading"), F.col("turned")).alias("heading")).select("id", "p.lon", "p.lat", "heading")


_TANS = "(tan(radians(35)) * 0.75)"
_SIGHT = f"""SELECT *, degrees(atan2((xmin + xmax - 1000) * tan(radians(35)), 1000)) + heading AS turned, (ymax - 500) / 500.0 * {_TANS} AS slope,
  CASE WHEN model_m > 0 THEN 'model' WHEN degrees(atan2((ymax - 500) * {_TANS}, 500)) > 0.5 THEN 'box_bottom' ELSE 'fallback' END AS source FROM ({own.VIEWS}) v"""
_WAY = f"SELECT *, CASE source WHEN 'model' THEN CASE WHEN model_m < 2 THEN 2 WHEN model_m > 25 THEN 25 ELSE model_m END WHEN 'box_bottom' THEN CASE WHEN 2 / slope < 2 THEN 2 WHEN 2 / slope > 25 THEN 25 ELSE 2 / slope END ELSE 8 END AS way, CASE source WHEN 'fallback' THEN 0.7 * raw_confidence ELSE raw_confidence END AS conf FROM ({_SIGHT}) s"
PLACED = f"SELECT * EXCLUDE (lon, lat), lon + degrees(way * sin(radians(turned)) / ({_N.format('lat')} * cos(radians(lat)))) AS lon, lat + degrees(way * cos(radians(turned)) / {_M.format('lat')}) AS lat FROM ({_WAY}) w"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imagery.placed(rows(spark, sf_dir, own.VIEWS).withColumn("box_2d", F.array(*[F.col(c).cast("int") for c in ("ymin", "xmin", "ymax", "xmax")])))


@query(f"SELECT id, source, round({_WRAP.format('turned')}, 6) AS bearing, round(way, 3) AS distance_m, round(conf, 6) AS confidence, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({PLACED}) p")
def place_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every reported feature is, and how its distance was found."""
    return views(spark, sf_dir).select("id", "source", F.round("bearing", 6).alias("bearing"), F.round("distance_m", 3).alias("distance_m"), F.round("confidence", 6).alias("confidence"), F.round("feature_lon", 7).alias("lon"), F.round("feature_lat", 7).alias("lat"))


_AHEAD = f"""SELECT m.id, m.lon, m.lat, coalesce(b.lon, m.lon) AS lon1, coalesce(b.lat, m.lat) AS lat1, coalesce(a.lon, m.lon) AS lon2, coalesce(a.lat, m.lat) AS lat2 FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY captured_at, ord) AS k FROM {_META}) m
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY captured_at, ord) AS k FROM {_META}) b ON b.sequence IS NOT DISTINCT FROM m.sequence AND b.k = m.k - 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY captured_at, ord) AS k FROM {_META}) a ON a.sequence IS NOT DISTINCT FROM m.sequence AND a.k = m.k + 1"""
_STEP = f"SELECT *, {_M.format('(lat1 + lat2) / 2')} * radians(lat2 - lat1) * cos(radians(lon2 - lon1) / 2) AS north, {_N.format('(lat1 + lat2) / 2')} * radians(lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) AS east FROM ({_AHEAD}) h"
_TRAVEL = f"SELECT id, lon1, lat1, lon2, lat2, sqrt(north * north + east * east) AS way, CASE WHEN lon1 <> lon2 OR lat1 <> lat2 THEN degrees(atan2(east, north)) - (lon2 - lon1) / 2 * sin(radians((lat1 + lat2) / 2)) END AS travel FROM ({_STEP}) t"


@query(f"SELECT id, round(way, 2) AS travelled_m, round({_WRAP.format('travel')}, 3) AS bearing FROM ({_TRAVEL}) w")
def travel_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way and direction between the neighbours of each image in its sequence."""
    return imagery.travelled(rows(spark, sf_dir, f"SELECT * FROM {_META}")).select("id", F.round("travel_m", 2).alias("travelled_m"), F.round("travel", 3).alias("bearing"))


@query(f"SELECT count(*) AS panoramas, median(d) AS median_diff, round(count_if(d <= 30) / count(*), 6) AS share_30, round(count_if(d >= 150) / count(*), 6) AS share_150 FROM (SELECT round({_APART.format('w.travel', 'm.heading')}, 2) AS d FROM ({_TRAVEL}) w JOIN {_META} ON m.id = w.id WHERE m.is_pano) d WHERE d IS NOT NULL")
def sequence_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far panoramas look away from the way of their sequence."""
    seen = imagery.travelled(rows(spark, sf_dir, f"SELECT * FROM {_META}"))
    # whole hundredths, as both sides add up many parts
    return imagery.turn_stats(seen.withColumns({"travel": F.round(F.round(imagery.turn(F.col("travel"), F.col("heading")), 2), 2), "heading": F.when(F.col("heading").isNotNull(), F.lit(0.0))}))


_ROAD = f"SELECT m.id, min(least({SEGMENT.format(px='m.x', py='m.y', ax='r.x1', ay='r.y1', bx='r.x2', by='r.y2')}, {SEGMENT.format(px='m.raw_x', py='m.raw_y', ax='r.x1', ay='r.y1', bx='r.x2', by='r.y2')})) AS road FROM {_META} CROSS JOIN ({own.ROADS}) r GROUP BY m.id"
_WALK = f"SELECT DISTINCT m.id FROM {_META} JOIN ({own.EDGES}) e ON {SEGMENT.format(px='m.x', py='m.y', ax='e.x1', ay='e.y1', bx='e.x2', by='e.y2')} <= 15"
_FRESH = f"m.lon >= {AREA[0]} AND m.lon <= {AREA[2]} AND m.lat >= {AREA[1]} AND m.lat <= {AREA[3]}", "m.camera_type IS DISTINCT FROM 'fisheye'", "(m.is_pano OR m.heading IS NOT NULL)", "(1720000000000 - m.captured_at) // 86400000 <= 2191"
_BAD = f"SELECT m.sequence FROM {_META} JOIN ({_ROAD}) r ON r.id = m.id WHERE {' AND '.join(_FRESH)} AND m.sequence IS NOT NULL GROUP BY m.sequence HAVING 2 * count_if(r.road <= 15) >= count(*)"
_LATE = ["sqrt(pow(m.x - m.raw_x, 2) + pow(m.y - m.raw_y, 2)) <= 15", f"r.road > 15 AND (m.sequence IS NULL OR m.sequence NOT IN ({_BAD}))", f"(NOT m.is_pano OR coalesce({_APART.format('t.travel', 'coalesce(m.heading, 0)')} <= 45, false))", "w.id IS NOT NULL"]
_ALL = [*_FRESH, *_LATE]


def _passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imagery.funnel(rows(spark, sf_dir, f"SELECT * FROM {_META}"), lined(rows(spark, sf_dir, own.EDGES)), lined(rows(spark, sf_dir, own.ROADS)), AREA, _now())


@query("SELECT count(*) AS metadata, " + ", ".join(f"count_if({' AND '.join(_ALL[: i + 1])}) AS {n}" for i, n in enumerate(imagery.STEPS)) + f" FROM {_META} JOIN ({_ROAD}) r ON r.id = m.id JOIN ({_TRAVEL}) t ON t.id = m.id LEFT JOIN ({_WALK}) w ON w.id = m.id")
def image_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images pass each step of the selection, by distances to roads and to the walking network."""
    return imagery.funnel_counts(_passed(spark, sf_dir))


@query(f"SELECT sequence, round(count_if(road <= 15) / count(*), 6) AS share FROM {_META} JOIN ({_ROAD}) r ON r.id = m.id WHERE sequence IS NOT NULL GROUP BY sequence HAVING 2 * count_if(road <= 15) >= count(*)")
def major_road_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that mostly follow a major road."""
    images = rows(spark, sf_dir, f"SELECT * FROM {_META}")
    both = images.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), "x", "y"), F.struct(F.lit(1).alias("k"), F.col("raw_x").alias("x"), F.col("raw_y").alias("y")))).alias("p"))
    near = imagery.distances(both.select(F.struct("id", "p.k").alias("pid"), "p.x", "p.y"), lined(rows(spark, sf_dir, own.ROADS)), imagery.ROAD_M).groupBy("pid.id").agg(F.min("d").alias("road_m"))
    return imagery.road_sequences(images.join(near, "id", "left")).select("sequence", F.round("share", 6).alias("share"))


_VIEW = f"CASE WHEN is_pano THEN 'pano' WHEN heading IS NULL THEN 'none' ELSE CAST(CAST(floor((heading + 22.5) / 45) AS INT) % 8 AS VARCHAR) END"
_KEY = f"floor(x / 8), floor(y / 8), {_VIEW}"
_THIN = f"SELECT * EXCLUDE (nth, ord), first_ord AS ord FROM (SELECT *, min(ord) OVER (PARTITION BY {_KEY}) AS first_ord, row_number() OVER (PARTITION BY {_KEY} ORDER BY captured_at DESC, on_foot DESC, quality DESC, ord) AS nth FROM {_META}) t WHERE nth = 1"


@query(f"SELECT id, ord AS first_ord FROM ({_THIN}) t")
def thin_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best image of each small cell and direction."""
    return imagery.thinned(rows(spark, sf_dir, f"SELECT * FROM {_META}")).select("id", F.col("ord").alias("first_ord"))


_DEEP = f"SELECT *, row_number() OVER b AS depth, first_value(captured_at) OVER b AS h1, first_value(on_foot) OVER b AS h2, first_value(quality) OVER b AS h3, min(ord) OVER (PARTITION BY floor(x / 25), floor(y / 25)) AS seen FROM ({_THIN}) t WINDOW b AS (PARTITION BY floor(x / 25), floor(y / 25) ORDER BY captured_at DESC, on_foot DESC, quality DESC, ord)"


@query(f"SELECT id, row_number() OVER (ORDER BY depth, h1 DESC, h2 DESC, h3 DESC, seen) AS pos FROM ({_DEEP}) d QUALIFY pos <= 300")
def spread_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 images spread over the area, the best of each block first."""
    return imagery.spread(imagery.thinned(rows(spark, sf_dir, f"SELECT * FROM {_META}")), 300).select("id", "pos")


@query("SELECT user_id AS id, event_type, first_id AS position FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM {events}) e WHERE nth = 1")
def latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an id: the last that arrived, at the place of the first."""
    return imagery.latest(rows(spark, sf_dir, "SELECT user_id AS id, event_type, event_id FROM {events}"), "id", "event_id").select("id", "event_type", F.col("first_seen").alias("position"))


@query(f"SELECT id, CAST(id AS VARCHAR) || CASE WHEN is_pano THEN '_' || c.name ELSE '' END AS frame_id, CASE WHEN is_pano THEN c.name END AS crop, round((coalesce(heading, 0) + CASE WHEN is_pano THEN c.turn ELSE 0 END) % 360, 6) AS heading, round(CASE WHEN is_pano THEN 90 WHEN focal > 0 AND degrees(2 * atan2(0.5, focal)) BETWEEN 20 AND 150 THEN degrees(2 * atan2(0.5, focal)) ELSE 70 END, 6) AS fov FROM {_META} JOIN (VALUES ('forward', 0), ('right', 90), ('back', 180), ('left', 270)) AS c(name, turn) ON is_pano OR c.turn = 0")
def pano_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of all images: four crops of a panorama, else the image."""
    meta = rows(spark, sf_dir, f"SELECT id, heading AS compass, CAST(NULL AS DOUBLE) AS compass_corrected, is_pano, focal FROM {_META}")
    return imagery.frames(meta).select("id", "frame_id", "crop", F.round("heading", 6).alias("heading"), F.round("fov", 6).alias("fov"))


@query("SELECT l_orderkey AS id, l_linenumber AS nth, (l_suppkey % 500) * 1.6 AS x0, (l_partkey % 400) * 1.2 AS y0, (l_suppkey % 500 + 300) * 1.6 AS x1, (l_partkey % 400 + 500) * 1.2 AS y1 FROM {lineitem}")
def box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in thousandths as pixels."""
    df = rows(spark, sf_dir, "SELECT l_orderkey AS id, l_linenumber AS nth, array(l_partkey % 400, l_suppkey % 500, l_partkey % 400 + 500, l_suppkey % 500 + 300) AS box FROM {lineitem}")
    return df.select("id", "nth", imagery.box_pixels(F.col("box"), F.lit(1600), F.lit(1200)).alias("p")).select("id", "nth", *[F.round(f"p.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_BOX = (8.5, 52.0, 8.523, 52.017)


@query("SELECT round(8.5 + i * 0.005, 6) AS west, round(52.0 + j * 0.005, 6) AS south, round(CASE WHEN i = 4 THEN 8.523 ELSE 8.505 + i * 0.005 END, 6) AS east, round(CASE WHEN j = 3 THEN 52.017 ELSE 52.005 + j * 0.005 END, 6) AS north FROM generate_series(0, 4) AS a(i), generate_series(0, 3) AS b(j)")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search tiles of a box."""
    return imagery.tiles(spark, _BOX).select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


_FULL = 12
_LEVEL = "SELECT t.*, (SELECT count(*) FROM p WHERE p.lon BETWEEN t.west AND t.east AND p.lat BETWEEN t.south AND t.north) AS n"


@query(f"""WITH RECURSIVE p AS (SELECT lon, lat FROM {_META}), r AS (
  SELECT * FROM (VALUES (8.5285, 52.018, 8.5335, 52.023), (8.5335, 52.018, 8.5385, 52.023), (8.5285, 52.023, 8.5335, 52.028), (8.5335, 52.023, 8.5385, 52.028), (8.5285, 52.028, 8.5335, 52.03), (8.5335, 52.028, 8.5385, 52.03)) AS t(west, south, east, north)
  UNION ALL SELECT q.* FROM (SELECT r.*, (SELECT count(*) FROM p WHERE p.lon BETWEEN r.west AND r.east AND p.lat BETWEEN r.south AND r.north) AS n FROM r) t,
    LATERAL (VALUES (t.west, t.south, (t.west + t.east) / 2, (t.south + t.north) / 2), ((t.west + t.east) / 2, t.south, t.east, (t.south + t.north) / 2), (t.west, (t.south + t.north) / 2, (t.west + t.east) / 2, t.north), ((t.west + t.east) / 2, (t.south + t.north) / 2, t.east, t.north)) AS q(west, south, east, north)
    WHERE t.n >= {_FULL} AND t.east - t.west > 0.0003)
SELECT round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north, n FROM (SELECT r.*, (SELECT count(*) FROM p WHERE p.lon BETWEEN r.west AND r.east AND p.lat BETWEEN r.south AND r.north) AS n FROM r) t WHERE n < {_FULL} OR east - west <= 0.0003""")
def full_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that a search ends in, after full ones gave way to quarters, with their images."""
    first = spark.createDataFrame([(8.5285, 52.018, 8.5335, 52.023), (8.5335, 52.018, 8.5385, 52.023), (8.5285, 52.023, 8.5335, 52.028), (8.5335, 52.023, 8.5385, 52.028), (8.5285, 52.028, 8.5335, 52.03), (8.5335, 52.028, 8.5385, 52.03)], "west double, south double, east double, north double")
    found = imagery.refined(first, rows(spark, sf_dir, f"SELECT lon, lat FROM {_META}"), _FULL)
    return found.select(*[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")], "n")


_SAMPLE = f"SELECT edge, k AS nth, x1 + (x2 - x1) * (2 * k + 1) / 16 AS x, y1 + (y2 - y1) * (2 * k + 1) / 16 AS y FROM ({own.EDGES}) e, generate_series(0, 7) AS s(k)"
_SHOWN = "SELECT round(sum(CASE WHEN EXISTS (SELECT 1 FROM {m} WHERE {where} pow(m.x - s.x, 2) + pow(m.y - s.y, 2) <= 225) THEN 5 ELSE 0 END) / (5.0 * count(*)), 3) FROM ({s}) s"


@query(f"SELECT edge, nth, round(x, 6) AS x, round(y, 6) AS y, 5.0 AS weight FROM ({_SAMPLE}) s")
def edge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample points of the network, every five metres."""
    return coverage.samples(lined(rows(spark, sf_dir, own.EDGES))).select("edge", "nth", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("weight", 6).alias("weight"))


@query(f"""SELECT count(*) AS images, count_if(is_pano) AS panoramas, count_if(on_foot) AS on_foot, count_if((1720000000000 - captured_at) // 86400000 <= 2191) AS fresh, count_if((1720000000000 - captured_at) // 86400000 <= 1095) AS images_3y,
  (SELECT string_agg(yr || ':' || n, ',' ORDER BY yr) FROM (SELECT year(make_timestamp(captured_at * 1000)) AS yr, count(*) AS n FROM {_META} GROUP BY yr) g) AS by_year, (SELECT count(*) FROM ({own.EDGES}) e) AS edges, (SELECT round(sum(length) / 1000, 1) FROM ({own.EDGES}) e) AS network_km,
  ({_SHOWN.format(m=_META, where='', s=_SAMPLE)}) AS covered, ({_SHOWN.format(m=_META, where='(1720000000000 - m.captured_at) // 86400000 <= 2191 AND', s=_SAMPLE)}) AS covered_fresh FROM {_META}""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by age and year, and the share of the network's length that they show."""
    both = lined(rows(spark, sf_dir, own.EDGES)).withColumn("ord", F.col("edge"))
    back = both.withColumns({"line": F.reverse("line"), "ord": F.col("ord") + 10_000_000})  # every street is listed both ways
    found = coverage.report(both.unionByName(back), rows(spark, sf_dir, f"SELECT * FROM {_META}"), _now())
    return found.withColumn("by_year", F.array_join(F.transform("by_year", lambda y: F.concat_ws(":", y["year"].cast("string"), y["n"].cast("string"))), ","))


@query(f"SELECT DISTINCT edge FROM ({_SAMPLE}) s WHERE EXISTS (SELECT 1 FROM {_META} WHERE pow(m.x - s.x, 2) + pow(m.y - s.y, 2) <= 225)")
def covered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which an image shows some part."""
    spots = coverage.samples(lined(rows(spark, sf_dir, own.EDGES)))
    return coverage.seen(spots, rows(spark, sf_dir, f"SELECT x, y FROM {_META}")).select("edge").distinct()


@query("SELECT o_orderkey % 1000 AS id, min(o_orderkey) AS ord, count(*) AS n FROM {orders} WHERE o_orderkey % 1000 IN (SELECT p_partkey FROM {part}) GROUP BY o_orderkey % 1000")
def chosen_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen ids with what is known of them, in the order of choice."""
    ids = rows(spark, sf_dir, "SELECT o_orderkey % 1000 AS id, o_orderkey AS ord FROM {orders}")
    met = imagery.chosen(ids, rows(spark, sf_dir, "SELECT p_partkey AS id FROM {part}"))
    return met.groupBy("id").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))


# barriers from views

_KEPT = f"SELECT *, round((lon - {own.LON}) / {own.EAST!r}, 6) AS fx, round((lat - {own.LAT}) / {own.NORTH!r}, 6) AS fy FROM ({PLACED}) q WHERE usable AND (permanence IS NULL OR permanence = 'permanent')"
_CLUSTERED = f"""WITH RECURSIVE d AS MATERIALIZED ({_KEPT}),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.type = b.type AND a.fx BETWEEN b.fx - 7 AND b.fx + 7 AND a.fy BETWEEN b.fy - 7 AND b.fy + 7 WHERE 2 * 6371008.8 * asin({_CHORD.format('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 2) <= 6),
r(id, reach) AS (SELECT id, id FROM d UNION SELECT r.id, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT d.*, k.cluster FROM d JOIN (SELECT id, min(reach) AS cluster FROM r GROUP BY id) k ON k.id = d.id)"""
_ROLLED = f"""{_CLUSTERED}, f AS (SELECT cluster, frame_id, max(conf) AS top FROM c GROUP BY cluster, frame_id), g AS (SELECT cluster, 1 - exp(sum(ln(1 - top))) AS p FROM f GROUP BY cluster),
b AS (SELECT cluster, any_value(type) AS type, sum(conf * lon) / sum(conf) AS lon, sum(conf * lat) / sum(conf) AS lat, count(*) AS n_detections, count(DISTINCT image_id) AS n_views, median(height_cm) AS height, max(captured_at) AS last_seen,
  string_agg(DISTINCT frame_id, ',' ORDER BY frame_id) AS frame_ids, string_agg(frame_id || '#' || feature_index, '|' ORDER BY frame_id || '#' || feature_index) AS members, string_agg(DISTINCT image_id, ',' ORDER BY image_id) AS image_ids,
  string_agg(frame_id, ',' ORDER BY raw_confidence DESC, id) AS views FROM c GROUP BY cluster),
h AS (SELECT cluster, string_agg(source || ':' || n, ',' ORDER BY source) AS distance_sources FROM (SELECT cluster, source, count(*) AS n FROM c GROUP BY cluster, source) s GROUP BY cluster),
k AS (SELECT type || '-' || left(sha1(type || '|' || members), 10) AS barrier_id, type, round(CASE WHEN p > 0.97 THEN 0.97 ELSE p END, 3) AS confidence, round(lon, 6) AS lon, round(lat, 6) AS lat, n_detections, n_views, split_part(views, ',', 1) AS best_frame, round(CAST(height AS DOUBLE), 2) AS height_cm, last_seen,
  frame_ids, image_ids, distance_sources, views FROM b JOIN g USING (cluster) JOIN h USING (cluster) WHERE n_detections > 1 OR p >= 0.5)"""


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views(spark, sf_dir).where("usable AND coalesce(permanence, 'permanent') = 'permanent'")
    seen = seen.withColumns({"lon": F.col("feature_lon"), "lat": F.col("feature_lat")}).withColumns({"x": F.round((F.col("lon") - own.LON) / own.EAST, 6), "y": F.round((F.col("lat") - own.LAT) / own.NORTH, 6)})
    return cluster.barriers(cluster.clusters(seen))


@query(f"{_ROLLED} SELECT * FROM k")
def barrier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features placed from views, clustered and rolled up to barriers."""
    sources = F.array_join(F.transform(F.array_sort(F.map_entries("distance_sources")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return rolled(spark, sf_dir).withColumns({"image_ids": F.array_join("image_ids", ","), "distance_sources": sources, "views": F.array_join(F.transform("views", lambda v: v["frame_id"]), ",")})


_SNAPPED = "ascii(right(barrier_id, 1)) % 3 <> 0"


@query(f"""{_ROLLED}, s AS (SELECT *, {_SNAPPED} AS snapped FROM k), t AS (SELECT type, count(*) AS n, count_if(NOT snapped) AS u FROM s GROUP BY type)
SELECT (SELECT count(*) FROM ({own.VIEWS}) v) AS frames, (SELECT count_if(usable) FROM ({own.VIEWS}) v) AS usable_frames, (SELECT count(*) FROM d) AS detections_placed, (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM d GROUP BY source) q) AS distance_sources,
  count(*) AS clusters_kept, count_if(snapped) AS snapped, count_if(NOT snapped) AS unsnapped, count_if(n_views >= 2) AS multi_view, (SELECT string_agg(type || ':' || n || ':' || u, ',' ORDER BY n DESC, type) FROM t) AS by_type,
  (SELECT count(*) FROM d) - sum(n_detections) AS dropped_single_low_conf, round(count_if(NOT snapped) / count(*), 3) AS unsnapped_share FROM s""")
def detection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all detections."""
    frames = rows(spark, sf_dir, own.VIEWS).withColumnRenamed("usable", "image_usable")
    placed = views(spark, sf_dir).where("usable AND coalesce(permanence, 'permanent') = 'permanent'")
    found = rolled(spark, sf_dir).withColumn("snapped", F.expr(_SNAPPED))
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")
    return cluster.geolocation_stats(frames, placed, found).withColumns({"by_type": text("by_type", "type", "total", "unsnapped"), "distance_sources": text("distance_sources", "source", "n")})


_SAID = f"SELECT barrier_id, count_if(verdict = 'confirm') AS yes, count_if(verdict = 'reject') AS no FROM (SELECT k.barrier_id, f.verdict FROM k JOIN ({own.FEEDBACK}) f ON 'b' || CAST(ascii(right(k.barrier_id, 1)) % 50 AS VARCHAR) = f.barrier_id AND f.id % 7 = ascii(right(k.barrier_id, 2)) % 7) j GROUP BY barrier_id"


@query(f"""{_ROLLED}, z AS ({_SAID}) SELECT k.barrier_id, type, confidence, CASE WHEN no > yes THEN 'rejected' WHEN yes > no THEN 'confirmed' WHEN yes IS NOT NULL THEN 'disputed' END AS status FROM k LEFT JOIN z ON z.barrier_id = k.barrier_id
  WHERE type IN ('stairs', 'raised_curb', 'narrow') AND confidence >= 0.6 AND {_SNAPPED.replace('barrier_id', 'k.barrier_id')} AND (no IS NULL OR no <= yes)""")
def barrier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barriers with what people said of them, as a map lists them."""
    from ..streaming import feedback

    found = rolled(spark, sf_dir).withColumn("snapped", F.expr(_SNAPPED))
    said = rows(spark, sf_dir, own.FEEDBACK).withColumnRenamed("barrier_id", "asked")
    asked = found.select("barrier_id", F.concat(F.lit("b"), (F.ascii(F.right("barrier_id", F.lit(1))) % 50).cast("string")).alias("asked"), (F.ascii(F.right("barrier_id", F.lit(2))) % 7).alias("k"))
    own_ = asked.join(said, "asked").where(F.col("id") % 7 == F.col("k")).select("barrier_id", "verdict")
    marked = cluster.with_feedback(found, feedback.summary(own_))
    return cluster.listed(marked, ["stairs", "raised_curb", "narrow"], 0.6, unsnapped=False, rejected=False).select("barrier_id", "type", "confidence", F.col("feedback.status").alias("status"))


@query(f"{_ROLLED}, w AS (SELECT DISTINCT unnest(string_split(views, ',')) AS frame_id FROM k) SELECT frame_id, frame_id IN (SELECT frame_id FROM ({own.VIEWS}) v WHERE feature_index = 0 AND id % 9 <> 0) AS present FROM w")
def exported_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos that an export needs, and which are missing."""
    return cluster.view_frames(rolled(spark, sf_dir), rows(spark, sf_dir, f"SELECT frame_id FROM ({own.VIEWS}) v WHERE feature_index = 0 AND id % 9 <> 0"))
