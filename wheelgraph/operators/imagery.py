"""Street images: where and how they look, which of them to use, their frames, and what a box in a frame shows.

An image has id, ord (its place in the input, which breaks ties), captured_at, raw and corrected (arrays of lon, lat),
compass and compass_corrected, is_pano, camera_type, focal, sequence, on_foot and quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import written
from .ordered import numbered
from .roadgraph import near_edges

DAY_S, YEAR_DAYS = 86_400, 365.25
FRESH_YEARS, SHIFT_M, ROAD_M, NETWORK_M, TURN_DEG = 6.0, 15.0, 15.0, 15.0, 45.0
THIN_M, BLOCK_M = 8.0, 25.0
PANO_FOV, DEFAULT_FOV = 90.0, 70.0
#: Names of the four crops, a fixed value of frame ids; other numbers of crops are named by their angle.
FOUR = ["forward", "right", "back", "left"]
TILE_DEG, LEAST_TILE_DEG, FULL_TILE = 0.005, 0.0003, 2000


def position(raw: Column, corrected: Column) -> Column:
    """struct<lon, lat>: the corrected place if there is one, else the raw one."""
    use = F.when(F.size(corrected) > 0, corrected).otherwise(raw)
    return F.struct(F.get(use, F.lit(0)).alias("lon"), F.get(use, F.lit(1)).alias("lat"))


def heading(compass: Column, corrected: Column) -> Column:
    """Degrees from 0 below 360, of the corrected angle if there is one; null without any."""
    return F.pmod(F.coalesce(corrected, compass).cast("double"), F.lit(360.0))


def age_years(captured_ms: Column, now: Column) -> Column:
    """Whole days up to `now` (a timestamp), in years."""
    return F.floor((F.unix_micros(now) / 1e6 - captured_ms / 1e3) / DAY_S) / YEAR_DAYS


def taken(captured_ms: Column) -> Column:
    return F.timestamp_millis(captured_ms.cast("long"))


def field_of_view(focal: Column) -> Column:
    """struct<fov, defaulted> of a focal length in image widths."""
    fov = F.when(focal > 0, F.degrees(2 * F.atan(F.try_divide(F.lit(0.5), focal))))
    good = F.coalesce(fov.between(20, 150), F.lit(False))
    return F.struct(F.when(good, fov).otherwise(DEFAULT_FOV).alias("fov"), (~good).alias("defaulted"))


def crops(n: int) -> list[tuple[str, float]]:
    """(name, degrees to the right of the heading) of `n` crops of a panorama."""
    return [(FOUR[i] if n == 4 else f"yaw{i * 360 // n:03d}", i * 360.0 / n) for i in range(n)]


def frames(images: DataFrame, n: int = 4) -> DataFrame:
    """One row per frame: an image, or `n` crops of a panorama. Adds frame_id, crop, heading and fov; no heading counts as 0."""
    angle = F.coalesce(heading(F.col("compass"), F.col("compass_corrected")), F.lit(0.0))
    each = [F.struct(F.concat_ws("_", F.col("id").cast("string"), F.lit(name)).alias("frame_id"), F.lit(name).alias("crop"), F.pmod(angle + off, F.lit(360.0)).alias("heading"), F.lit(PANO_FOV).alias("fov")) for name, off in crops(n)]
    one = F.struct(F.col("id").cast("string").alias("frame_id"), F.lit(None).cast("string").alias("crop"), angle.alias("heading"), field_of_view(F.col("focal"))["fov"].alias("fov"))
    made = images.withColumn("_f", F.explode(F.when(F.coalesce("is_pano", F.lit(False)), F.array(*each)).otherwise(F.array(one))))
    return made.select(*[c for c in images.columns if c not in ("frame_id", "crop", "heading", "fov")], "_f.*")


def placed(views: DataFrame) -> DataFrame:
    """Where reported features are. views: lon, lat, heading and fov of the frame, width and height of its image, box_2d
    (ymin, xmin, ymax, xmax in thousandths), model_m (the distance that the model gave), raw_confidence.

    Adds bearing, distance_m, source (model, box_bottom or fallback), confidence (raw, or 0.7 of it for a fallback), and
    feature_lon and feature_lat."""
    side = lambda i: F.get("box_2d", F.lit(i)).cast("double")
    half = F.tan(F.radians(F.col("fov")) / 2)
    off = F.degrees(F.atan(((side(1) + side(3)) / 2000 - 0.5) * 2 * half))
    upright = half * F.col("height") / F.col("width")
    below = F.degrees(F.atan((side(2) / 1000 - 0.5) * 2 * upright))
    bottom = F.when(below > 0.5, 2.0 / F.tan(F.radians(below)))
    told = F.when((F.col("model_m") > 0) & ~F.isnan("model_m") & (F.col("model_m") < float("inf")), F.col("model_m"))
    source = F.when(told.isNotNull(), "model").when(bottom.isNotNull(), "box_bottom").otherwise("fallback")
    seen = views.withColumns({"bearing": F.pmod(F.coalesce("heading", F.lit(0.0)) + off, F.lit(360.0)), "source": source, "distance_m": F.greatest(F.lit(2.0), F.least(F.lit(25.0), F.coalesce(told, bottom, F.lit(8.0))))})
    lon, lat = geo.destination("lon", "lat", "bearing", "distance_m")
    return seen.withColumns({"confidence": F.col("raw_confidence") * F.when(F.col("source") == "fallback", 0.7).otherwise(1.0), "feature_lon": F.expr(lon), "feature_lat": F.expr(lat)})


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1> of a box in thousandths."""
    at = lambda i, size: F.get(box, F.lit(i)) * size / 1000
    return F.struct(at(1, width).alias("x0"), at(0, height).alias("y0"), at(3, width).alias("x1"), at(2, height).alias("y1"))


def travelled(images: DataFrame) -> DataFrame:
    """Images (id, ord, sequence, captured_at, lon, lat) with travel_m and travel, the distance and the direction from the
    image before to the one after in the sequence; at an end the image itself takes the missing one's place, and without
    a way there is no direction. Images without a sequence are one sequence."""
    w = Window.partitionBy("sequence").orderBy("captured_at", "ord")
    at = lambda f, c: F.coalesce(f(c).over(w), F.col(c))
    ahead = images.select("id", at(F.lag, "lon").alias("lon1"), at(F.lag, "lat").alias("lat1"), at(F.lead, "lon").alias("lon2"), at(F.lead, "lat").alias("lat2"))
    from ..plans.dialect import spark_text

    sql = spark_text(geo.geodesic_inverse("SELECT * FROM {ahead}", "lon1", "lat1", "lon2", "lat2"))
    found = images.sparkSession.sql(sql, ahead=ahead).select("id", F.col("dist").alias("travel_m"), F.col("azimuth").alias("travel"))
    return images.join(found, "id")


def turn(a: Column, b: Column) -> Column:
    """Degrees between two directions, 180 at most."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def distances(points: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """(pid, d): the distance of points (pid, x, y) to the nearest of `lines` (edge, line); points without one within `reach` are left out."""
    return near_edges(points, lines, reach).groupBy("pid").agg(F.min("d").alias("d"))


def road_sequences(images: DataFrame, reach: float = ROAD_M) -> DataFrame:
    """(sequence, share) of sequences at least half of whose images (sequence, road_m) lie within `reach` of a major road."""
    near = F.avg(F.coalesce((F.col("road_m") <= reach).cast("double"), F.lit(0.0)))
    return images.where("sequence IS NOT NULL").groupBy("sequence").agg(near.alias("share")).where("share >= 0.5")


STEPS = ["in_bbox", "not_fisheye", "with_heading", "fresh", "position_consistent", "not_on_major_road", "pano_heading_ok", "near_network"]


def funnel(images: DataFrame, walk: DataFrame, roads: DataFrame, bbox: tuple[float, float, float, float], now: Column, max_age: float = FRESH_YEARS) -> DataFrame:
    """Images with a column of each of STEPS, whether the image passes it and all before it.

    images: id, ord, sequence, captured_at (ms), lon, lat, x, y (place, also in metres), raw_x, raw_y, heading, is_pano,
    camera_type. walk, roads: (edge, line in the same metres). Distances are looked for up to their limits only."""
    own = images.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for k, x, y in ((0, "x", "y"), (1, "raw_x", "raw_y"))])).alias("p")).select(F.struct("id", "p.k").alias("pid"), "p.x", "p.y")
    west, south, east, north = bbox
    tests = {
        "in_bbox": F.col("lon").between(west, east) & F.col("lat").between(south, north), "not_fisheye": ~F.col("camera_type").eqNullSafe(F.lit("fisheye")),
        "with_heading": F.col("is_pano") | F.col("heading").isNotNull(), "fresh": age_years(F.col("captured_at"), now) <= max_age,
    }
    alive = lambda df, names: df.where(F.expr(" AND ".join(names)))
    rows = images
    for k, (name, test) in enumerate(tests.items()):
        before = F.col(list(tests)[k - 1]) if k else F.lit(True)
        rows = rows.withColumn(name, before & F.coalesce(test, F.lit(False)))
    road = distances(own, roads, ROAD_M).groupBy("pid.id").agg(F.min("d").alias("road_m"))
    rows = rows.join(road, "id", "left")
    # shares are of the images that are left, whatever their position's consistency
    bad = road_sequences(rows.where("fresh").select("sequence", "road_m")).select("sequence", F.lit(True).alias("_bad"))
    rows = rows.join(bad, "sequence", "left")
    rows = rows.withColumn("position_consistent", F.col("fresh") & F.coalesce(F.hypot(F.col("x") - F.col("raw_x"), F.col("y") - F.col("raw_y")) <= SHIFT_M, F.lit(False)))
    rows = rows.withColumn("not_on_major_road", F.col("position_consistent") & F.col("road_m").isNull() & F.col("_bad").isNull()).drop("_bad")
    ways = travelled(images.select("id", "ord", "sequence", "captured_at", "lon", "lat")).select("id", "travel")
    rows = rows.join(ways, "id")
    straight = F.coalesce(turn(F.col("travel"), F.coalesce("heading", F.lit(0.0))) <= TURN_DEG, F.lit(False))
    rows = rows.withColumn("pano_heading_ok", F.col("not_on_major_road") & (~F.col("is_pano") | straight))
    net = distances(rows.where("pano_heading_ok").select(F.col("id").alias("pid"), "x", "y"), walk, NETWORK_M).select(F.col("pid").alias("id"), F.col("d").alias("walk_m"))
    return rows.join(net, "id", "left").withColumn("near_network", F.col("pano_heading_ok") & F.col("walk_m").isNotNull())


def funnel_counts(passed: DataFrame) -> DataFrame:
    """One row: all images and how many pass each step."""
    return passed.agg(F.count("*").alias("metadata"), *[F.count_if(s).alias(s) for s in STEPS])


def thinned(images: DataFrame) -> DataFrame:
    """The best image of each cell of THIN_M and direction (of eight, panoramas apart), by captured_at, on_foot, quality,
    then the first; `ord` becomes that of the first image of its cell and direction."""
    h = F.pmod(F.col("heading"), F.lit(360.0))
    view = F.when(F.col("is_pano"), -2).when(h.isNull(), -1).otherwise(F.pmod(F.floor((h + 22.5) / 45).cast("int"), F.lit(8)))
    rank = F.struct("captured_at", "on_foot", "quality", -F.col("ord"))
    own = F.struct(*images.columns)
    best = images.groupBy(F.floor(F.col("x") / THIN_M).alias("cx"), F.floor(F.col("y") / THIN_M).alias("cy"), view.alias("view")).agg(F.max_by(own, rank).alias("b"), F.min("ord").alias("first"))
    return best.select(*[F.col(f"b.{c}") for c in images.columns if c != "ord"], F.col("first").alias("ord"))


def spread(images: DataFrame, cap: int) -> DataFrame:
    """`cap` images spread over blocks of BLOCK_M: the best of each block, then the second best of each, and so on, with
    `pos`. Blocks are ordered by their best image, of equals the one seen first."""
    block = [F.floor(F.col("x") / BLOCK_M).cast("long").alias("bx"), F.floor(F.col("y") / BLOCK_M).cast("long").alias("by")]
    order = [F.desc("captured_at"), F.desc("on_foot"), F.desc("quality"), F.asc("ord")]
    cut = images.select("*", *block)
    heads = cut.groupBy("bx", "by").agg(F.max(F.struct("captured_at", "on_foot", "quality")).alias("head"), F.min("ord").alias("seen"))
    deep = cut.withColumn("depth", F.row_number().over(Window.partitionBy("bx", "by").orderBy(*order))).where(F.col("depth") <= cap)
    rank = [F.col("depth"), F.col("head").desc(), F.col("seen")]
    top = deep.join(heads, ["bx", "by"]).orderBy(*rank).limit(cap)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*rank))).select(*images.columns, "pos")  # of `cap` rows


def turn_stats(images: DataFrame) -> DataFrame:
    """How far panoramas (heading, travel) look away from their way: median, shares within 30 and beyond 150 degrees."""
    d = turn(F.col("travel"), F.col("heading"))
    rows = images.where("is_pano").select(F.round(d, 6).alias("d")).where("d IS NOT NULL")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.agg(F.count("*").alias("panoramas"), F.median("d").alias("median_diff"), share(F.col("d") <= 30).alias("share_30"), share(F.col("d") >= 150).alias("share_150"))


def chosen(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `known` (id, ...) that `ids` (id, ord) names, with ord; ids that are not known are dropped."""
    return ids.select("id", "ord").join(known, "id")


def first_frames(frames_: DataFrame, n: int) -> DataFrame:
    """The first `n` frames by id, which is the feature's own limit."""
    return frames_.orderBy("frame_id").limit(n)


def latest(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row per `key`: the last to arrive, with `first_seen`, the arrival of the first."""
    own = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(own, arrival).alias("r"), F.min(arrival).alias("first_seen")).select("r.*", "first_seen")


# map tiles


def tiles(spark: SparkSession, bbox: tuple[float, float, float, float], size: float = TILE_DEG) -> DataFrame:
    """(west, south, east, north) of the tiles of a box; the last ones end with it."""
    def cut(low: float, high: float) -> list[tuple[float, float]]:
        out, at = [], low
        while at < high:  # sums, not products, as the tiles' names depend on their last digits
            out.append((at, min(at + size, high)))
            at += size
        return out

    span = lambda cuts: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cuts])
    rows = spark.range(1).select(F.explode(span(cut(bbox[0], bbox[2]))).alias("x")).select("x", F.explode(span(cut(bbox[1], bbox[3]))).alias("y"))
    return rows.select(F.col("x.a").alias("west"), F.col("y.a").alias("south"), F.col("x.b").alias("east"), F.col("y.b").alias("north"))


def quarters(found: DataFrame) -> DataFrame:
    """Each tile's four quarters."""
    mx, my = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    box = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    return found.select(F.inline(F.array(box(w, s, mx, my), box(mx, s, e, my), box(w, my, mx, n), box(mx, my, e, n))))


def refined(found: DataFrame, rows: DataFrame, full: int = FULL_TILE, least: float = LEAST_TILE_DEG) -> DataFrame:
    """The tiles in which a search for `rows` (lon, lat) ends, with n: tiles of `full` rows or more that are wider than
    `least` give way to their quarters, level by level. A row on a tile's edge counts for both sides, as in a search by box.

    Rows meet tiles by equality of cells of the widest tile's size."""
    left, done = written(found, "tiles", n=F.count(F.lit(1)), w=F.max(F.col("east") - F.col("west")), h=F.max(F.col("north") - F.col("south"))), None
    while left.measured["n"]:
        size = max(left.measured["w"], left.measured["h"])
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))  # noqa: B023, E731
        dealt = left.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
        at = rows.select("lon", "lat", F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
        met = dealt.join(at, ["cx", "cy"]).where("lon BETWEEN west AND east AND lat BETWEEN south AND north")
        counted = left.join(met.groupBy("west", "south", "east", "north").agg(F.count("*").alias("n")), ["west", "south", "east", "north"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        counted = written(counted.withColumn("split", (F.col("n") >= full) & (F.col("east") - F.col("west") > least)), "counted")
        kept = counted.where("NOT split").drop("split")
        done = kept if done is None else done.unionByName(kept)
        left = written(quarters(counted.where("split")), "tiles", n=F.count(F.lit(1)), w=F.max(F.col("east") - F.col("west")), h=F.max(F.col("north") - F.col("south")))
    return done if done is not None else found.withColumn("n", F.lit(0).cast("long"))


def searched(found: DataFrame, rows: DataFrame, full: int = FULL_TILE, least: float = LEAST_TILE_DEG) -> DataFrame:
    """`rows` (id, lon, lat, ...) that some of the refined tiles hold, once each."""
    ends = refined(found, rows.select("lon", "lat"), full, least)
    size = TILE_DEG
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    dealt = ends.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    at = rows.withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return at.join(dealt, ["cx", "cy"]).where(inside).select(*rows.columns).dropDuplicates(["id"])


def tile_text(found: DataFrame) -> DataFrame:
    """Tiles with `request`, the box as a search takes it, and `overpass`, as south, west, north, east."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    return found.withColumns({"request": F.concat_ws(",", *[six(c) for c in ("west", "south", "east", "north")]), "overpass": F.concat_ws(",", *[F.col(c).cast("string") for c in ("south", "west", "north", "east")])})


def numbered_images(images: DataFrame) -> DataFrame:
    """Images with `ord` by id, for inputs without an order of their own."""
    return numbered(images, [F.col("id")], "ord")
