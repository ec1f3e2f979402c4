"""Scores against mapped objects: ground truth, what cameras could see, matching per split, and map suggestions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, lines
from .graph import greedy_match
from .ordered import numbered
from .roadgraph import near_edges

VIEW_M, MATCH_M = 25.0, 10.0
#: Degrees of latitude of 25 m and more, anywhere.
CELL_DEG = 0.00025


def is_holdout(key: Column) -> Column:
    """Three of ten keys: the SHA-1 of the text as a number, modulo 10. As powers of 16 end in 6, four parts of ten digits do."""
    mark = F.sha1(key.cast("string"))
    a, b, c, last = (F.conv(F.substring(mark, i, 10), 16, 10).cast("long") for i in (1, 11, 21, 31))
    return (6 * (a % 10 + b % 10 + c % 10) + last) % 10 < 3


def ground_truth(elements: DataFrame) -> DataFrame:
    """(osm_id, type, coords, holdout) of mapped kerbs and steps (see files.elements)."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    kind = F.when((F.col("geom_type") == "Point") & tag("kerb").isin("lowered", "flush"), "curb_ramp").when((F.col("geom_type") == "Point") & (tag("kerb") == "raised"), "raised_curb")
    kind = kind.when((F.col("geom_type") == "LineString") & (tag("highway") == "steps"), "stairs")
    return elements.withColumn("type", kind).where("type IS NOT NULL").select("osm_id", "type", "coords", is_holdout(F.col("osm_id")).alias("holdout"))


def in_view(truth: DataFrame, frames: DataFrame) -> DataFrame:
    """Those of `truth` of which a usable camera (frame: lon, lat, heading, fov, image_usable) sees a point within 25 m.

    A line is tried at five places, in degrees. Cells of latitude and longitude meet by equality; the geodesic decides."""
    line = F.transform("coords", lambda p: lines.xy(p["lon"], p["lat"]))
    probes = F.when(F.size("coords") == 1, line).otherwise(F.array(*[lines.at(line, F.lit(i / 4)) for i in range(5)]))
    probe = truth.select("osm_id", F.explode(probes).alias("p")).select("osm_id", F.col("p.x").alias("plon"), F.col("p.y").alias("plat"))
    # bands of latitude; in each, cells of longitude are as wide as 25 m need at its side nearer to the pole
    wide = lambda band: CELL_DEG / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(band), F.abs(band + 1)) * CELL_DEG, F.lit(90.0)))), F.lit(1e-6))
    probe = probe.withColumn("cy", F.floor(F.col("plat") / CELL_DEG)).withColumn("cx", F.floor(F.col("plon") / wide(F.col("cy"))))
    c = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    cams = frames.where("image_usable").select("lon", "lat", "heading", "fov").withColumn("j", c).withColumn("i", c)
    cams = cams.withColumn("cy", F.floor(F.col("lat") / CELL_DEG) + F.col("j")).withColumn("cx", F.floor(F.col("lon") / wide(F.col("cy"))) + F.col("i")).drop("i", "j")
    pairs = probe.join(cams, ["cx", "cy"])
    dist, azimuth = geo.near_inverse("lon", "lat", "plon", "plat")
    seen = pairs.withColumns({"dist": F.expr(dist), "azimuth": F.expr(azimuth)})
    turn = F.abs(F.pmod(F.col("azimuth") - F.col("heading") + 540, F.lit(360.0)) - 180)
    near = seen.where((F.col("dist") <= VIEW_M) & ((F.col("dist") == 0) | (turn <= F.col("fov") / 2)))
    return truth.join(near.select("osm_id").distinct(), "osm_id", "left_semi")


def truth_metrics(pairs: DataFrame, truth: DataFrame, predicted: DataFrame, holdout: bool | None) -> DataFrame:
    """tp, fp, fn, precision_, recall_, f1 and gt_in_view per type, of a split (None: all as one).

    pairs (type, i, j, d within MATCH_M), truth (type, i, holdout), predicted (type, j). Both splits are matched at
    once; predictions matched to the other split are left out of this one's precision."""
    own = F.lit(True) if holdout is None else F.col("holdout") == holdout
    # ids of different types never meet, so one matching serves all types
    met = greedy_match(pairs.where(F.col("d") <= MATCH_M).select(F.struct("type", "i").alias("i"), F.struct("type", "j").alias("j"), "d"))
    met = met.select(F.col("i.type").alias("type"), F.col("i.i").alias("i")).join(truth, ["type", "i"])
    hits = met.groupBy("type").agg(F.count_if(own).alias("tp"), F.count_if(~own).alias("other"))
    n_gt, n_pred = truth.groupBy("type").agg(F.count_if(own).alias("gt_in_view")), predicted.groupBy("type").agg(F.count("*").alias("n_pred"))
    each = n_gt.join(n_pred, "type", "full").join(hits, "type", "left").na.fill(0)
    each = each.select("type", "tp", (F.col("n_pred") - F.col("other") - F.col("tp")).alias("fp"), (F.col("gt_in_view") - F.col("tp")).alias("fn"), "gt_in_view")
    return with_scores(each)


def with_scores(counts: DataFrame) -> DataFrame:
    """`counts` (tp, fp, fn) with precision_, recall_ (null without a base) and f1 to three digits."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return counts.withColumns({"precision_": F.round(p, 3), "recall_": F.round(r, 3), "f1": F.round(f1, 3)})


def truth_pairs(truth: DataFrame, predicted: DataFrame, reach: float = MATCH_M) -> DataFrame:
    """(type, i, j, d): objects of `truth` (type, i, line in metres; a point is a line of two equal points) and predictions (type, j,
    x, y) of the same type within `reach`."""
    lines_ = truth.select(F.struct("type", "i").alias("edge"), "line")
    met = near_edges(predicted.select(F.struct("type", "j").alias("pid"), "x", "y"), lines_, reach).where("pid.type = edge.type")
    return met.select("edge.type", "edge.i", "pid.j", "d")


def frame_scores(labels: DataFrame, predicted: DataFrame, active: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scores, errors) of types reported for labelled frames.

    labels: frame_id, usable, present (types); predicted: frame_id, usable, types. Only frames in both count. Scores hold
    tp, fp, fn and the measures of each type that occurs, of `micro` (all types) and of `usable`, which has tn, too; errors
    are rows of frame_id, type and kind."""
    both = labels.select("frame_id", F.col("usable").alias("lu"), F.coalesce("present", F.array().cast("array<string>")).alias("t")).join(predicted.select("frame_id", F.col("usable").alias("pu"), F.coalesce("types", F.array().cast("array<string>")).alias("p")), "frame_id")
    kinds = F.explode(F.array(*[F.lit(t) for t in active]))
    each = both.select("frame_id", "t", "p", kinds.alias("type")).select("frame_id", "type", F.array_contains("t", F.col("type")).alias("there"), F.array_contains("p", F.col("type")).alias("said")).where("there OR said")
    n = lambda c: F.count_if(c)
    counts = each.rollup("type").agg(n(F.col("there") & F.col("said")).alias("tp"), n(~F.col("there")).alias("fp"), n(~F.col("said")).alias("fn"))
    counts = counts.select(F.coalesce("type", F.lit("micro")).alias("type"), "tp", "fp", "fn", F.lit(None).cast("long").alias("tn"))
    usable = both.agg(n(F.col("lu") & F.col("pu")).alias("tp"), n(~F.col("lu") & F.col("pu")).alias("fp"), n(F.col("lu") & ~F.col("pu")).alias("fn"), n(~F.col("lu") & ~F.col("pu")).alias("tn"))
    errors = each.where("NOT (there AND said)").select("frame_id", "type", F.when(F.col("said"), "fp").otherwise("fn").alias("kind"))
    return with_scores(counts.unionByName(usable.select(F.lit("usable").alias("type"), "tp", "fp", "fn", "tn"))), errors


def by_weight(scores: DataFrame) -> DataFrame:
    """Types' scores, those with the most cases first."""
    return scores.where("type NOT IN ('micro', 'usable')").orderBy(F.desc(F.col("tp") + F.col("fp") + F.col("fn")), "type")


def predicted_types(detections: DataFrame, least: float = 0.5) -> DataFrame:
    """(frame_id, types): what usable frames show for good, sorted. detections: frame_id, usable, permanence, type, confidence."""
    sure = detections.where(F.col("usable") & (F.coalesce("permanence", F.lit("permanent")) == "permanent") & (F.col("confidence") >= least))
    return sure.groupBy("frame_id").agg(F.array_sort(F.collect_set("type")).alias("types"))


def sheets(rows: DataFrame, weight: Column, key: str, per_sheet: int, columns: int) -> DataFrame:
    """Rows with sheet, row and column of a contact sheet, the greatest weight first, then by `key`."""
    placed = numbered(rows.withColumn("_w", weight), [F.desc("_w"), F.col(key)], "_n").withColumn("_n", F.col("_n") - 1)
    at = F.col("_n") % per_sheet
    return placed.withColumns({"sheet": F.floor(F.col("_n") / per_sheet) + 1, "row": F.floor(at / columns), "column": at % columns}).drop("_w", "_n")


def error_sheet(errors: DataFrame, labels: DataFrame, records: DataFrame, per_sheet: int = 8, columns: int = 4) -> DataFrame:
    """(frame_id, caption, boxes, sheet, row, column) of frames on which labels and answers differ, by frame: the label, what is
    wrong, and the boxes of types that were reported wrongly. records: frame_id, features."""
    what = errors.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.upper("kind"), "type"))).alias("what"), F.collect_set(F.when(F.col("kind") == "fp", F.col("type"))).alias("wrong"))
    rows = what.join(labels.select("frame_id", "present"), "frame_id").join(records.select("frame_id", "features"), "frame_id")
    label = F.coalesce(F.nullif(F.array_join("present", ", "), F.lit("")), F.lit("none"))
    boxes = F.transform(F.filter("features", lambda f: F.array_contains("wrong", f["type"])), lambda f: F.struct(f["box_2d"].alias("box_2d"), F.concat(f["type"], F.format_string(" %.2f", f["confidence"])).alias("text")))
    made = rows.select("frame_id", F.concat(F.right("frame_id", F.lit(12)), F.lit(" | label: "), label, F.lit(" | "), F.array_join("what", " ")).alias("caption"), boxes.alias("boxes"))
    return sheets(made, F.lit(0), "frame_id", per_sheet, columns)


#: Tags of a suggestion, the layer in which the object would be, and what a mapper does: fixed values of the map.
TAGS = {"curb_ramp": ("kerb=lowered", "kerb", "Add kerb=lowered at the crossing."), "raised_curb": ("kerb=raised", "kerb", "Add kerb=raised at the crossing."), "stairs": ("highway=steps", "steps", "Add highway=steps.")}


def nearest_metres(points: DataFrame, shapes: DataFrame, reach: float) -> DataFrame:
    """(pid, shape, metres) of points (pid, lon, lat) and shapes (shape, coords) whose point nearest in degrees lies within `reach`
    metres on the ellipsoid. One point is a shape, too."""
    farthest = points.agg(F.max(F.abs(F.col("lat")))).first()[0]
    if farthest is None:
        return points.select("pid").join(shapes.select("shape"), how="cross").limit(0).withColumn("metres", F.lit(0.0))
    degrees = reach / (110_500.0 * max(math.cos(math.radians(min(farthest + 1, 89.9))), 1e-3))
    line = F.transform("coords", lambda p: lines.xy(p["lon"], p["lat"]))
    own = shapes.select(F.col("shape").alias("edge"), F.when(F.size("coords") == 1, F.array_repeat(line[0], 2)).otherwise(line).alias("line"))
    met = near_edges(points.select("pid", F.col("lon").alias("x"), F.col("lat").alias("y")), own, degrees, least=degrees)
    at = met.join(points.select("pid", "lon", "lat"), "pid").withColumn("metres", F.expr(geo.near_inverse("lon", "lat", "x", "y")[0]))
    return at.where(F.col("metres") <= reach).select("pid", F.col("edge").alias("shape"), "metres")


def suggestions(barriers: DataFrame, mapped: DataFrame, min_conf: float = 0.8, min_views: int = 2, kerb_m: float = 10.0, steps_m: float = 20.0) -> DataFrame:
    """Barriers (id, type, permanence, confidence, n_views, lon, lat) with `reason`, null for those to suggest, `tag`, `kind` and
    `instruction`. mapped: kind (kerb or steps), shape, coords; one of the kind within reach is there already."""
    of = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for t, v in TAGS.items() for x in (t, v[i])]), "type")
    rows = barriers.withColumns({"tag": of(0), "kind": of(1), "instruction": F.concat(of(2), F.lit(" Automatic detection: check the photo first."))})
    spots = rows.where("kind IS NOT NULL").select(F.struct("id", "kind").alias("pid"), "lon", "lat")
    met = nearest_metres(spots, mapped.select(F.struct("kind", "shape").alias("shape"), "coords"), max(kerb_m, steps_m)).where("pid.kind = shape.kind")
    there = met.where(F.col("metres") <= F.when(F.col("pid.kind") == "kerb", kerb_m).otherwise(steps_m)).select("pid.id").distinct().withColumn("_there", F.lit(True))
    reason = (
        F.when(F.col("tag").isNull(), "no_tag").when(F.coalesce("permanence", F.lit("permanent")) != "permanent", "temporary").when(F.col("confidence") < min_conf, "low_confidence")
        .when(F.col("n_views") < min_views, "few_views").when(F.col("_there"), "already_in_osm")
    )
    return rows.join(there, "id", "left").withColumn("reason", reason).drop("_there")


def suggestion_features(suggested: DataFrame, photo: str) -> DataFrame:
    """What a mapper gets of those of `suggestions` without a reason (best_frame, last_seen, height_cm, description). photo: a link
    with {image} for the image's id, the frame's up to its first underscore."""
    image = F.substring_index("best_frame", "_", 1)
    link = F.concat(*[x for i, part in enumerate(photo.split("{image}")) for x in ([image] if i else []) + [F.lit(part)]])
    made = suggested.where("reason IS NULL")
    return made.select("id", F.col("type").alias("barrier_type"), F.col("tag").alias("suggested_tags"), "confidence", "n_views", F.col("height_cm").alias("estimated_height_cm"), "description", F.left(F.coalesce(F.col("last_seen").cast("string"), F.lit("")), F.lit(10)).alias("last_seen"), link.alias("photo"), "instruction", "lon", "lat")


def suggestion_counts(suggested: DataFrame) -> DataFrame:
    """(reason, n) of all reasons, also of those that nothing has, and of `suggested`."""
    reasons = ["no_tag", "temporary", "low_confidence", "few_views", "already_in_osm"]
    sums = suggested.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in reasons], F.count_if(F.col("reason").isNull()).alias("suggested"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in [*reasons, "suggested"]])))


def site_stats(barriers: DataFrame, frames: DataFrame, ledger: DataFrame, metrics: DataFrame, feedback: DataFrame, budget: int) -> DataFrame:
    """One row on a finished run, from one aggregate of each table.

    barriers (type, snapped, n_views), frames (captured_at), ledger (calls; null counts as one), metrics (split, frames,
    precision_, recall_), feedback (status). Scores come from the hold-out, else from tuning; the table by type from
    all frames, else from that same split. `by_type` is ordered by number, then type."""
    by_type = barriers.groupBy("type").agg(F.count("*").alias("total"), F.count_if(~F.col("snapped")).alias("unsnapped"))
    by_type = by_type.agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("_by"), "type", "total", "unsnapped"))).alias("t"))
    by_type = by_type.select(F.transform("t", lambda t: F.struct(t["type"].alias("type"), t["total"].alias("total"), t["unsnapped"].alias("unsnapped"))).alias("by_type"))
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    headline = F.when(F.count_if(F.col("split") == "holdout") > 0, "holdout").when(F.count_if(F.col("split") == "tuning") > 0, "tuning")
    scored = lambda c: F.when(F.count_if(F.col("split") == "holdout") > 0, of("holdout", c)).otherwise(of("tuning", c))
    day = F.substring(F.col("captured_at").cast("string"), 1, 10)
    parts = [
        barriers.agg(F.count("*").alias("barriers"), F.count_if("snapped").alias("snapped"), F.count_if(F.col("n_views") > 1).alias("multi_view")),
        by_type,
        frames.agg(F.count("*").alias("frames"), F.min(day).alias("photos_from"), F.max(day).alias("photos_to")),
        ledger.agg(F.coalesce(F.sum(F.coalesce("calls", F.lit(1))), F.lit(0)).alias("calls_used"), F.lit(budget).alias("calls_budget")),
        metrics.agg(
            headline.alias("split"), scored("frames").alias("split_frames"), scored("precision_").alias("precision_"), scored("recall_").alias("recall_"),
            F.when(F.count_if(F.col("split") == "all_frames") > 0, "all_frames").otherwise(headline).alias("by_type_split"),
        ),
        feedback.agg(F.count("*").alias("feedback_barriers"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "rejected").alias("rejected")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    return one


def timed_routes(routes: DataFrame, by: list[str]) -> DataFrame:
    """Routes (ms, differs) by the columns `by`: their number, the upper median and the greatest time, and how many differ from the
    shortest way. The upper median is the greatest value that at least half of the values reach."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms DESC)")
    return routes.groupBy(*by).agg(F.count("*").alias("routes"), upper.alias("median_ms"), F.max("ms").alias("max_ms"), F.count_if("differs").alias("differing"))
