"""Golden cases of image, camera and clustering operators, worked out by hand or by a plain loop."""

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wheelgraph.operators import cluster, coverage, evaluate, imagery, ordered, roadgraph

LINE = "array<struct<x:double,y:double>>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_camera_by_hand(spark):
    fov = lambda f: one(spark, imagery.field_of_view(F.lit(f).cast("double")))
    assert round(fov(0.5).fov, 6) == 90 and not fov(0.5).defaulted
    assert fov(0.0).defaulted and fov(None).fov == 70 and fov(9.0).defaulted  # 6 degrees are too narrow to believe
    assert round(fov(0.866025404).fov, 5) == 60
    p = one(spark, imagery.position(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))
    assert (p.lon, p.lat) == (3.0, 4.0) and one(spark, imagery.position(F.array(F.lit(1.0), F.lit(2.0)), F.lit(None).cast("array<double>"))).lon == 1.0
    heading = lambda a, b: one(spark, imagery.heading(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert [heading(350.0, None), heading(10.0, 0.0), heading(None, -90.0), heading(None, None)] == [350.0, 0.0, 270.0, None]
    assert [round(one(spark, imagery.turn(F.lit(a), F.lit(b))), 6) for a, b in ((350.0, 20.0), (10.0, 190.0), (5.0, 5.0))] == [30, 180, 0]
    now = F.lit(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC))
    at = int(datetime.datetime(2020, 1, 1, 12, tzinfo=datetime.UTC).timestamp() * 1000)
    assert one(spark, imagery.age_years(F.lit(at), now)) == 1460 / 365.25  # 1,460 whole days and a half
    assert [n for n, _ in imagery.crops(4)] == ["forward", "right", "back", "left"] and imagery.crops(3) == [("yaw000", 0.0), ("yaw120", 120.0), ("yaw240", 240.0)]
    box = one(spark, imagery.box_pixels(F.array(*[F.lit(v) for v in (100, 250, 500, 750)]), F.lit(800), F.lit(400)))
    assert tuple(box) == (200.0, 40.0, 600.0, 200.0)


def test_places_of_features_by_hand(spark):
    rows = [
        ("centre", 90.0, [0, 400, 400, 600], 10.0), ("right", 90.0, [0, 700, 400, 800], 10.0), ("floor", 0.0, [300, 450, 1000, 550], None), ("far", 0.0, [300, 450, 505, 550], None), ("sky", 0.0, [100, 450, 400, 550], 0.0),
        ("near", 0.0, [0, 450, 400, 550], 0.3), ("nan", 0.0, [0, 450, 400, 550], float("nan")), ("wide", 0.0, [0, 450, 400, 550], 99.0), ("left", None, [0, 200, 400, 300], 10.0),
    ]
    df = spark.createDataFrame([(n, h, b, d, 9.0, 50.0, 90.0, 1000, 1000, 0.5) for n, h, b, d in rows], "id string, heading double, box_2d array<int>, model_m double, lon double, lat double, fov double, width int, height int, raw_confidence double")
    got = {r.id: r for r in imagery.placed(df).collect()}
    assert (got["centre"].bearing, got["centre"].source, got["centre"].confidence) == (90.0, "model", 0.5)
    assert got["right"].bearing == pytest.approx(90 + math.degrees(math.atan(0.5))) and got["left"].bearing == pytest.approx(360 - math.degrees(math.atan(0.5)))
    # the lower edge of a square image of 90 degrees is 45 degrees below the horizon: 2 m from a camera 2 m up
    assert got["floor"].source == "box_bottom" and got["floor"].distance_m == pytest.approx(2.0)
    assert got["far"].distance_m == 25.0 and got["far"].source == "box_bottom"  # half a degree and more, 200 m by the angle
    assert (got["sky"].source, got["sky"].distance_m, got["sky"].confidence) == ("fallback", 8.0, 0.35) == (got["nan"].source, got["nan"].distance_m, got["nan"].confidence)
    assert got["near"].distance_m == 2.0 and got["wide"].distance_m == 25.0
    # ten metres east at 50 degrees: a radius of 6,390,702 m times the cosine
    assert got["centre"].feature_lon - 9 == pytest.approx(math.degrees(10 / (6_390_702 * math.cos(math.radians(50)))), rel=1e-5) and got["centre"].feature_lat == pytest.approx(50, abs=1e-9)


def image(i, x, y, at=0, heading=0.0, pano=False, foot=False, quality=0.0, sequence=None):
    return (i, i, sequence, at, x, y, heading, pano, foot, quality)


IMAGE = "id long, ord long, sequence long, captured_at long, x double, y double, heading double, is_pano boolean, on_foot boolean, quality double"


def test_thinning_and_spreading_equal_plain_loops(spark):
    r = random.Random(4)
    rows = [image(i, r.uniform(0, 90), r.uniform(0, 60), r.randrange(3), r.choice([None, 0.0, 22.5, 100.0, 359.0]), r.random() < 0.2, r.random() < 0.5, r.randrange(2) * 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, IMAGE).repartition(5)
    best = {}
    for row in rows:
        _, _, _, at, x, y, h, pano, foot, q = row
        key = (x // 8, y // 8, "p" if pano else -1 if h is None else int((h % 360 + 22.5) // 45) % 8)
        if key not in best or (at, foot, q) > best[key][0]:
            best[key] = ((at, foot, q), row)
    order = [row[1] for row in best.values()]  # in the order in which the cells were first seen
    got = imagery.thinned(df)
    assert [x.id for x in got.orderBy("ord").collect()] == [row[0] for row in order]
    blocks = {}
    for place, row in enumerate(order):
        blocks.setdefault((row[4] // 25, row[5] // 25), []).append((place, row))
    priority = lambda row: (row[3], row[8], row[9])
    for b in blocks.values():
        b.sort(key=lambda t: priority(t[1]), reverse=True)
    queue = sorted(blocks.values(), key=lambda b: priority(b[0][1]), reverse=True)
    want = [b[depth][1][0] for depth in range(max(map(len, queue))) for b in queue if depth < len(b)]
    for cap in (7, 60, 10_000):
        assert [x.id for x in imagery.spread(got, cap).orderBy("pos").collect()] == want[:cap]


def test_funnel_of_a_few_images(spark):
    day = 86_400_000
    now = 4000 * day
    rows = [  # each but the first and the last two fails one step
        (1, 100.0, 100.0, 0.0, 10.0, False, None, 3900), (2, 900.0, 100.0, 0.0, 10.0, False, None, 3900), (3, 100.0, 100.0, 0.0, 10.0, False, "fisheye", 3900), (4, 100.0, 100.0, 0.0, None, False, None, 3900), (5, 100.0, 100.0, 0.0, 10.0, False, None, 1800),
        (6, 100.0, 100.0, 16.0, 10.0, False, None, 3900), (7, 100.0, 210.0, 0.0, 10.0, False, None, 3900), (8, 100.0, 100.0, 0.0, 10.0, True, None, 3900), (9, 100.0, 130.0, 0.0, 10.0, False, None, 3900), (10, 110.0, 115.0, 15.0, 10.0, False, None, 3900), (11, 120.0, 100.0, 0.0, 80.0, True, None, 3901),
    ]
    east, north = 1 / 71_000, 1 / 111_000
    df = spark.createDataFrame([(i, i, 5 if i in (8, 11) else None if i % 2 else i, at * day, 10 + x * east, 50 + y * north, x, y, x + d, y, h, p, c) for i, x, y, d, h, p, c, at in rows], "id long, ord long, sequence long, captured_at long, lon double, lat double, x double, y double, raw_x double, raw_y double, heading double, is_pano boolean, camera_type string")
    lines = lambda rows: spark.createDataFrame(rows, f"edge long, line {LINE}")
    passed = imagery.funnel(df, lines([(1, [(0.0, 100.0), (300.0, 100.0)])]), lines([(1, [(0.0, 220.0), (300.0, 220.0)])]), (10.0, 50.0, 10 + 500 * east, 50 + 500 * north), F.timestamp_seconds(F.lit(now // 1000)))
    assert list(imagery.funnel_counts(passed).first().asDict().values()) == [11, 10, 9, 8, 7, 6, 5, 4, 3]
    assert sorted(r.id for r in passed.where("near_network").collect()) == [1, 10, 11]


def test_roads_of_sequences_and_ways(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 20.0), (2, 20.0), (2, 30.0), (2, 15.0), (None, 1.0), (3, None), (3, 5.0)], "sequence long, road_m double")
    assert {(r.sequence, r.share) for r in imagery.road_sequences(df).collect()} == {(1, 0.5), (3, 0.5)}
    rows = [(1, 1, 7, 0, 10.0, 50.0), (2, 2, 7, 1, 10.0, 50.001), (3, 3, 7, 1, 10.002, 50.001), (4, 4, 8, 0, 10.0, 50.0), (5, 5, None, 0, 10.0, 50.0), (6, 6, None, 1, 9.0, 50.0)]
    got = {r.id: r.travel for r in imagery.travelled(spark.createDataFrame(rows, "id long, ord long, sequence long, captured_at long, lon double, lat double")).collect()}
    assert got[1] == pytest.approx(0, abs=1e-6) and got[3] == pytest.approx(90, abs=0.01) and 50 < got[2] < 55 and got[4] is None and got[5] == pytest.approx(270, abs=0.5) == got[6]


def test_tiles_and_their_search(spark):
    got = imagery.tiles(spark, (1.0, 2.0, 1.012, 2.004)).collect()
    assert [(round(t.west, 6), round(t.east, 6), t.south, t.north) for t in got] == [(1.0, 1.005, 2.0, 2.004), (1.005, 1.01, 2.0, 2.004), (1.01, 1.012, 2.0, 2.004)]
    r = random.Random(2)
    rows = [(i, 1 + r.random() ** 3 * 0.01, 2 + r.random() ** 2 * 0.004) for i in range(300)] + [(500 + i, 1.0, 2.0) for i in range(40)]
    stack, want = [tuple(t) for t in got], []
    inside = lambda t: [i for i, x, y in rows if t[0] <= x <= t[2] and t[1] <= y <= t[3]]
    while stack:
        w, s, e, n = t = stack.pop()
        if len(inside(t)) >= 30 and e - w > imagery.LEAST_TILE_DEG:
            mx, my = (w + e) / 2, (s + n) / 2
            stack += [(w, s, mx, my), (mx, s, e, my), (w, my, mx, n), (mx, my, e, n)]
        else:
            want.append((*t, len(inside(t))))
    df, first = spark.createDataFrame(rows, "id long, lon double, lat double"), imagery.tiles(spark, (1.0, 2.0, 1.012, 2.004))
    assert sorted(map(tuple, imagery.refined(first, df, 30).collect())) == sorted(want)
    assert imagery.searched(first, df.unionByName(df.limit(9)), 30).count() == 340
    text = imagery.tile_text(first).first()
    assert text.request == "1.000000,2.000000,1.005000,2.004000" and text.overpass.startswith("2.0,1.0,2.004,1.005")


def test_frames_latest_and_limits(spark):
    df = spark.createDataFrame([(1, 350.0, None, True, 0.5), (2, None, 90.0, False, 0.5), (3, None, None, False, None)], "id long, compass double, compass_corrected double, is_pano boolean, focal double")
    got = [(r.frame_id, r.crop, r.heading, round(r.fov, 3)) for r in imagery.frames(df).orderBy("frame_id").collect()]
    assert got == [("1_back", "back", 170.0, 90.0), ("1_forward", "forward", 350.0, 90.0), ("1_left", "left", 260.0, 90.0), ("1_right", "right", 80.0, 90.0), ("2", None, 90.0, 90.0), ("3", None, 0.0, 70.0)]
    seen = imagery.latest(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, n int, v string"), "k", "n")
    assert sorted(map(tuple, seen.collect())) == [("a", 3, "z", 1), ("b", 2, "y", 2)]
    ids = spark.createDataFrame([(2, 0), (9, 1), (1, 2)], "id long, ord long")
    assert [r.id for r in imagery.chosen(ids, df).orderBy("ord").collect()] == [2, 1]
    assert [r.frame_id for r in imagery.first_frames(imagery.frames(df), 2).collect()] == ["1_back", "1_forward"]


DETECTION = "id long, type string, lon double, lat double, x double, y double, frame_id string, image_id string, feature_index int, raw_confidence double, confidence double, source string, height_cm double, captured_at string"


def detection(i, kind, x, y, frame, raw, adjusted=None, source="model", height=None, at="2020"):
    return (i, kind, 10 + math.degrees(x / (6_371_008.8 * math.cos(math.radians(50)))), 50 + math.degrees(y / 6_371_008.8), float(x), float(y), frame, frame.split("_")[0], i % 3, raw, raw if adjusted is None else adjusted, source, height, at)


def test_clusters_equal_single_linkage(spark):
    r = random.Random(6)
    rows = [detection(i, r.choice(["a", "b"]), round(r.uniform(0, 120), 1), round(r.uniform(0, 60), 1), f"f{i}", 0.9) for i in range(250)]
    rows += [detection(300 + i, "a", 6.0 * i * 0.9999, 200.0, f"c{i}", 0.9) for i in range(12)]  # a chain of steps just within reach
    rows += [detection(400 + i, "b", 50.0, 300.0, f"s{i}", 0.9) for i in range(30)]  # one place
    root = {row[0]: row[0] for row in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, q in itertools.combinations(rows, 2):
        if p[1] == q[1] and math.dist(p[4:6], q[4:6]) <= 6.0001:
            a, b = find(p[0]), find(q[0])
            root[max(a, b)] = min(a, b)
    got = {x.id: x.cluster for x in cluster.clusters(spark.createDataFrame(rows, DETECTION).repartition(4)).collect()}
    assert got == {i: find(i) for i in root} and got[311] == 300 and got[429] == 400


def test_rollup_by_hand(spark):
    rows = [
        detection(1, "stairs", 0, 0, "p_1", 0.6, 0.42, "fallback", 30.0, "2019-05"), detection(2, "stairs", 2, 0, "p_1", 0.5, 0.5, "model", None, "2021-01"), detection(3, "stairs", 4, 0, "q", 0.4, 0.4, "model", 50.0, "2020"),
        detection(7, "stairs", 100, 0, "r", 0.49), detection(8, "narrow", 100, 0, "r", 0.5), detection(9, "steep", 0, 50, "t", 0.0), detection(10, "steep", 1, 50, "u", 0.0),
    ]
    got = {r.type: r for r in cluster.barriers(cluster.clusters(spark.createDataFrame(rows, DETECTION))).collect()}
    assert set(got) == {"stairs", "narrow", "steep"}  # the weak one that stands alone goes, the one at the limit stays
    s = got["stairs"]
    # the frame p_1 counts once, by its surest adjusted confidence
    assert s.confidence == round(1 - 0.5 * 0.6, 3) and s.n_detections == 3 and s.n_views == 2
    # the raw confidence chooses and orders, the adjusted one weighs
    assert s.best_frame == "p_1" and [(v.frame_id, v.confidence) for v in s.views] == [("p_1", 0.6), ("p_1", 0.5), ("q", 0.4)]
    assert s.lon == round(rows[0][2] * 0.42 / 1.32 + rows[1][2] * 0.5 / 1.32 + rows[2][2] * 0.4 / 1.32, 6)
    assert s.height_cm == 40.0 and s.last_seen == "2021-01" and s.frame_ids == "p_1,q" and s.image_ids == ["p", "q"] and s.distance_sources == {"fallback": 1, "model": 2}
    assert got["steep"].lon is None and got["steep"].confidence == 0.0
    many = [detection(i, "narrow", 0, 0, f"f{i}", 0.9) for i in range(5)]
    assert cluster.barriers(cluster.clusters(spark.createDataFrame(many, DETECTION))).first().confidence == 0.97
    stats = cluster.geolocation_stats(spark.createDataFrame([("p", True), ("q", False)], "frame_id string, image_usable boolean"), spark.createDataFrame(rows, DETECTION), cluster.barriers(cluster.clusters(spark.createDataFrame(rows, DETECTION))).withColumn("snapped", F.col("type") == "stairs")).first()
    assert (stats.frames, stats.usable_frames, stats.detections_placed, stats.clusters_kept, stats.dropped_single_low_conf, stats.unsnapped_share, stats.multi_view) == (2, 1, 7, 3, 1, 0.667, 2)


def test_coverage_by_hand(spark):
    edges = spark.createDataFrame([(0, 0, [(0.0, 0.0), (100.0, 0.0)]), (1, 1, [(100.0, 0.0), (0.0, 0.0)]), (2, 2, [(0.0, 50.0), (0.0, 62.0)]), (3, 3, [(5.0, 5.0), (5.0, 5.0)])], f"ord long, edge long, line {LINE}")
    day = 86_400_000
    images = spark.createDataFrame([(0.0, 0.0, 5000 * day, True, False), (0.0, 0.0, 100 * day, False, True), (0.0, 70.0, 100 * day, False, False)], "x double, y double, captured_at long, is_pano boolean, on_foot boolean")
    r = coverage.report(edges, images, F.timestamp_seconds(F.lit(5001 * 86_400))).first()
    # of the street's 20 samples the first three lie within 15 m, of the short one's 3 (52, 56, 60) two
    assert (r.images, r.panoramas, r.on_foot, r.fresh, r.images_3y, r.edges, r.network_km) == (3, 1, 1, 1, 1, 3, 0.1)
    assert r.covered == round((15 + 8) / 112, 3) and r.covered_fresh == round(15 / 112, 3)
    assert [(y.year, y.n) for y in r.by_year] == [(1970, 2), (1983, 1)]
    values = coverage.by_first(spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None), (5, "z")], "ord int, v string"), F.col("v")).orderBy("pos")
    assert [(x.value, x.n) for x in values.collect()] == [("y", 2), ("x", 1), (None, 1), ("z", 1)]


def test_edges_of_the_graph(spark):
    nodes = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.1, 50.0), (3, 10.2, 50.1)], "node long, lon double, lat double")
    tags = "highway array<string>, surface array<string>, wheelchair array<string>, name array<string>"
    rows = [(5, 2, 1, "0", 12.345, ["footway"], ["sett", "asphalt", "sett"], None, ["B", "A"], [(10.0, 50.0), (10.05, 50.02), (10.1, 50.0)]), (7, 1, 2, "0", 12.345, None, None, None, None, None), (9, 2, 3, "0", 1.0, ["path", "steps"], None, ["no"], None, None), (3, 3, 3, "1", 2.0, None, [], None, [], None)]
    made = roadgraph.edge_list(nodes, spark.createDataFrame(rows, f"ord long, u long, v long, key string, length double, {tags}, line {LINE}"))
    got = made.orderBy("edge").collect()
    assert [(r.edge, r.u, r.v, r.len, r.surface, r.wheelchair_no, r.steps, r.name) for r in got] == [(0, 3, 3, 2.0, [], False, False, None), (1, 2, 1, 12.35 if round(12.345, 2) == 12.35 else got[1].len, ["asphalt", "sett"], False, False, "A, B"), (2, 2, 3, 1.0, [], True, True, None)]
    assert [tuple(p) for p in got[1].coords] == [(10.1, 50.0), (10.05, 50.02), (10.0, 50.0)] and [tuple(p) for p in got[2].coords] == [(10.1, 50.0), (10.2, 50.1)]
    asked = spark.createDataFrame([(1, 1, 2, "0"), (2, 2, 1, "0"), (3, 2, 1, "1"), (4, 3, 3, "1")], "id long, edge_u long, edge_v long, edge_key string")
    assert {r.id: r.edge for r in roadgraph.matched(asked, made).collect()} == {1: 1, 2: 1, 3: None, 4: 0}
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, v array<string>")
    assert [(r.f, r.n) for r in lists.select(roadgraph.first(F.col("v")).alias("f"), F.size(roadgraph.values(F.col("v"))).alias("n")).collect()] == [("a", 2), (None, 0), (None, 0)]
    assert [r.v for r in roadgraph.as_text(lists).collect()] == ['["a","b"]', "[]", None]
    both = roadgraph.united(spark.createDataFrame([("node", 1), ("way", 1)], "osm_type string, osm_id long"), spark.createDataFrame([("node", 1), ("node", 2)], "osm_type string, osm_id long"))
    assert both.count() == 3


def test_views_near_the_poles(spark):
    coords = "array<struct<lon:double,lat:double>>"
    for lat in (0.0, 60.0, 78.2, 89.5):
        wide = 111_320 * math.cos(math.radians(lat))
        truth = spark.createDataFrame([(1, [(20 + 20 / wide, lat)]), (2, [(20 + 30 / wide, lat)]), (3, [(20 - 20 / wide, lat)])], f"osm_id long, coords {coords}")
        frames = spark.createDataFrame([(20.0, lat, 90.0, 60.0, True)], "lon double, lat double, heading double, fov double, image_usable boolean")
        assert [r.osm_id for r in evaluate.in_view(truth, frames).collect()] == [1], lat


def test_nearest_in_degrees_then_metres(spark):
    # at 60 degrees a degree of longitude is half as long: the foot in degrees is not the nearest point
    shapes = spark.createDataFrame([("line", [(10.0, 60.0), (10.001, 60.001)]), ("point", [(10.0, 60.00005)])], "shape string, coords array<struct<lon:double,lat:double>>")
    spots = spark.createDataFrame([(1, 10.0002, 60.0)], "pid long, lon double, lat double")
    got = {r["shape"]: r.metres for r in evaluate.nearest_metres(spots, shapes, 20.0).collect()}
    foot = (10.0001, 60.0001)  # by degrees
    plain = lambda lon, lat: math.hypot((lon - 10.0002) * 111_412 * math.cos(math.radians(60)), (lat - 60.0) * 111_412)
    assert got["line"] == pytest.approx(plain(*foot), abs=0.1) and got["point"] == pytest.approx(plain(10.0, 60.00005), abs=0.1)
    assert evaluate.nearest_metres(spots.limit(0), shapes, 20.0).count() == 0


def test_scores_of_frames_and_sheets(spark):
    labels = spark.createDataFrame([("a", True, ["x", "y"]), ("b", True, []), ("c", False, None), ("d", True, ["x"])], "frame_id string, usable boolean, present array<string>")
    said = spark.createDataFrame([("a", True, ["x"]), ("b", True, ["y"]), ("c", True, ["y"]), ("e", True, ["x"])], "frame_id string, usable boolean, types array<string>")
    scores, errors = evaluate.frame_scores(labels, said, ["x", "y", "z"])
    got = {r.type: (r.tp, r.fp, r.fn, r.tn, r.precision_, r.recall_, r.f1) for r in scores.collect()}
    assert got == {"x": (1, 0, 0, None, 1.0, 1.0, 1.0), "y": (0, 2, 1, None, 0.0, 0.0, 0.0), "micro": (1, 2, 1, None, 0.333, 0.5, 0.4), "usable": (2, 1, 0, 0, 0.667, 1.0, 0.8)}
    assert sorted(map(tuple, errors.collect())) == [("a", "y", "fn"), ("b", "y", "fp"), ("c", "y", "fp")]
    assert [r.type for r in evaluate.by_weight(scores).collect()] == ["y", "x"]
    records = spark.createDataFrame([(f, [("y", [1, 2, 3, 4], 0.5), ("x", [5, 6, 7, 8], 0.25)]) for f in "abc"], "frame_id string, features array<struct<type:string,box_2d:array<int>,confidence:double>>")
    sheet = evaluate.error_sheet(errors, labels, records, per_sheet=2, columns=2).orderBy("frame_id").collect()
    assert [(r.frame_id, r.sheet, r.row, r.column, r.caption, [b.text for b in r.boxes]) for r in sheet] == [("a", 1, 0, 0, "a | label: x, y | FN:y", []), ("b", 1, 0, 1, "b | label: none | FP:y", ["y 0.50"]), ("c", 2, 0, 0, "c | label: none | FP:y", ["y 0.50"])]


def test_network_length_by_order_and_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 1, 5.0), (3, 4, 30.0), (5, 6, 1.0)], "u long, v long, length double")
    got = [tuple(r) for r in coverage.top_components(nodes, edges, 3).collect()]
    assert got == [(3, 2, 30.0), (1, 2, 10.0), (5, 2, 1.0)]
    streets = spark.createDataFrame([(1, 1, 2, ["7", "8"], 10.04), (2, 2, 1, ["8", "7"], 10.0), (3, 1, 2, ["7"], 10.0), (4, 1, 2, ["8", "7"], 10.2)], "ord long, u long, v long, osmid array<string>, length double")
    assert sorted(r.ord for r in roadgraph.physical(streets).collect()) == [1, 3, 4]
    assert ordered.numbered(nodes, [F.desc("node")], "n").where("n = 1").first().node == 7
