import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from wheelgraph.operators import evaluate, ordered, roadgraph

LINE = "array<struct<x:double,y:double>>"


def test_running_sums_and_numbers(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(50), r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v long").repartition(5)
    got = {x.id: (x.s, x.n) for x in ordered.numbered(ordered.running(df, [F.desc("k"), F.col("id")], F.col("v"), "s"), [F.desc("k"), F.col("id")], "n").collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])), 1):
        total += v
        assert got[i] == (total, n)
    assert ordered.numbered(df.limit(0), [F.col("id")], "n").count() == 0


def edges(spark, rows):
    return spark.createDataFrame(rows, f"edge long, line {LINE}")


def test_snapping_in_two_steps(spark):
    net = edges(spark, [(3, [(0.0, 0.0), (0.0, 40.0)]), (4, [(0.0, 40.0), (0.0, 90.0)])])
    curbs = spark.createDataFrame([(0, "node", 0.0, 40.0), (1, "crossing", -2.0, 70.0), (2, "crossing", 90.0, 90.0)], "ord long, kind string, ox double, oy double")
    rows = [(1, "narrow", 7.0, 22.0), (2, "narrow", 12.5, 22.0), (3, "raised_curb", 6.0, 47.0), (4, "curb_ramp", -1.0, 69.0), (5, "curb_ramp", 3.0, 20.0), (6, "stairs", 12.0, 55.0), (7, "curb_ramp", 88.0, 88.0)]
    got = {r.pid: r for r in roadgraph.snapped(spark.createDataFrame(rows, "pid long, type string, x double, y double"), net, curbs).collect()}
    assert (got[1].target, got[1].edge, got[1].snap_m) == ("edge", 3, 7.0)
    assert got[2].target is None and (got[6].target, got[6].edge) == ("edge", 4)
    assert (got[3].target, got[3].edge, got[3].on_y, got[3].snap_m) == ("node", 3, 40.0, round(math.hypot(6, 7), 6))
    assert (got[4].target, got[4].edge) == ("crossing", 4) and (got[5].target, got[5].edge) == ("edge", 3)
    assert (got[7].target, got[7].edge) == ("crossing", None)  # a crossing without an edge near to it


def test_nearest_edge_equals_brute_force(spark):
    r = random.Random(5)
    net = [(i, [(r.uniform(0, 300), r.uniform(0, 300)) for _ in range(3)]) for i in range(40)]
    pts = [(i, r.uniform(0, 300), r.uniform(0, 300)) for i in range(150)]

    def gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    want = {}
    for i, x, y in pts:
        d, e = min((min(gap((x, y), a, b) for a, b in zip(n, n[1:])), e) for e, n in net)
        if d <= 12:
            want[i] = (e, pytest.approx(d, abs=1e-5))
    got = roadgraph.nearest_edge(spark.createDataFrame(pts, "pid long, x double, y double"), edges(spark, net), 12.0)
    assert {r.pid: (r.edge, r.snap_m) for r in got.collect()} == want


def test_undirected_and_largest_component(spark):
    e = spark.createDataFrame([(0, 1, 2, 0, 5.0), (1, 2, 1, 0, 5.0), (2, 1, 2, 1, 5.0), (3, 4, 5, 0, 90.0), (4, 5, 4, 0, 90.0), (5, 2, 3, 0, 1.0)], "ord long, u long, v long, key long, length double")
    assert sorted(r.ord for r in roadgraph.undirected(e).collect()) == [0, 2, 3, 5]
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    assert {r.node for r in roadgraph.largest_component(nodes, e).collect()} == {4, 5}
    assert {r.node for r in roadgraph.largest_component(nodes, e, "nodes").collect()} == {1, 2, 3}


def test_barriers_on_edges(spark):
    net = spark.createDataFrame([(0, False, [(0.0, 0.0), (100.0, 0.0)]), (1, True, [(0.0, 50.0), (100.0, 50.0)])], f"edge long, steps boolean, line {LINE}")
    own = spark.createDataFrame([("a", "step", 0.7, 0, 0.25), ("gone", "step", 0.7, 9, 0.5)], "id string, type string, conf double, edge long, t double")
    kerbs = spark.createDataFrame([(7, "flush", 40.0, 4.0), (8, "raised", 40.0, 9.0), (9, "no", 40.0, 0.0)], "osm_id long, kerb string, x double, y double")
    got = [(r.ord, r.id, r.type, r.edge, r.t) for r in roadgraph.on_edges(own, net, kerbs).orderBy("ord").collect()]
    assert got == [(0, "a", "step", 0, 0.25), (1, "osm-steps-1", "stairs", 1, 0.5), (2, "osm-kerb-7", "curb_ramp", 0, 0.4)]


def test_truth_views_and_scores(spark):
    kx, ky = 111_320 * math.cos(math.radians(52.02)), 111_260.0
    at = lambda x, y: (8.53 + x / kx, 52.02 + y / ky)
    rows = [(1, "Point", {"kerb": "flush"}, [at(0, 10)]), (2, "Point", {"kerb": "raised"}, [at(0, -10)]), (3, "Point", {"kerb": "lowered"}, [at(0, 40)]), (4, "LineString", {"highway": "steps"}, [at(-15, 15), at(15, 15)]), (5, "Point", {"kerb": "no"}, [at(0, 5)]), (6, "Point", {"kerb": "raised"}, [at(0, 0)])]
    els = spark.createDataFrame(rows, "osm_id long, geom_type string, tags map<string,string>, coords array<struct<lon:double,lat:double>>")
    truth = evaluate.ground_truth(els)
    assert {r.osm_id: r.holdout for r in truth.collect()} == {i: int(hashlib.sha1(str(i).encode()).hexdigest(), 16) % 10 < 3 for i in (1, 2, 3, 4, 6)}
    cams = spark.createDataFrame([(*at(0, 0), 0.0, 70.0, True), (*at(0, 0), 180.0, 70.0, False)], "lon double, lat double, heading double, fov double, image_usable boolean")
    assert {r.osm_id for r in evaluate.in_view(truth, cams).collect()} == {1, 4, 6}
    t = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, False)], "type string, i long, holdout boolean")
    p = spark.createDataFrame([("s", 10), ("s", 11), ("s", 12), ("k", 13)], "type string, j long")
    pairs = spark.createDataFrame([("s", 1, 10, 2.0), ("s", 2, 10, 1.0), ("s", 1, 11, 5.0), ("s", 3, 12, 11.0)], "type string, i long, j long, d double")
    got = {r.type: (r.tp, r.fp, r.fn, r.precision_, r.recall_, r.f1) for r in evaluate.truth_metrics(pairs, t, p, False).collect()}
    assert got == {"s": (1, 1, 1, 0.5, 0.5, 0.5), "k": (0, 1, 0, 0.0, None, None)}
    assert {r.type: r.tp for r in evaluate.truth_metrics(pairs, t, p, None).collect()} == {"s": 2, "k": 0}


def test_suggestions(spark):
    """A line of steps 15 m and a kerb 12 m from the place of b and c: near enough for steps only."""
    east = 1 / (111_412 * math.cos(math.radians(48)))
    rows = [("a", "stairs", None, 0.9, 2, 0.0), ("b", "stairs", None, 0.9, 2, 100.0), ("c", "curb_ramp", None, 0.9, 2, 100.0), ("d", "tree", None, 0.9, 2, 0.0), ("e", "stairs", "temporary", 0.9, 2, 0.0), ("f", "stairs", None, 0.7, 2, 0.0), ("g", "raised_curb", None, 0.8, 1, 0.0), ("h", "raised_curb", "permanent", 0.8, 2, 109.0)]
    b = spark.createDataFrame([(*r[:5], 11 + r[5] * east, 48.0, f"img{r[0]}_left", "2022-03-04 05:06", 12.0, None) for r in rows], "id string, type string, permanence string, confidence double, n_views long, lon double, lat double, best_frame string, last_seen string, height_cm double, description string")
    mapped = spark.createDataFrame([("steps", 1, [(11 + 115 * east, 47.9999), (11 + 115 * east, 48.0001)]), ("kerb", 1, [(11 + 112 * east, 48.0)]), ("steps", 2, [(11.5, 48.0), (11.6, 48.0)])], "kind string, shape long, coords array<struct<lon:double,lat:double>>")
    found = evaluate.suggestions(b, mapped)
    got = {r.id: (r.reason, r.tag) for r in found.collect()}
    assert got == {"a": (None, "highway=steps"), "b": ("already_in_osm", "highway=steps"), "c": (None, "kerb=lowered"), "d": ("no_tag", None), "e": ("temporary", "highway=steps"), "f": ("low_confidence", "highway=steps"), "g": ("few_views", "kerb=raised"), "h": ("already_in_osm", "kerb=raised")}
    assert {r.reason: r.n for r in evaluate.suggestion_counts(found).collect()} == {"no_tag": 1, "temporary": 1, "low_confidence": 1, "few_views": 1, "already_in_osm": 2, "suggested": 2}
    made = {r.id: r for r in evaluate.suggestion_features(found, "p?k={image}&x").collect()}
    assert set(made) == {"a", "c"} and made["a"].photo == "p?k=imga&x" and made["a"].last_seen == "2022-03-04" and made["c"].instruction.startswith("Add kerb=lowered")
