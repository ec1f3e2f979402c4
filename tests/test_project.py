"""A small made-up town through every command: files in, files out."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from wheelgraph import project
from wheelgraph.sources import sinks

LON, LAT = 9.2, 49.1
EAST, NORTH = 1 / (111_412 * math.cos(math.radians(LAT))), 1 / 111_220
BOX = (LON - 100 * EAST, LAT - 100 * NORTH, LON + 900 * EAST, LAT + 600 * NORTH)


def at(x, y):
    return {"lon": LON + x * EAST, "lat": LAT + y * NORTH}


def point(x, y):
    return {"coordinates": list(at(x, y).values())}


@pytest.fixture(scope="module")
def town(tmp_path_factory):
    root = tmp_path_factory.mktemp("town")
    for d in ("raw/images", "raw/walk/edges", "processed"):
        (root / d).mkdir(parents=True)
    yaml = f"area: {{name: Town, bbox: [{', '.join(map(repr, BOX))}]}}\nprofiles: [chair]\nimagery: {{max_age_years: 5}}\nbudget: {{max_images: 6}}\nrouting: {{max_detour: 0.5}}\ndetection: {{types: [stairs, raised_curb]}}\n"
    (root / "project.yaml").write_text(yaml)
    (root / "profiles.yaml").write_text("profiles: {chair: {forbidden: [stairs], penalty_m: {raised_curb: 50}, surface_multiplier: {asphalt: 1.0, unknown: 1.1}, osm_rules: {wheelchair_no: forbid}}}")
    # a grid of 3 x 2 blocks of 200 m, listed both ways
    node = lambda i, j: 10 * i + j
    streets = [((i, j), (i + 1, j)) for i in range(3) for j in range(3)] + [((i, j), (i, j + 1)) for i in range(4) for j in range(2)]
    edges = []
    for (i, j), (k, m) in streets:
        for (a, b), (c, d) in (((i, j), (k, m)), ((k, m), (i, j))):
            edges.append({"ord": len(edges), "u": node(a, b), "v": node(c, d), "key": "0", "osmid": [str(node(i, j))], "length": 200.0, "highway": ["footway"], "surface": ["asphalt"] if j else None, "wheelchair": None, "name": ["Main"] if j == 0 else None, "coords": [at(200 * a, 200 * b), at(200 * c, 200 * d)]})
    (root / "raw/walk/edges/e.json").write_text("\n".join(map(json.dumps, edges)))
    way = lambda i, tags, *p: {"type": "way", "id": i, "tags": tags, "geometry": [at(*q) for q in p]}
    elements = [{"type": "node", "id": 1, "tags": {"kerb": "raised"}, **at(202, 1)}, {"type": "node", "id": 2, "tags": {"highway": "crossing"}, **at(400, 0)}, way(3, {"highway": "steps", "step_count": "4", "ramp": "yes"}, (300, 195), (310, 205)), way(4, {"highway": "motorway"}, (0, 500), (800, 500))]
    (root / "raw/map.json").write_text(json.dumps({"elements": elements}))
    now = datetime.datetime.now(datetime.UTC).timestamp() * 1000
    shots = [{"id": f"i{k}", "captured_at": int(now - k * 86_400_000), "geometry": point(40.0 * k, 3), "compass_angle": 90.0, "is_pano": False, "camera_parameters": [0.7], "width": 100, "sequence": "s", "on_foot": True} for k in range(12)]
    shots += [{"id": "old", "captured_at": int(now - 4000 * 86_400_000), "geometry": point(10, 3), "compass_angle": 90.0}, {"id": "road", "captured_at": int(now), "geometry": point(300, 495), "compass_angle": 0.0}]
    (root / "raw/images/images").write_text("\n".join(map(json.dumps, shots)))
    (root / "raw/images/bbox.json").write_text(json.dumps(BOX))
    feature = lambda t, c, d: {"type": t, "box_2d": [300, 480, 700, 520], "confidence": c, "estimated_distance_m": d, "permanence": "permanent", "description_en": "a", "description_de": "b"}
    view = lambda i, x, y, *f: {"frame_id": i, "image_id": i, "heading": 90.0, "fov": 70.0, "captured_at": "2024-05-06", "image_usable": True, "sidewalk_visible": True, "sidewalk_surface": "asphalt", "features": list(f), **at(x, y)}
    views = [view("i2", 80, 3, feature("stairs", 0.9, 10.0)), view("i1", 76, 3, feature("stairs", 0.8, 14.0)), view("i9", 500, 3, feature("raised_curb", 0.9, 5.0), feature("stairs", 0.3, 20.0)), view("x", 550, 100, feature("stairs", 0.95, 8.0))]
    (root / "processed/detections.jsonl").write_text("\n".join(map(json.dumps, views)))
    (root / "labels.json").write_text(json.dumps({"frames": {"i2": {"usable": True, "present": ["stairs"], "notes": ""}, "i9": {"usable": True, "present": ["stairs"], "notes": ""}}}))
    return root


def test_all_commands(spark, town, capsys):
    s, now = project.settings(str(town / "project.yaml")), project._now()
    assert (s.profiles, s.max_images, s.max_age_years, s.types) == (["chair"], 6, 5, ["stairs", "raised_curb"])
    assert project.main(["check", str(town / "project.yaml")]) == 1 and "run geolocate" in capsys.readouterr().out
    counts = project.fetch_images(spark, s, now).first()
    assert (counts.metadata, counts.in_bbox, counts.fresh, counts.not_on_major_road, counts.near_network, counts.thinned, counts.selected) == (14, 14, 13, 12, 12, 12, 6)
    assert spark.read.parquet(s.path("processed", "frames.parquet")).count() == 6
    report = project.coverage_report(spark, s, now).first()
    # of 17 streets of 200 m, images every 40 m from 0 to 440: about 15 m on both sides of each
    assert report.images == 14 and report.edges == 17 and report.network_km == 3.4 and 0.08 < report.covered < 0.13
    summary = {k: v.collect() for k, v in project.osm_summary(spark, s).items()}
    assert summary["network"][0].edges == 17 and summary["network"][0].length_km == 3.4 and summary["components"][0].nodes == 12 and summary["components"][0].length == 6800.0
    assert [(r.value, r.n) for r in sorted(summary["surface"], key=lambda r: r.pos)] == [("asphalt", 10), ("untagged", 7)] or sum(r.n for r in summary["surface"]) == 17
    assert tuple(summary["steps"][0]) == (1, 1, 1) and [(r.value, r.n) for r in summary["kerbs"]] == [("raised", 1)]
    found = project.geolocate(spark, s).first()
    assert (found.frames, found.usable_frames, found.detections_placed, found.clusters_kept, found.dropped_single_low_conf) == (4, 4, 5, 3, 1)
    rows = {(r.type, r.snapped): r for r in project.barriers(spark, s).collect()}
    assert set(rows) == {("stairs", True), ("raised_curb", True), ("stairs", False)} or {t for t, _ in rows} == {"stairs", "raised_curb"}
    stairs = next(r for r in rows.values() if r.type == "stairs" and r.n_views == 2)
    assert stairs.snapped and stairs.target == "edge" and {stairs.edge_u, stairs.edge_v} == {0, 10} and stairs.confidence == 0.97 and abs(stairs.lon - (LON + 90 * EAST)) < 2e-6
    stats = project.graph(spark, s).first()
    assert (stats.nodes, stats.edges, stats.unmatched, stats.osm_kerbs) == (12, 17, 0, 1) and stats.detected_on_graph >= 1
    place = lambda x, y: f"{LAT + y * NORTH},{LON + x * EAST}"
    told = project.route(spark, s, place(20, 0), place(180, 0), "chair")
    assert told["error"] is None and told["baseline"]["length_m"] == 160.0 and told["accessible"]["length_m"] > 500 and told["avoided"] == [{"type": "stairs", "n": 1}] and told["warnings"][0]["code"] == "detour_exceeds_limit"
    assert project.route(spark, s, "x", place(0, 0), "chair")["error"] == "a place has no coordinates" and project.route(spark, s, place(0, 0), place(9, 9), "tram")["error"] == "unknown profile tram"
    # two people say there are no stairs
    sent = spark.createDataFrame([(stairs.barrier_id, "reject", " gone ", datetime.datetime(2025, 1, 1, 0, k), f"10.0.0.{k}") for k in range(2)] + [(stairs.barrier_id, "maybe", "", datetime.datetime(2025, 1, 1), "1"), ("none", "reject", "", datetime.datetime(2025, 1, 1), "1")], "barrier_id string, verdict string, comment string, created_at timestamp, forwarded string")
    assert sorted(r.code for r in project.submit(spark, s, sent, "salt").collect()) == [201, 201, 404, 422]
    assert project.route(spark, s, place(20, 0), place(180, 0), "chair")["accessible"]["length_m"] == 160.0
    many = spark.createDataFrame([(stairs.barrier_id, "confirm", None, datetime.datetime(2025, 2, 1, 0, k), "10.9.9.9") for k in range(33)], "barrier_id string, verdict string, comment string, created_at timestamp, forwarded string")
    codes = [r.code for r in project.submit(spark, s, many, "salt").collect()]
    assert codes.count(201) == 30 and codes.count(429) == 3
    status = {r.barrier_id: r.feedback.status for r in project.listed(spark, s).collect() if r.feedback}
    assert status == {stairs.barrier_id: "confirmed"} and project.listed(spark, s, "raised_curb").count() == 1
    scores = {r.type: (r.tp, r.fp, r.fn) for r in project.evaluated(spark, s).collect()}
    assert scores["stairs"] == (1, 0, 1) and scores["raised_curb"] == (0, 1, 0)
    reasons = {r.reason: r.n for r in project.suggested(spark, s).collect()}
    assert sum(reasons.values()) == 3 and reasons["suggested"] == 1
    assert project.pilot(spark, s, 3).count() == 3 and project.frame(spark, s, "none").count() == 0
    routes = project.trial_routes(spark, s, 2).collect()
    assert len(routes) == 2 and all(r.accessible_m >= r.shortest_m - 0.2 for r in routes)
    photos = project.export_site(spark, s, str(town / "site")).collect()
    assert {r.frame_id for r in photos} == {"i1", "i2", "i9", "x"} and (town / "site/ids").exists()
    small = {r.part: r.n for r in project.excerpt(spark, s, (LON - 10 * EAST, LAT - 10 * NORTH, LON + 210 * EAST, LAT + 10 * NORTH), str(town / "small")).collect()}
    assert small["barriers"] == 1 and small["network"] == 8
    assert project.main(["check", str(town / "project.yaml")]) == 0
    assert project.main(["barriers", str(town / "project.yaml"), "--types", "stairs"], spark) == 0 and "stairs-" in capsys.readouterr().out


def test_settings_are_checked(tmp_path, spark):
    bad = {"box": "area: {bbox: [9, 2, 8, 3]}", "types": "area: {bbox: [1, 2, 3, 4]}\ndetection: {types: [stairs, lava]}", "budget": "area: {bbox: [1, 2, 3, 4]}\nbudget: {max_images: 0}"}
    for name, text in bad.items():
        (tmp_path / f"{name}.yaml").write_text(text)
        with pytest.raises(ValueError):
            project.settings(str(tmp_path / f"{name}.yaml"))
    (tmp_path / "p.yaml").write_text("area: {name: X, bbox: [1, 2, 3, 4]}\nrouting: {max_detour: null}")
    s = project.settings(str(tmp_path / "p.yaml"))
    assert s.max_detour is None and project.images(spark, s) is None and project.public(s)["routing"] is False
    (tmp_path / "raw/images").mkdir(parents=True)
    (tmp_path / "raw/images/bbox.json").write_text("[1, 2, 3, 5]")
    assert project.images(spark, s) is None  # fetched for another box
    assert project.main(["coverage", str(tmp_path / "p.yaml")], spark) == 2


def test_reports_are_whole(spark, monkeypatch):
    df = spark.range(30).select(F.col("id").alias("n"))
    assert sinks.markdown(df, "T").count("\n") == 34
    monkeypatch.setattr(sinks, "MOST_LINES", 29)
    with pytest.raises(ValueError):
        sinks.markdown(df, "T")


def test_views_of_panoramas(spark, tmp_path):
    import numpy as np

    from wheelgraph.operators import pictures

    s = project.Settings(tmp_path, "Town", BOX)
    chosen = spark.createDataFrame([("a", 90.0, True), ("b", None, True), ("c", 0.0, True), ("flat", 0.0, False), ("x.y", 5.0, True)], "id string, heading double, is_pano boolean")
    with pytest.raises(FileNotFoundError, match="photos"):
        project.cut_panoramas(spark, s, chosen)
    photos = tmp_path / "raw/images/photos"
    photos.mkdir(parents=True)
    picture = pictures.encoded(np.full((8, 16, 3), 77, np.uint8))
    for name, raw in (("a.png", picture), ("b.jpg", b"none"), ("flat.png", picture), ("x.y.png", picture), ("other.png", picture), ("c.txt", picture)):
        (photos / name).write_bytes(raw)
    counts = {r.fault: r.n for r in project.cut_panoramas(spark, s, chosen, side=4).collect()}
    assert counts.pop(None) == 8 and counts.pop("no picture") == 4 and list(counts.values()) == [4]
    views = spark.read.parquet(s.path("processed", "views")).where("fault IS NULL").collect()
    assert {r.frame_id for r in views} == {f"{k}_{c}" for k in ("a", "x.y") for c in ("forward", "right", "back", "left")}
    assert all((pictures.decoded(bytes(r.png)) == 77).all() for r in views)
