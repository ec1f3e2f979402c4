import math
import random

import pytest
from pyspark.sql import functions as F

from wheelgraph.functions import geo, lines


def walk(line, f):
    total, run = sum(math.dist(p, q) for p, q in zip(line, line[1:])), 0.0
    for p, q in zip(line, line[1:]):
        size = math.dist(p, q)
        if run + size >= f * total:
            r = (f * total - run) / size if size else 0.0
            return p[0] + r * (q[0] - p[0]), p[1] + r * (q[1] - p[1])
        run += size
    return line[-1]


def test_places_on_lines_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        pts = [(float(r.randrange(12)), float(r.randrange(12))) for _ in range(r.randrange(2, 6))]
        rows.append((i, pts, r.uniform(-3, 15), r.uniform(-3, 15), r.random(), r.random()))
    df = spark.createDataFrame(rows, "id long, line array<struct<x:double,y:double>>, px double, py double, a double, b double")
    line, c = F.col("line"), F.col
    got = df.select("id", lines.length(line).alias("n"), lines.project(line, c("px"), c("py")).alias("p"), lines.at(line, c("a")).alias("m"), lines.between(line, c("a"), c("b")).alias("part"), lines.samples(line).alias("s"), lines.oriented(line, c("px"), c("py")).alias("o"))
    for g, (i, pts, px, py, a, b) in zip(sorted(got.collect()), rows):
        total = sum(math.dist(p, q) for p, q in zip(pts, pts[1:]))
        assert g.n == pytest.approx(total)
        fine = min(math.dist((px, py), walk(pts, k / 2000)) for k in range(2001)) if total else math.dist((px, py), pts[0])
        assert g.p.d == pytest.approx(fine, abs=0.05) and g.p.d <= fine + 1e-9
        assert math.dist(walk(pts, g.p.t), (px, py)) == pytest.approx(g.p.d, abs=1e-6)
        if total:
            assert (g.m.x, g.m.y) == pytest.approx(walk(pts, a), abs=1e-6)
            assert (g.part[0].x, g.part[0].y) == pytest.approx(walk(pts, a), abs=1e-6) and (g.part[-1].x, g.part[-1].y) == pytest.approx(walk(pts, b), abs=1e-6)
            assert sum(math.dist(p, q) for p, q in zip(g.part, g.part[1:])) == pytest.approx(abs(a - b) * total, abs=1e-6)
        assert sum(s.weight for s in g.s) == pytest.approx(total) and len(g.s) == (math.ceil(total / 5 - 1e-12) if total else 0)
        assert math.dist(g.o[0], (px, py)) <= math.dist(g.o[-1], (px, py)) + 1e-9


def test_lines_without_segments(spark):
    df = spark.createDataFrame([(1, []), (2, [(1.0, 2.0)]), (3, None)], "id long, line array<struct<x:double,y:double>>")
    c, one = F.col("line"), F.lit(0.5)
    for r in df.select(lines.length(c), lines.project(c, one, one), lines.at(c, one), lines.between(c, one, one), F.size(lines.samples(c))).collect():
        assert tuple(r)[:4] == (0.0, None, None, None) and r[4] <= 0


def test_utm_round_trip_and_known_place(spark):
    # meridian arcs: 0.9996 of the quarter meridian's share; a degree of longitude at the equator
    source = "SELECT * FROM VALUES (9e0, 0e0, 500000e0, 0e0), (9e0, 45e0, 500000e0, 4982950.400e0), (12e0, 0e0, 833978.557e0, 0e0) AS v(lon0, lat0, e, n)"
    for r in spark.sql(geo.to_utm(source, "lon0", "lat0", "9")).collect():
        assert r.east == pytest.approx(r.e, abs=0.002) and r.north == pytest.approx(r.n, abs=0.002)
    grid = "SELECT 6.2 + id % 12 * 0.5 AS lon0, 1.0 + id * 0.7 AS lat0 FROM range(110)"
    there = geo.to_utm(grid, "lon0", "lat0", "9.0")
    for r in spark.sql(geo.from_utm(there, "east", "north", "9.0")).collect():
        assert r.lon == pytest.approx(float(r.lon0), abs=1e-8) and r.lat == pytest.approx(float(r.lat0), abs=1e-8)
    east = spark.sql(f"SELECT {geo.central_meridian('8.53')} AS m, {geo.central_meridian('-180.0')} AS w").first()
    assert (east.m, east.w) == (9, -177)
