"""Polylines as array<struct<x, y>> columns, by higher-order functions: no explode, no shuffle, one row stays one row.

A line of fewer than two points has no segments: its length is 0 and functions of a place on it are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AT = "struct<run:double,d:double,along:double,x:double,y:double>"


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """array<struct<a, b, size>> of successive points."""
    pair = lambda i: F.struct(F.get(line, i).alias("a"), F.get(line, i + 1).alias("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.size(line) - 2), pair)
    sized = F.transform(pairs, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("size")))
    return F.when(F.size(line) >= 2, sized)


def length(line: Column) -> Column:
    return F.when(F.size(line) >= 2, F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + s["size"])).otherwise(F.lit(0.0))


def project(line: Column, px: Column, py: Column) -> Column:
    """struct<d, t, x, y>: distance to, fraction along and place of the nearest point; of equally near segments the first."""

    def nearer(z: Column, s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        dot = (px - s["a"]["x"]) * dx + (py - s["a"]["y"]) * dy
        f = F.when(s["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot, s["size"] * s["size"])))).otherwise(0.0)
        x, y = s["a"]["x"] + f * dx, s["a"]["y"] + f * dy
        d, run = F.hypot(px - x, py - y), z["run"] + s["size"]
        pick = lambda new, old: F.when(d < z["d"], new).otherwise(old)
        return F.struct(run.alias("run"), pick(d, z["d"]).alias("d"), pick(z["run"] + f * s["size"], z["along"]).alias("along"), pick(x, z["x"]).alias("x"), pick(y, z["y"]).alias("y")).cast(_AT)

    none = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("d"), F.lit(0.0).alias("along"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")).cast(_AT)
    done = lambda z: F.struct(z["d"].alias("d"), F.coalesce(F.try_divide(z["along"], z["run"]), F.lit(0.0)).alias("t"), z["x"].alias("x"), z["y"].alias("y"))
    return F.when(F.size(line) >= 2, F.aggregate(segments(line), none, nearer, done))


def _runs(line: Column) -> Column:
    """Length up to each point, in one pass over the segments."""
    add = lambda z, s: F.concat(z, F.array(F.element_at(z, -1) + s["size"]))
    return F.aggregate(segments(line), F.array(F.lit(0.0)), add)


def runs(line: Column) -> Column:
    """array<struct<nth, a, b, size, run, total>>: segments with the length before each and of the whole."""
    total = length(line)
    dealt = F.arrays_zip(segments(line).alias("s"), F.slice(_runs(line), 1, F.size(line) - 1).alias("m"))
    return F.transform(dealt, lambda z, i: F.struct(i.alias("nth"), z["s"]["a"].alias("a"), z["s"]["b"].alias("b"), z["s"]["size"].alias("size"), z["m"].alias("run"), total.alias("total")))


def at(line: Column, fraction: Column) -> Column:
    """The point at a fraction of the length; fractions are held to 0..1."""
    metres = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * length(line)

    def walk(z: Column, s: Column) -> Column:
        inside = z["open"] & ((z["run"] + s["size"]) >= metres)
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(metres - z["run"], s["size"]), F.lit(0.0))))
        x, y = s["a"]["x"] + f * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + f * (s["b"]["y"] - s["a"]["y"])
        # past the last segment, by rounding, the line's end holds
        return F.struct(
            (z["run"] + s["size"]).alias("run"), (z["open"] & ~inside).alias("open"),
            F.when(inside, x).when(z["open"], s["b"]["x"]).otherwise(z["x"]).alias("x"), F.when(inside, y).when(z["open"], s["b"]["y"]).otherwise(z["y"]).alias("y"),
        ).cast("struct<run:double,open:boolean,x:double,y:double>")

    start = F.struct(F.lit(0.0).alias("run"), F.lit(True).alias("open"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")).cast("struct<run:double,open:boolean,x:double,y:double>")
    return F.when(F.size(line) >= 2, F.aggregate(segments(line), start, walk, lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y"))))


def between(line: Column, a: Column, b: Column) -> Column:
    """The part between two fractions: interpolated ends and the points strictly inside; reversed if a > b."""
    low, high, total = F.least(a, b), F.greatest(a, b), length(line)
    dealt = F.arrays_zip(line.alias("p"), _runs(line).alias("m"))
    inner = F.transform(F.filter(dealt, lambda z: (z["m"] > low * total) & (z["m"] < high * total)), lambda z: z["p"])
    part = F.concat(F.array(at(line, low)), inner, F.array(at(line, high)))
    return F.when(F.size(line) >= 2, F.when(a <= b, part).otherwise(F.reverse(part)))


def oriented(line: Column, ux: Column, uy: Column) -> Column:
    """The line with the end that is nearer to (ux, uy) first; a tie leaves it as it is."""
    gap = lambda p: F.pow(p["x"] - ux, 2) + F.pow(p["y"] - uy, 2)
    return F.when((F.size(line) >= 2) & (gap(F.get(line, F.lit(0))) > gap(F.get(line, F.size(line) - 1))), F.reverse(line)).otherwise(line)


def rounded(line: Column, digits: int = 6) -> Column:
    return F.transform(line, lambda p: xy(F.round(p["x"], digits), F.round(p["y"], digits)))


def samples(line: Column, step: float = 5.0) -> Column:
    """array<struct<x, y, weight>>: middles of equal parts of at most `step`; none for a line without length."""
    total = length(line)
    n = F.greatest(F.lit(1), F.ceil(total / step)).cast("int")
    spots = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(line, (i + 0.5) / n).alias("p"), (total / n).alias("weight")))
    flat = F.transform(spots, lambda s: F.struct(s["p"]["x"].alias("x"), s["p"]["y"].alias("y"), s["weight"].alias("weight")))
    return F.when(total > 0, flat).otherwise(F.slice(flat, 1, 0))


def inside(line: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether any point lies in a box, its sides included."""
    return F.exists(line, lambda p: p["x"].between(west, east) & p["y"].between(south, north))
