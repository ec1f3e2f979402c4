"""Camera and map geometry as SQL expressions: Catalyst compiles them, and DuckDB reads the same text.

Distances are metres, angles degrees. Four models stay apart: WGS84 geodesics,
the sphere of clustering, UTM metres, and the router's local plane.
"""

from __future__ import annotations

SPHERE = 6_371_008.8
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)


def pmod(a: str, n: str) -> str:
    """Floor modulus; the result has the sign of n."""
    return f"(({a}) - ({n}) * floor(({a}) / ({n})))"


def angle_diff(a: str, b: str) -> str:
    return f"abs({pmod(f'({a}) - ({b}) + 180', '360')} - 180)"


def sector(heading: str) -> str:
    """One of 8 sectors; -1 without a heading."""
    return f"CASE WHEN {heading} IS NULL THEN -1 ELSE CAST(floor(({pmod(heading, '360')} + 22.5) / 45) AS INT) % 8 END"


def hfov(focal: str, default: float = 70.0) -> str:
    """Horizontal field of view of a focal length in image widths, or the default outside 20..150."""
    fov = f"degrees(2 * atan(0.5 / {focal}))"
    return f"CASE WHEN {focal} > 0 THEN CASE WHEN {fov} BETWEEN 20 AND 150 THEN {fov} ELSE {default} END ELSE {default} END"


def vertical_fov(fov: str, width: str, height: str) -> str:
    return f"degrees(2 * atan(tan(radians({fov}) / 2) * {height} / {width}))"


def bearing_offset(x: str, fov: str) -> str:
    return f"degrees(atan((({x}) - 0.5) * 2 * tan(radians({fov}) / 2)))"


def distance_from_bottom(y: str, vfov: str, camera: float = 2.0) -> str:
    """Distance to the ground seen at the box's lower edge; null if it is at most half a degree below the horizon."""
    below = f"degrees(atan((({y}) - 0.5) * 2 * tan(radians({vfov}) / 2)))"
    return f"CASE WHEN {below} > 0.5 THEN {camera} / tan(radians({below})) END"


def utm_epsg(lon: str, lat: str) -> str:
    return f"(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + CAST(floor(({lon} + 180) / 6) AS INT) + 1)"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    half = lambda a, b: f"power(sin(radians(({b}) - ({a})) / 2), 2)"
    return f"(2 * {SPHERE} * asin(sqrt(least(1.0, {half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)}))))"


def geodesic_inverse(source: str, lon1: str, lat1: str, lon2: str, lat2: str, steps: int = 6) -> str:
    """SQL: `source` with dist (m) and azimuth (degrees) on WGS84 by Vincenty's iteration, unrolled. Equal points: 0 and null."""
    f, a, b = WGS84_F, WGS84_A, WGS84_B
    q = f"SELECT *, atan({1 - f} * tan(radians({lat1}))) AS u1, atan({1 - f} * tan(radians({lat2}))) AS u2, radians({lon2} - {lon1}) AS dl, radians({lon2} - {lon1}) AS lam FROM ({source}) s0"
    drop = "u1, u2, dl"
    for i in range(steps + 1):
        q = f"SELECT *, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss{i}, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs{i} FROM ({q}) a{i}"
        q = f"SELECT *, CASE WHEN ss{i} = 0 THEN 0.0 ELSE cos(u1) * cos(u2) * sin(lam) / ss{i} END AS sa{i} FROM ({q}) b{i}"
        q = f"SELECT *, CASE WHEN sa{i} * sa{i} = 1 THEN 0.0 ELSE cs{i} - 2 * sin(u1) * sin(u2) / (1 - sa{i} * sa{i}) END AS cm{i}, {f} / 16 * (1 - sa{i} * sa{i}) * (4 + {f} * (4 - 3 * (1 - sa{i} * sa{i}))) AS cc{i}, lam AS lam{i} FROM ({q}) c{i}"
        names = f"lam, {drop}" if i == steps else "lam"
        if i < steps:
            step = f"dl + (1 - cc{i}) * {f} * sa{i} * (atan2(ss{i}, cs{i}) + cc{i} * ss{i} * (cm{i} + cc{i} * cs{i} * (2 * cm{i} * cm{i} - 1)))"
            q = f"SELECT * EXCEPT ({names}), {step} AS lam FROM ({q}) d{i}"
    n = steps
    q = f"SELECT *, (1 - sa{n} * sa{n}) * {(a * a - b * b) / (b * b)} AS uu FROM ({q}) e"
    q = f"SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb FROM ({q}) f"
    correction = f"kb * ss{n} * (cm{n} + kb / 4 * (cs{n} * (2 * cm{n} * cm{n} - 1) - kb / 6 * cm{n} * (4 * ss{n} * ss{n} - 3) * (4 * cm{n} * cm{n} - 3)))"
    azimuth = pmod("degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)))", "360")
    return f"SELECT *, CASE WHEN ss{n} = 0 THEN 0.0 ELSE {b} * ka * (atan2(ss{n}, cs{n}) - {correction}) END AS dist, CASE WHEN ss{n} = 0 THEN NULL ELSE {azimuth} END AS azimuth FROM ({q}) g"


def destination(lon: str, lat: str, bearing: str, dist: str) -> tuple[str, str]:
    """(lon, lat) reached on WGS84; the radii of curvature at the start hold to a millimetre over the 25 m that placing uses."""
    e2 = WGS84_F * (2 - WGS84_F)
    w = f"(1 - {e2} * power(sin(radians({lat})), 2))"
    north, east = f"({dist} * cos(radians({bearing})))", f"({dist} * sin(radians({bearing})))"
    m, n = f"({WGS84_A * (1 - e2)} / power({w}, 1.5))", f"({WGS84_A} / sqrt({w}))"
    return f"({lon} + degrees({east} / ({n} * cos(radians({lat})))))", f"({lat} + degrees({north} / {m}))"


_N = WGS84_F / (2 - WGS84_F)
_UTM_SCALE = 0.9996 * WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krüger's coefficients to the fourth power: fixed values.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def central_meridian(lon: str) -> str:
    return f"(6 * floor((({lon}) + 180) / 6) - 177)"


def to_utm(source: str, lon: str, lat: str, meridian: str) -> str:
    """SQL: `source` with east and north (m) of the transverse Mercator projection at `meridian`, by Krüger's series (below a millimetre within a zone)."""
    k = 2 * _N**0.5 / (1 + _N)
    q = f"SELECT *, sinh(atanh(sin(radians({lat}))) - {k!r} * atanh({k!r} * sin(radians({lat})))) AS tt, radians({lon} - {meridian}) AS dm FROM ({source}) u0"
    q = f"SELECT *, atan2(tt, cos(dm)) AS xi, atanh(sin(dm) / sqrt(1 + tt * tt)) AS eta FROM ({q}) u1"
    wave = lambda a, b: " + ".join(f"{c!r} * {a}({2 * i} * xi) * {b}({2 * i} * eta)" for i, c in enumerate(_ALPHA, 1))
    east, north = f"500000.0 + {_UTM_SCALE!r} * (eta + {wave('cos', 'sinh')})", f"CASE WHEN {lat} < 0 THEN 10000000.0 ELSE 0.0 END + {_UTM_SCALE!r} * (xi + {wave('sin', 'cosh')})"
    return f"SELECT * EXCEPT (tt, dm, xi, eta), {east} AS east, {north} AS north FROM ({q}) u2"


def from_utm(source: str, east: str, north: str, meridian: str) -> str:
    """SQL: `source` with lon and lat of northern east and north."""
    q = f"SELECT *, {north} / {_UTM_SCALE!r} AS x0, ({east} - 500000.0) / {_UTM_SCALE!r} AS e0 FROM ({source}) v0"
    wave = lambda a, b: " - ".join(f"{c!r} * {a}({2 * i} * x0) * {b}({2 * i} * e0)" for i, c in enumerate(_BETA, 1))
    q = f"SELECT *, x0 - {wave('sin', 'cosh')} AS xi, e0 - {wave('cos', 'sinh')} AS eta FROM ({q}) v1"
    q = f"SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM ({q}) v2"
    lat = "degrees(chi + " + " + ".join(f"{c!r} * sin({2 * i} * chi)" for i, c in enumerate(_DELTA, 1)) + ")"
    return f"SELECT * EXCEPT (x0, e0, xi, eta, chi), {meridian} + degrees(atan2(sinh(eta), cos(xi))) AS lon, {lat} AS lat FROM ({q}) v3"


def near_inverse(lon1: str, lat1: str, lon2: str, lat2: str) -> tuple[str, str]:
    """(distance, azimuth) on WGS84 of places less than a kilometre apart, by the radii of curvature between them; far below a millimetre at 25 m.

    One flat expression: a filter on it can be pushed down, which the unrolled iteration of `geodesic_inverse` cannot bear."""
    e2 = WGS84_F * (2 - WGS84_F)
    mid = f"radians((({lat1}) + ({lat2})) / 2)"
    w = f"(1 - {e2!r} * power(sin({mid}), 2))"
    north, east = f"(radians(({lat2}) - ({lat1})) * {WGS84_A * (1 - e2)!r} / power({w}, 1.5))", f"(radians(({lon2}) - ({lon1})) * cos({mid}) * {WGS84_A!r} / sqrt({w}))"
    return f"sqrt(power({north}, 2) + power({east}, 2))", pmod(f"degrees(atan2({east}, {north}))", "360")
