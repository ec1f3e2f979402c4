"""Pictures against plain loops over pixels."""

import math
import struct
import zlib

import numpy as np
import pytest

from wheelgraph.operators import pictures


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(pixels, kinds):
    """A PNG whose lines take the given filters in turn, byte by byte from the format's definition."""
    h, w, n = pixels.shape
    flat, out = pixels.reshape(h, -1).astype(int), b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        line = [kind]
        for x in range(w * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, x] - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out += bytes(int(v) for v in line)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)[:9]) + chunk(b"IDAT", zlib.compress(out)[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png_with_every_filter(n):
    pixels = np.random.default_rng(n).integers(0, 256, (11, 7, n), dtype=np.uint8)
    got = pictures.decoded(filtered(pixels, [4, 1, 3, 2, 0]))
    assert np.array_equal(got, pixels[:, :, :3] if n > 2 else np.repeat(pixels[:, :, :1], 3, 2))


def test_png_round_trip_and_faults():
    pixels = np.random.default_rng(9).integers(0, 256, (5, 8, 3), dtype=np.uint8)
    raw = pictures.encoded(pixels)
    assert np.array_equal(pictures.decoded(raw), pixels)
    for bad in (b"", b"GIF89a", raw[:20], raw[:-30], raw.replace(b"IHDR", b"IHDX")):
        with pytest.raises(pictures.UnreadablePicture):
            pictures.decoded(bad)


@pytest.mark.parametrize(("yaw", "fov"), [(0, 90), (90, 90), (180, 60), (270, 110), (33.5, 90)])
def test_view_equals_rays(yaw, fov):
    pano, side = np.random.default_rng(3).integers(0, 256, (24, 48, 3), dtype=np.uint8), 9
    got = pictures.view(pano, yaw, fov, side)
    t, turn = math.tan(math.radians(fov) / 2), math.radians(yaw)
    for i in range(side):
        for j in range(side):
            # a ray (east of the view, up, ahead), turned about the upright axis
            e, u, a = t * (2 * j / (side - 1) - 1), -t * (2 * i / (side - 1) - 1), 1.0
            e, a = e * math.cos(turn) + a * math.sin(turn), a * math.cos(turn) - e * math.sin(turn)
            x = (math.atan2(e, a) / (2 * math.pi) + 0.5) * 48 - 0.5
            y = min(23.0, max(0.0, (0.5 - math.asin(u / math.sqrt(e * e + u * u + a * a)) / math.pi) * 24 - 0.5))
            x0, y0 = math.floor(x), math.floor(y)
            want = sum(pano[min(23, y0 + dy), (x0 + dx) % 48] * ((x - x0) if dx else (1 - x + x0)) * ((y - y0) if dy else (1 - y + y0)) for dx in (0, 1) for dy in (0, 1))
            assert np.abs(got[i, j] - want).max() <= 0.5 + 1e-6


def test_views_of_panoramas(spark):
    pano = np.zeros((20, 40, 3), np.uint8)
    pano[:, :, 0] = np.arange(40) * 6  # red tells the direction
    rows = [("a", 350.0, pictures.encoded(pano)), ("b", None, b"junk"), ("c", 10.0, None), (None, 0.0, pictures.encoded(pano))]
    df = spark.createDataFrame(rows, "id string, heading double, content binary")
    got = {r.frame_id: r for r in pictures.cropped(df, 4, 90.0, 5).collect()}
    assert len(got) == 16
    assert [got[f"a_{c}"].heading for c in ("forward", "right", "back", "left")] == [350.0, 80.0, 170.0, 260.0]
    middle = {c: int(pictures.decoded(bytes(got[f"a_{c}"].png))[2, 2, 0]) for c in ("forward", "right", "left")}
    assert middle == {"forward": 117, "right": 177, "left": 57}  # pixels 19.5, 29.5 and 9.5
    assert got["b_forward"].png is None and got["b_forward"].fault and got["b_back"].heading == 180.0
    assert got["c_left"].fault == "no picture" and got["forward"].png is not None
    assert pictures.cropped(df.limit(0)).count() == 0
