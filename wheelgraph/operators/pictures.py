"""Pixels of pictures: PNG both ways, and flat views out of panoramas.

A picture is height x width x 3 bytes in numpy. PNG of 8 bits a channel is read here; other formats (JPEG) need Pillow, which
may be absent. Work is a picture at a time in Arrow batches, no shuffle.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .imagery import PANO_FOV, crops

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
MOST_PIXELS = 200_000_000
#: Bytes of a batch of encoded pictures; a single larger one is a batch of its own.
BATCH_BYTES = 32 << 20


class UnreadablePicture(ValueError):
    pass


def encoded(picture: np.ndarray) -> bytes:
    """A PNG without filters."""
    height, width, _ = picture.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(picture, np.uint8).reshape(height, -1)], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Lines of (filter, bytes) with the filters undone."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + step), np.uint8)  # a line above and a pixel to the left are zeros
    for y, (kind, body) in enumerate(zip(lines[:, 0], lines[:, 1:], strict=True), 1):
        row, above = out[y], out[y - 1]
        if kind == 0:
            row[step:] = body
        elif kind == 1:
            row[step:] = np.cumsum(body.reshape(-1, step), 0, np.uint8).ravel()
        elif kind == 2:
            row[step:] = body + above[step:]
        elif kind in (3, 4):
            done, up = [0] * step + body.tolist(), above.tolist()
            for x in range(step, len(done)):
                a, b, c = done[x - step], up[x], up[x - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                done[x] = (done[x] + guess) & 255
            row[:] = done
        else:
            raise UnreadablePicture(f"filter {kind}")
    return out[1:, step:]


def _png(raw: bytes) -> np.ndarray:
    at, head, body = len(SIGNATURE), None, []
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">2I5B", raw, at + 8)
        elif kind == b"IDAT":
            body.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None:
        raise UnreadablePicture("no header")
    width, height, bits, colour, _, _, laced = head
    if bits != 8 or colour not in CHANNELS or laced:
        raise UnreadablePicture("only plain PNG of 8 bits a channel")
    if width * height > MOST_PIXELS:
        raise UnreadablePicture(f"more than {MOST_PIXELS} pixels")
    n = CHANNELS[colour]
    wanted = height * (1 + width * n)
    data = zlib.decompressobj().decompress(b"".join(body), wanted)
    if len(data) != wanted or not wanted:
        raise UnreadablePicture("not all lines are there")
    pixels = _unfiltered(np.frombuffer(data, np.uint8).reshape(height, -1), n).reshape(height, width, n)
    return np.repeat(pixels[:, :, :1], 3, 2) if n < 3 else pixels[:, :, :3]


def decoded(raw: bytes) -> np.ndarray:
    """Any picture's pixels; transparency is dropped. Raises UnreadablePicture."""
    try:
        if raw.startswith(SIGNATURE):
            return _png(raw)
        from PIL import Image

        with Image.open(io.BytesIO(raw)) as found:
            if found.width * found.height > MOST_PIXELS:
                raise UnreadablePicture(f"more than {MOST_PIXELS} pixels")
            return np.asarray(found.convert("RGB"))
    except ImportError:
        raise UnreadablePicture("this format needs Pillow") from None
    except (OSError, struct.error, zlib.error) as e:
        raise UnreadablePicture(str(e)) from e


def view(pano: np.ndarray, yaw: float, fov: float = PANO_FOV, side: int = 768) -> np.ndarray:
    """The flat square view that looks `yaw` degrees to the right of the middle of an equirectangular picture, `fov` wide.

    Rays go through the sides' outermost pixels; colours are interpolated between the four pixels around, round the seam."""
    height, width, _ = pano.shape
    flat = np.tan(np.radians(fov) / 2) * np.linspace(-1, 1, side)
    right, down = np.meshgrid(flat, flat)
    lon = np.arctan(right) + np.radians(yaw)
    lat = np.arctan2(-down, np.hypot(right, 1))
    x = ((lon / (2 * np.pi) + 0.5) * width - 0.5) % width
    y = np.clip((0.5 - lat / np.pi) * height - 0.5, 0, height - 1)
    x0, y0 = np.floor(x).astype(np.int64) % width, np.floor(y).astype(np.int64)
    x1, y1 = (x0 + 1) % width, np.minimum(y0 + 1, height - 1)
    fx, fy = (x - np.floor(x))[..., None], (y - y0)[..., None]
    top = pano[y0, x0] * (1 - fx) + pano[y0, x1] * fx
    low = pano[y1, x0] * (1 - fx) + pano[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def cropped(images: DataFrame, n: int = 4, fov: float = PANO_FOV, side: int = 768) -> DataFrame:
    """`n` views of every panorama (id, heading, content): frame_id, crop, heading, png, fault.

    The middle of a panorama looks along its heading; no heading counts as 0, as in `imagery.frames`. A picture that can't be read, a null one too, gives its
    frames with a null png and the reason in fault. An empty table gives no rows."""
    spark = images.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = pa.schema([("frame_id", pa.string()), ("crop", pa.string()), ("heading", pa.float64()), ("png", pa.binary()), ("fault", pa.string())])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, angle, raw = (batch.column(k)[i].as_py() for k in range(3))
                try:
                    pano, fault = (decoded(raw), None) if raw is not None else (None, "no picture")
                except UnreadablePicture as e:
                    pano, fault = None, str(e)
                for name, off in crops(n):  # a view at a time leaves the task
                    made = encoded(view(pano, off, fov, side)) if pano is not None else None
                    yield pa.RecordBatch.from_pylist([{"frame_id": "_".join(p for p in (key, name) if p is not None), "crop": name, "heading": ((angle or 0.0) + off) % 360, "png": made, "fault": fault}], schema)

    rows = images.select(F.col("id").cast("string").alias("id"), F.col("heading").cast("double").alias("heading"), F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(cut, "frame_id string, crop string, heading double, png binary, fault string")
