"""Images of grids: a PNG encoder, and grids and outlines drawn with it. An image is one value, so its size is bounded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of an image; larger ones are for tiles, each an image of its own.
MOST_PIXELS = 64_000_000


def png(width: int, height: int, pixels: bytes, alpha: bool = False, level: int = 6) -> bytes:
    """The file of an image whose pixels are bytes of red, green and blue (and alpha), row by row from the top; level 0 stores them
    as they are."""
    wide = width * (4 if alpha else 3)
    if width <= 0 or height <= 0 or len(pixels) != wide * height:
        raise ValueError(f"{len(pixels)} bytes are no image of {width} by {height}")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + pixels[k * wide : (k + 1) * wide] for k in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def grey(share: float) -> tuple[int, int, int]:
    v = round(255 * max(0.0, min(1.0, share)))
    return v, v, v


def draw(cells: DataFrame, width: int, height: int, colour: Callable[[float], tuple[int, int, int]] = grey, low: float = 0.0, high: float = 1.0, back: tuple[int, int, int] = (0, 0, 0)) -> bytes:
    """The image of a grid (gx, gy, value), gy upwards: values between low and high by their colour; cells outside are not drawn,
    and of one that comes twice the largest value is."""
    if width * height > MOST_PIXELS:
        raise ValueError(f"an image of {width} by {height} is too large")
    inside = cells.where(F.col("gx").between(0, width - 1) & F.col("gy").between(0, height - 1) & F.col("value").isNotNull())
    rows = inside.groupBy("gx", "gy").agg(F.max("value").cast("double").alias("value")).toArrow()  # a row a pixel at most
    out = bytearray(bytes(back) * (width * height))
    for x, y, v in zip(*(rows.column(c).to_pylist() for c in ("gx", "gy", "value"))):
        at = 3 * ((height - 1 - y) * width + x)
        out[at : at + 3] = bytes(colour((v - low) / (high - low) if high > low else 1.0))
    return png(width, height, bytes(out))


def tiles(cells: DataFrame, side: int, colour: Callable[[float], tuple[int, int, int]] = grey, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(tx, ty, png): a grid of any size as square images, each made in a task."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(frame["tx"].iloc[0]), int(frame["ty"].iloc[0])
        out = bytearray(3 * side * side)
        for x, y, v in zip(frame["gx"], frame["gy"], frame["value"]):
            at = 3 * ((side - 1 - (y - ty * side)) * side + (x - tx * side))
            out[at : at + 3] = bytes(colour((v - low) / (high - low) if high > low else 1.0))
        return pd.DataFrame({"tx": [tx], "ty": [ty], "png": [png(side, side, bytes(out))]})

    held = cells.where("value is not null").groupBy("gx", "gy").agg(F.max("value").cast("double").alias("value"))
    dealt = held.select(F.floor(F.col("gx") / side).alias("tx"), F.floor(F.col("gy") / side).alias("ty"), F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "value")
    return dealt.groupBy("tx", "ty").applyInPandas(run, "tx long, ty long, png binary")


def sized(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and the rows of pixels of a file that `png` made."""
    width, height, _, kind = struct.unpack(">IIBB", data[16:26])
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    raw, wide = zlib.decompress(body), width * (4 if kind == 6 else 3)
    return width, height, b"".join(raw[k * (wide + 1) + 1 : (k + 1) * (wide + 1)] for k in range(height))


def outline_cells(points: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cells of a closed line through cells, for drawing."""
    out = []
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        out += [(round(x0 + (x1 - x0) * k / n), round(y0 + (y1 - y0) * k / n)) for k in range(n)]
    return out
