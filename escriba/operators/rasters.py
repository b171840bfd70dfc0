"""Image operators on DataFrames: rows of rasters, worked on in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import image


#: Rasters that a function of several gets at a time, and the pixels from which on it gets no more.
_TOGETHER, _PIXELS_TOGETHER = 256, 1 << 20


def map_pixels(rasters: DataFrame, f: Callable[[np.ndarray], np.ndarray] | None = None, several: Callable[[list[np.ndarray]], Sequence[np.ndarray]] | None = None) -> DataFrame:
    """img, height, width, pixels (bytes, row by row) with f applied to each raster (of bytes, or arrays of int), or several to some at a time; sizes may change. An unusable raster gives null pixels, never a failed job."""
    each = several or (lambda pages: [f(x) for x in pages])

    def levels_of(p: pa.Scalar) -> np.ndarray:
        if pa.types.is_binary(p.type):
            return np.frombuffer(p.as_py(), np.uint8)
        return p.values.to_numpy(zero_copy_only=False).astype(np.uint8)

    def applied(pages: list[np.ndarray]) -> Sequence[np.ndarray | None]:
        try:
            return each(pages)
        except (ValueError, TypeError, AttributeError, IndexError, ArithmeticError):
            return [None] if len(pages) == 1 else [applied([x])[0] for x in pages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray | None] = [None] * batch.num_rows
            waiting: dict[int, np.ndarray] = {}
            for i, (h, w, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                try:
                    own = levels_of(p)
                    waiting[i] = own.reshape(h, w, *([3] if len(own) == 3 * h * w else []))
                except (ValueError, TypeError, AttributeError):
                    pass
                if waiting and (several is None or i + 1 == batch.num_rows or len(waiting) == _TOGETHER or sum(x.size for x in waiting.values()) >= _PIXELS_TOGETHER):
                    for at, x in zip(waiting, applied(list(waiting.values())), strict=True):
                        out[at] = x
                    waiting = {}
            yield pa.record_batch(
                {
                    "img": batch.column(0),
                    "height": pa.array([None if x is None else x.shape[0] for x in out], pa.int32()),
                    "width": pa.array([None if x is None else x.shape[1] for x in out], pa.int32()),
                    "pixels": pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in out], pa.binary()),
                }
            )

    return rasters.select(F.col("img").cast("long").alias("img"), "height", "width", "pixels").mapInArrow(run, "img long, height int, width int, pixels binary")


def levels(pixels: Column) -> Column:
    """An array of the numbers that bytes are."""
    byte = lambda at: F.conv(F.hex(F.substring(pixels, at, F.lit(1))), 16, 10).cast("int")
    return F.when(F.length(pixels) > 0, F.transform(F.sequence(F.lit(1), F.length(pixels)), byte)).otherwise(F.array().cast("array<int>"))


def as_points(rasters: DataFrame) -> DataFrame:
    """img, height, width, y, x, v: a row for each pixel of one-channel rasters, of bytes or arrays."""
    pixels = levels(F.col("pixels")) if dict(rasters.dtypes)["pixels"] == "binary" else F.col("pixels")
    cells = rasters.select("img", "height", "width", F.posexplode(pixels).alias("pos", "v"))
    return cells.select("img", "height", "width", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).cast("int").alias("x"), F.col("v").cast("int").alias("v"))


def scale_choice(height: Column, width: Column, base: float = 2.5) -> Column:
    if base == 1.0:
        return F.lit(1.0)
    area = height.cast("long") * width
    return F.when(area < 1_000_000, F.lit(base)).when(area > 8_000_000, F.lit(0.7)).otherwise(F.lit(1.2))


def skew(thetas: Column, most: int = 50) -> Column:
    """The median slope, in degrees, of the first lines of an array of angles; 0 without any within 30 degrees."""
    slopes = F.array_sort(F.filter(F.transform(F.slice(thetas, 1, most), lambda t: F.degrees(t) - 90), lambda a: a.between(-30, 30)))
    n = F.size(slopes)
    at = lambda i: F.get(slopes, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).otherwise(F.lit(0.0))


def needs_deskew(angle: Column) -> Column:
    return F.abs(angle) > 1.0


def osd_rotation(report: Column) -> Column:
    """The rotation that an orientation detector's report names; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(report, r"Rotate:\s+(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def needs_rotation(report: Column) -> Column:
    return F.pmod(osd_rotation(report), F.lit(360)) != 0


GRAYSCALE, OTSU, MEAN, GAUSSIAN, MORPHOLOGY = image.grayscale, image.otsu, image.adaptive_mean, image.adaptive_gaussian, image.morphology
