"""Grey-scale segmentation on (y, x, v) pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def in_range(v: Column, low: int, high: int) -> Column:
    return F.when(v.between(low, high), 255).otherwise(0)


def spread(pixels: DataFrame, offsets: list[tuple[int, int]], value: str, largest: bool) -> DataFrame:
    """The largest (dilate) or smallest (erode) value over kernel offsets; outside the picture nothing counts.

    Each pixel is sent to the places it matters for, and combined before the shuffle.
    """
    moved = pixels.select(F.explode(F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col(value).alias("v")) for dy, dx in offsets))).alias("p")).select("p.*")
    kept = moved.groupBy("y", "x").agg((F.max if largest else F.min)("v").alias(value))
    return kept.join(pixels.select("y", "x"), ["y", "x"], "left_semi")


def box(height: int, width: int) -> list[tuple[int, int]]:
    """Offsets of a full kernel around its centre."""
    return [(y - height // 2, x - width // 2) for y in range(height) for x in range(width)]


def kernel(rows: list[str]) -> list[tuple[int, int]]:
    """Offsets, around the centre, of the cells of a drawn kernel that are not 0."""
    return [(y - len(rows) // 2, x - len(row) // 2) for y, row in enumerate(rows) for x, cell in enumerate(row) if cell != "0"]


def spread_times(pixels: DataFrame, offsets: list[tuple[int, int]], value: str, largest: bool, times: int) -> DataFrame:
    """``spread``, one time after the other."""
    for _ in range(times):
        pixels = spread(pixels, offsets, value, largest)
    return pixels


def inverted(mask: Column) -> Column:
    """NOT of an 8-bit mask."""
    return F.lit(255) - mask


def both(left: Column, right: Column) -> Column:
    """AND of two 8-bit masks."""
    return left.bitwiseAND(right)


def spread_box(pixels: DataFrame, height: int, width: int, value: str, largest: bool) -> DataFrame:
    """``spread`` over a full kernel: along rows and then along columns, so a pixel is sent height + width times. Needs a full grid or pixels whose neighbours in a row are there."""
    return spread(spread(pixels, box(1, width), value, largest), box(height, 1), value, largest)


def pixels_of(images: DataFrame) -> DataFrame:
    """path, y, x and v (grey, or blue, green and red as array) of rows of Spark's image source."""
    i = F.col("image")
    n = i["nChannels"]
    whole = images.select(i["origin"].alias("path"), i["width"].alias("w"), n.alias("n"), F.hex(i["data"]).alias("h"), F.explode(F.sequence(F.lit(0), i["height"] - 1)).alias("y"))
    # a row of pixels at a time; two hex digits a byte
    lines = whole.select("path", "y", "n", F.expr("substring(h, cast(y * w * n * 2 + 1 as int), cast(w * n * 2 as int))").alias("line"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    byte = lambda c: F.conv(F.expr(f"substring(line, cast((x * n + {c}) * 2 + 1 as int), 2)"), 16, 10).cast("int")
    return lines.select("path", "y", "x", F.when(F.col("n") == 1, F.array(byte(0))).otherwise(F.array(byte(0), byte(1), byte(2))).alias("v"))


def marked(mask: Column, pixel: Column, colour: tuple[int, int, int] = (0, 255, 0)) -> Column:
    """The pixel, or the colour where the mask is 255."""
    return F.when(mask == 255, F.array(*map(F.lit, colour))).otherwise(pixel)
