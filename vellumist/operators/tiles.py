"""Tiles of large images, stitching, letterboxes and mattes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(size: Column, tile: int, overlap: int) -> Column:
    """First coordinates of overlapping tiles that all lie inside."""
    step = tile - overlap
    n = F.greatest(F.lit(1), F.ceil((size - overlap) / step).cast("int"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0), F.least(i * step, size - tile)).cast("int")))


def plan(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """image_id, tx, ty, w, h of every tile. images: image_id, width, height."""
    df = images.withColumn("tx", F.explode(starts(F.col("width"), tile, overlap))).withColumn("ty", F.explode(starts(F.col("height"), tile, overlap)))
    return df.select("image_id", "tx", "ty", F.least(F.lit(tile), F.col("width")).alias("w"), F.least(F.lit(tile), F.col("height")).alias("h"))


def cut(pixels: DataFrame, plan_: DataFrame, value: str = "g", side: int = 64) -> DataFrame:
    """Pixels of each tile, with the square (bx, by) that holds each.

    Tiles go to the squares they touch, and pixels meet the tiles of their own square; side, best about that of a tile, changes only the work.
    Spark takes the exploded plan for as small as its images are and would send it to the driver to broadcast it, so the join is a merge.
    """

    def square(at: Column) -> Column:
        return F.floor(at / side)

    tiles = plan_.withColumn("bx", F.explode(F.sequence(square(F.col("tx")), square(F.col("tx") + F.col("w") - 1)))).withColumn("by", F.explode(F.sequence(square(F.col("ty")), square(F.col("ty") + F.col("h") - 1))))
    cells = pixels.select("image_id", "x", "y", value, square(F.col("x")).alias("bx"), square(F.col("y")).alias("by"))
    met = cells.join(tiles.hint("merge"), ["image_id", "bx", "by"])
    return met.filter((F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + F.col("w")) & (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + F.col("h")))


def stitch(tiles: DataFrame, value: str = "g") -> DataFrame:
    """image_id, x, y, v: mean of overlapping tiles under triangular weights. Where tiles bring their squares, rows stay as cut() dealt them."""

    def weight(at: Column, first: Column, size: Column) -> Column:
        return F.least(at - first + 1, first + size - at)

    w = weight(F.col("x"), F.col("tx"), F.col("w")) * weight(F.col("y"), F.col("ty"), F.col("h"))
    squares = [c for c in ("bx", "by") if c in tiles.columns]
    mean = (F.sum(F.col("wt") * F.col(value)) / F.sum("wt")).alias("v")
    return tiles.withColumn("wt", w).groupBy("image_id", *squares, "x", "y").agg(mean).select("image_id", "x", "y", "v")


def letterbox(images: DataFrame, to: int) -> DataFrame:
    """image_id, w, h, left, top: size and place of an image fitted into a square."""
    scale = F.least(to / F.col("width"), to / F.col("height"))
    w, h = (F.greatest(F.lit(1), F.floor(F.col(c) * scale + 0.5)).cast("int") for c in ("width", "height"))
    df = images.select("image_id", w.alias("w"), h.alias("h"))
    return df.select("*", F.expr(f"int(({to} - w) div 2)").alias("left"), F.expr(f"int(({to} - h) div 2)").alias("top"))


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def matte(gray: DataFrame, low: float = 64.0, high: float = 192.0) -> DataFrame:
    """image_id, x, y, a: alpha byte from a soft threshold of the value."""
    return gray.select("image_id", "x", "y", F.floor(smoothstep(F.col("g"), low, high) * 255 + 0.5).cast("int").alias("a"))
