"""Thinning and distance fields of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.operators import grid
from vellumist.runtime import materialize

#: with_eight's neighbors in the order of a walk around the pixel, from straight above, clockwise.
AROUND = (1, 2, 4, 7, 6, 5, 3, 0)


def _ring(mask: DataFrame) -> tuple[DataFrame, list[Column]]:
    df = grid.with_eight(grid.by_image(mask), "m")
    return df, [F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in AROUND]


def thin_pass(mask: DataFrame, second: bool) -> DataFrame:
    """One synchronous sub-pass of Zhang and Suen; outside pixels are ground."""
    df, p = _ring(mask)
    total = p[0]
    for x in p[1:]:
        total = total + x
    turns = sum(((F.col("m") * 0 + F.when((a == 0) & (b == 1), 1).otherwise(0)) for a, b in zip(p, p[1:] + p[:1])), F.lit(0))
    up, right, down, left = p[0], p[2], p[4], p[6]
    free = (up * right * left == 0) & (up * down * left == 0) if second else (up * right * down == 0) & (right * down * left == 0)
    gone = (F.col("m") == 1) & (total >= 2) & (total <= 6) & (turns == 1) & free
    return df.select("image_id", "x", "y", F.when(gone, 0).otherwise(F.col("m")).alias("m"))


def thin(mask: DataFrame) -> DataFrame:
    """Zhang-Suen thinning until nothing changes."""
    df = materialize(mask.select("image_id", "x", "y", "m"), "thin")
    left = df.agg(F.sum("m")).first()[0]
    while True:
        df = materialize(thin_pass(thin_pass(df, False), True), "thin")
        now = df.agg(F.sum("m")).first()[0]
        if now == left:
            return df
        left = now


def degree(mask: DataFrame) -> DataFrame:
    """image_id, x, y, degree: ink neighbors of ink pixels among eight."""
    df, p = _ring(mask)
    total = p[0]
    for x in p[1:]:
        total = total + x
    return df.filter("m = 1").select("image_id", "x", "y", total.cast("int").alias("degree"))


def chamfer(mask: DataFrame, straight: int = 3, diagonal: int = 4) -> DataFrame:
    """image_id, x, y, d: chamfer distance (3-4) of ink to ground, in pixels; the outside is no ground. Relaxed over whole rows and columns by windows until
    nothing moves; null where an image has no ground."""
    big = 1 << 28
    df = materialize(mask.select("image_id", "x", "y", F.when(F.col("m") == 0, 0).otherwise(big).alias("d")), "chamfer")
    while True:
        new = grid.by_image(df)
        new = new.withColumn("old", F.col("d"))
        for axis, order in ((grid.ROW, "x"), (grid.COL, "y")):
            # A straight run costs 3 a step: a running minimum of d - 3 * position, both ways.
            w = Window.partitionBy(*axis).orderBy(order)
            before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
            new = new.withColumn("d", F.least(F.min(F.col("d") - straight * F.col(order)).over(before) + straight * F.col(order), F.min(F.col("d") + straight * F.col(order)).over(after) - straight * F.col(order)))
        near = grid.with_eight(new, "d")
        new = near.select("image_id", "x", "y", F.least("d", *[F.col(f"n{i}") + diagonal for i in (0, 2, 5, 7)]).cast("int").alias("d"), "old")
        new = materialize(new, "chamfer")
        df = new.drop("old")
        if not new.filter("d != old").limit(1).count():
            return df.select("image_id", "x", "y", F.when(F.col("d") < big // 2, F.col("d") / straight).alias("d"))
