"""Quality of a rendering against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.functions import color
from vellumist.operators import grid


def paired(source: DataFrame, render: DataFrame) -> DataFrame:
    """Pixels of both, r, g, b of the source and r2, g2, b2 of the rendering, by a co-partitioned join."""
    return source.join(render.select("image_id", "x", "y", *[F.col(c).alias(f"{c}2") for c in "rgb"]), ["image_id", "x", "y"])


def delta() -> Column:
    """Oklab distance of a pair."""
    a, b = color.oklab(F.col("r"), F.col("g"), F.col("b")), color.oklab(F.col("r2"), F.col("g2"), F.col("b2"))
    d = [x - y for x, y in zip(a, b)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def mean_error(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("image_id").agg(F.avg(delta()).alias("de"))


def edge_error(pairs: DataFrame, threshold: int = 48, reach: int = 2) -> DataFrame:
    """image_id, de, n: mean error where the source has an edge (a step to the right or down) within reach."""
    df = grid.by_image(pairs)
    gap = None
    for dx, dy in ((1, 0), (0, 1)):
        d = F.coalesce(F.abs(F.col("r") - grid.shifted("r", dx, dy)) + F.abs(F.col("g") - grid.shifted("g", dx, dy)) + F.abs(F.col("b") - grid.shifted("b", dx, dy)) > threshold, F.lit(False))
        gap = d if gap is None else gap | d
    row, column = grid.box("e", reach, F.max)
    band = df.withColumn("e", gap.cast("int")).withColumn("e", row(F.col("e"))).withColumn("e", column(F.col("e"))).filter("e = 1")
    return band.groupBy("image_id").agg(F.avg(delta()).alias("de"), F.count(F.lit(1)).alias("n"))


def p95_error(pairs: DataFrame, bins: int = 1024, top: float = 0.5, share: float = 0.95) -> DataFrame:
    """image_id, bin: first bin of [0, top] at which the share of pixels is reached; a histogram, so images of any size take one shuffle of counts."""
    at = F.least(F.lit(bins - 1), F.floor(F.round(delta() / top * bins, 6))).cast("int")
    h = pairs.select("image_id", at.alias("bin")).groupBy("image_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id")
    run = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return h.withColumn("run", run).withColumn("all", F.sum("n").over(w)).filter(F.col("run") >= share * F.col("all")).groupBy("image_id").agg(F.min("bin").alias("bin"))


def gmsd(source: DataFrame, render: DataFrame, damp: float = 170.0) -> DataFrame:
    """image_id, gmsd: deviation of gradient similarity (Xue and others 2014) after a 2 x 2 mean, Prewitt gradients of a third; edges count as 0.

    Both: image_id, x, y, v (bytes as doubles)."""

    def gradient(df: DataFrame, name: str) -> DataFrame:
        small = df.groupBy("image_id", F.expr("int(x div 2)").alias("x"), F.expr("int(y div 2)").alias("y")).agg(F.avg("v").alias("v"))
        near = grid.with_eight(grid.by_image(small), "v")
        n = [F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(8)]
        gx = (n[0] + n[3] + n[5] - n[2] - n[4] - n[7]) / 3
        gy = (n[0] + n[1] + n[2] - n[5] - n[6] - n[7]) / 3
        return near.select("image_id", "x", "y", F.sqrt(gx * gx + gy * gy).alias(name))

    both = gradient(source, "a").join(gradient(render, "b"), ["image_id", "x", "y"])
    like = (2 * F.col("a") * F.col("b") + damp) / (F.col("a") * F.col("a") + F.col("b") * F.col("b") + damp)
    return both.groupBy("image_id").agg(F.sqrt(F.greatest(F.lit(0.0), F.var_pop(like))).alias("gmsd"))


def boundary_error(labels: DataFrame, other: DataFrame) -> DataFrame:
    """image_id, both, only_a, only_b: border sides that two label maps share or have alone. Both: image_id, x, y, m."""

    def sides(df: DataFrame, name: str) -> DataFrame:
        df = grid.by_image(df)
        right = df.select("image_id", "x", "y", F.lit(0).alias("way"), grid.shifted("m", dx=1).alias("o"), "m")
        down = df.select("image_id", "x", "y", F.lit(1).alias("way"), grid.shifted("m", dy=1).alias("o"), "m")
        return right.unionByName(down).filter("o != m").select("image_id", "x", "y", "way", F.lit(1).alias(name))

    met = sides(labels, "a").join(sides(other, "b"), ["image_id", "x", "y", "way"], "full")
    return met.groupBy("image_id").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))


def analysis(pixels: DataFrame) -> DataFrame:
    """One row an image: pixels, distinct colors, entropy of luma, flat, micro and edge shares of horizontal and vertical steps, mean luma."""
    df = grid.by_image(pixels).withColumn("l", F.floor((F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722) / 10000).cast("int"))
    steps = [F.abs(F.col("r") - grid.shifted("r", dx, dy)) + F.abs(F.col("g") - grid.shifted("g", dx, dy)) + F.abs(F.col("b") - grid.shifted("b", dx, dy)) for dx, dy in ((1, 0), (0, 1))]
    df = df.withColumn("steps", F.filter(F.array(*steps), lambda s: s.isNotNull()))

    def hits(test):
        return F.sum(F.size(F.filter("steps", test))).cast("long")

    wide = df.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.least(F.lit(65536), F.count_distinct("r", "g", "b")).alias("colors"), F.avg("l").alias("mean_luma"),
        F.sum(F.size("steps")).cast("long").alias("sides"), hits(lambda s: s == 0).alias("flat"), hits(lambda s: (s > 3) & (s <= 72)).alias("micro"), hits(lambda s: s > 72).alias("edges"),
    )
    h = df.groupBy("image_id", "l").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image_id")))
    return wide.join(h.groupBy("image_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy")), "image_id")
