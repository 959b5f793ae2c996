"""Whole ways from pixels to SVG, as chains of lazy stages with results kept where the next stage reads them more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumist.operators import curves, layers, palette, raster, regions, skeleton, svg
from vellumist.runtime import materialize


def ring_paths(rings: DataFrame, extra: tuple = ()) -> DataFrame:
    """Rings of one shape as one path: d of all rings of (image_id, *extra), outer and inner, by even-odd filling."""
    flat = F.transform("points", lambda v, i: F.concat(F.when(i == 0, "M").when(i % 2 == 0, "L").otherwise(" "), svg.number(v)))
    one = F.struct("ring", F.concat(F.array_join(flat, ""), F.lit("Z")).alias("t"))
    whole = rings.groupBy("image_id", *extra).agg(F.array_sort(F.collect_list(one)).alias("s"))
    return whole.select("image_id", *extra, F.array_join(F.transform("s", lambda s: s["t"]), "").alias("d"))


def ink(gray: DataFrame, width: int, height: int, min_area: int = 2) -> DataFrame:
    """Black and white: Otsu, despeckle, outlines, one path an image."""
    mask = materialize(regions.despeckle(materialize(raster.otsu_binarize(gray), "ink-mask"), min_area), "ink-clean")
    paths = ring_paths(curves.rings(layers.crack_edges(mask)))
    return svg.document(paths.select("image_id", F.lit(0).alias("place"), "d", F.lit("#000000").alias("fill")), width, height)


def centerline(gray: DataFrame) -> DataFrame:
    """Skeleton pixels with their degree and distance to the ground: ends (1), strokes (2), junctions (3 and more)."""
    mask = materialize(raster.otsu_binarize(gray), "line-mask")
    lines = skeleton.degree(skeleton.thin(mask))
    return lines.join(skeleton.chamfer(mask), ["image_id", "x", "y"])


def color_layers(pixels: DataFrame, colors: list[tuple[int, int, int]], width: int, height: int, min_area: int = 2) -> DataFrame:
    """Color, stacked: palette labels, small regions merged, layers that overlap by stacking order, outlines, one path a layer."""
    labels = palette.quantize_fixed(pixels, colors).withColumnRenamed("label", "m")
    labels = materialize(regions.merge_small(labels, min_area), "color-labels")
    order = materialize(layers.stack_order(labels), "color-order")
    stacked = layers.layer_masks(labels, order)
    # Each layer is a mask of its own image: (image, layer) is the key of all that follows.
    deep = stacked.select((F.col("image_id") * 64 + F.col("layer")).alias("image_id"), "x", "y", F.lit(1).alias("m"))
    grid_ = labels.select("image_id", "x", "y").join(order.select("image_id", F.col("place").alias("layer")), "image_id")
    full = grid_.select((F.col("image_id") * 64 + F.col("layer")).alias("image_id"), "x", "y").join(deep, ["image_id", "x", "y"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    paths = ring_paths(curves.rings(layers.crack_edges(full)))
    paint = F.array(*[F.lit("#%02x%02x%02x" % c) for c in colors])
    placed = paths.select(F.expr("image_id div 64").alias("image_id"), F.expr("int(image_id % 64)").alias("place"), "d").join(order, ["image_id", "place"])
    return svg.document(placed.select("image_id", "place", "d", F.get(paint, F.col("label")).alias("fill")), width, height)
