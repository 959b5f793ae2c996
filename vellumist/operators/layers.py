"""Stacking of labels into layers, outlines of layers and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumist.operators import grid, regions


def stack_order(labels: DataFrame, label: str = "m", contender: float = 0.8, contenders: int = 3) -> DataFrame:
    """image_id, label, place, n, perimeter: the base is the most frequent of at most three labels whose perimeter is within 0.8 of the largest; the rest follow by count, ties to the smaller label."""
    counts = labels.filter(F.col(label) >= 0).groupBy("image_id", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(regions.perimeter(labels, label), ["image_id", "label"])
    w = Window.partitionBy("image_id")
    ranked = both.withColumn("near", F.col("perimeter") >= contender * F.max("perimeter").over(w)).withColumn("pr", F.row_number().over(w.orderBy(F.desc("perimeter"), "label")))
    base = (F.col("near") & (F.col("pr") <= contenders)).cast("int")
    first = F.row_number().over(w.orderBy(F.desc(base), F.desc("n"), "label")) == 1
    return ranked.withColumn("base", first.cast("int")).select("image_id", "label", (F.row_number().over(w.orderBy(F.desc("base"), F.desc("n"), "label")) - 1).alias("place"), "n", "perimeter")


def layer_masks(labels: DataFrame, order: DataFrame, label: str = "m") -> DataFrame:
    """image_id, x, y, layer: a pixel lies in every layer up to its label's place, so upper layers overlap lower ones without gaps."""
    placed = labels.join(order.select("image_id", F.col("label").alias(label), "place"), ["image_id", label])
    return placed.select("image_id", "x", "y", F.explode(F.sequence(F.lit(0), F.col("place"))).alias("layer"))


def crack_edges(mask: DataFrame, value: str = "m") -> DataFrame:
    """image_id, ax, ay, bx, by: unit steps along the lattice between ink and ground, ink on the right hand."""
    df = grid.by_image(mask)
    parts = []
    # Of each side: neighbor offset, and the step that keeps ink on its right (y points down).
    for dx, dy, (ax, ay, bx, by) in ((0, -1, (0, 0, 1, 0)), (1, 0, (1, 0, 1, 1)), (0, 1, (1, 1, 0, 1)), (-1, 0, (0, 1, 0, 0))):
        side = df.select("image_id", "x", "y", F.col(value).alias("v"), grid.shifted(value, dx, dy).alias("o")).filter("v = 1 and coalesce(o, 0) != 1")
        parts.append(side.select("image_id", (F.col("x") + ax).alias("ax"), (F.col("y") + ay).alias("ay"), (F.col("x") + bx).alias("bx"), (F.col("y") + by).alias("by")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def outline_area(mask: DataFrame) -> DataFrame:
    """image_id, area, length: signed area inside all outlines (Green's theorem over crack edges) and their length."""
    e = crack_edges(mask)
    return e.groupBy("image_id").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"), F.count(F.lit(1)).alias("length"))


def node_degree(labels: DataFrame, label: str = "m") -> DataFrame:
    """image_id, nx, ny, degree: lattice points where three or four label borders meet (the outside is a label of its own)."""
    df = grid.by_image(labels)
    size = Window.partitionBy("image_id")
    # Border segments between horizontal and vertical neighbors, the outside included on the left and top by the pixel, right and bottom by the last one.
    marked = df.withColumns({"l": grid.shifted(label, dx=-1), "r": grid.shifted(label, dx=1), "u": grid.shifted(label, dy=-1), "d": grid.shifted(label, dy=1), "mx": F.max("x").over(size), "my": F.max("y").over(size)})
    own = F.col(label)
    ends = []
    for cond, (ax, ay), (bx, by) in (
        (~F.col("l").eqNullSafe(own), (0, 0), (0, 1)),
        (~F.col("u").eqNullSafe(own), (0, 0), (1, 0)),
        (F.col("x") == F.col("mx"), (1, 0), (1, 1)),
        (F.col("y") == F.col("my"), (0, 1), (1, 1)),
    ):
        seg = marked.filter(cond)
        ends += [seg.select("image_id", (F.col("x") + px).alias("nx"), (F.col("y") + py).alias("ny")) for px, py in ((ax, ay), (bx, by))]
    every = ends[0]
    for p in ends[1:]:
        every = every.unionByName(p)
    return every.groupBy("image_id", "nx", "ny").agg(F.count(F.lit(1)).alias("degree")).filter("degree >= 3")


def nesting(mask: DataFrame) -> DataFrame:
    """image_id, comp, label, depth: how many outlines lie around a region, by the parity of its first pixel's ray to the left across region borders of its image."""
    comps = regions.connected_components(mask)
    w = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.lag("m").over(grid.along_row()).eqNullSafe(F.col("m")), 0).otherwise(1)
    walked = grid.by_image(comps).withColumn("change", change).withColumn("crossed", F.sum("change").over(w))
    first = walked.groupBy("image_id", "comp").agg(F.min_by(F.struct("m", "crossed"), regions.position()).alias("f"))
    return first.select("image_id", "comp", F.col("f.m").alias("label"), F.col("f.crossed").alias("crossings"))


def box_overlaps(boxes: DataFrame, cell: int = 4) -> DataFrame:
    """image_id, a, b: pairs of overlapping boxes (comp, x0, x1, y0, y1), found in the grid cells that both touch; each pair once, in the first common cell."""
    dealt = boxes.withColumn("cx", F.explode(F.sequence(F.expr(f"int(x0 div {cell})"), F.expr(f"int(x1 div {cell})")))).withColumn("cy", F.explode(F.sequence(F.expr(f"int(y0 div {cell})"), F.expr(f"int(y1 div {cell})"))))
    cols = ["comp", "x0", "x1", "y0", "y1"]
    a, b = (dealt.select("image_id", "cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in "ab")
    met = a.join(b, ["image_id", "cx", "cy"]).filter("a_comp < b_comp and a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    once = (F.col("cx") == F.expr(f"int(greatest(a_x0, b_x0) div {cell})")) & (F.col("cy") == F.expr(f"int(greatest(a_y0, b_y0) div {cell})"))
    return met.filter(once).select("image_id", F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))


def points_inside(points: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, px, py, inside: even-odd test of points against crack edges; only vertical edges of the point's own row can cross its ray, an equi-join."""
    v = edges.filter("ax = bx").select("image_id", F.col("ax").alias("ex"), F.least("ay", "by").alias("row"))
    p = points.withColumn("row", F.floor("py").cast("int"))
    hit = p.join(v, ["image_id", "row"], "left").groupBy("image_id", "px", "py").agg(F.sum(F.when(F.col("ex") > F.col("px"), 1).otherwise(0)).alias("c"))
    return hit.select("image_id", "px", "py", (F.col("c") % 2).cast("int").alias("inside"))
