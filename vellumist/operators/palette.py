"""Color quantization and palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.functions import color
from vellumist.operators import grid

#: Palettes are at most this long, which bounds every palette literal and join.
MOST_COLORS = 64


def _palette(colors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not 0 < len(colors) <= MOST_COLORS:
        raise ValueError(f"a palette has 1 to {MOST_COLORS} colors")
    return colors


def _oklab_of(rgb: tuple[int, int, int]) -> tuple[float, ...]:
    """Oklab of a constant color."""
    light = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    cones = [sum(k * v for k, v in zip(row, light)) ** (1 / 3) for row in color.LMS]
    return tuple(sum(k * v for k, v in zip(row, cones)) for row in color.OKLAB)


def with_nearest(colors_df: DataFrame, colors: list[tuple[int, int, int]], out: str = "label") -> DataFrame:
    """colors_df (r, g, b, ...) with the index of the palette color nearest in Oklab, ties to the lower index; distances are compared at 9 places.

    Oklab values are computed once a row; a higher-order function goes over the constant palette, so generated code does not grow with it.
    """
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(_oklab_of(c), ("pl", "pa", "pb"))], F.lit(i).alias("i")) for i, c in enumerate(_palette(colors))])
    lab = F.struct(*[v.alias(n) for v, n in zip(color.oklab(F.col("r"), F.col("g"), F.col("b")), ("l", "a", "b"))])

    def far(p: Column) -> Column:
        d = [p[x] - F.col("__lab")[y] for x, y in (("pl", "l"), ("pa", "a"), ("pb", "b"))]
        return F.struct(F.round(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], 9).alias("d"), p["i"].alias("i"))

    return colors_df.withColumn("__lab", lab).withColumn(out, F.array_min(F.transform(rows, far))["i"]).drop("__lab")


def quantize_fixed(pixels: DataFrame, colors: list[tuple[int, int, int]]) -> DataFrame:
    """image_id, x, y, label. Distinct colors are labeled once and joined back."""
    known = with_nearest(pixels.select("r", "g", "b").distinct(), colors)
    return pixels.join(known, ["r", "g", "b"]).select("image_id", "x", "y", "label")


def quantize_exact(pixels: DataFrame) -> DataFrame:
    """image_id, label, r, g, b, n: the exact palette of each image, by descending count, ties by color."""
    counted = pixels.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")
    return counted.select("image_id", (F.row_number().over(order) - 1).alias("label"), "r", "g", "b", "n")


def lloyd_round(pixels: DataFrame, colors: list[tuple[int, int, int]]) -> DataFrame:
    """label, r, g, b, n: one k-means round over all pixels: the mean color of what is nearest to each center."""
    counted = pixels.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    labeled = with_nearest(counted, colors)
    return labeled.groupBy("label").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"], F.sum("n").alias("n"))


def kmeans(pixels: DataFrame, colors: list[tuple[int, int, int]], rounds: int = 8) -> list[tuple[int, int, int]]:
    """Centers after so many rounds, or when none moves; empty clusters keep their place. Only the centers, MOST_COLORS at most, reach the driver."""
    counted = pixels.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        for _ in range(rounds):
            labeled = with_nearest(counted, colors)
            means = labeled.groupBy("label").agg(*[F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n") + 0.5).cast("int").alias(c) for c in "rgb"]).collect()
            new = list(colors)
            for m in means:
                new[m["label"]] = (m["r"], m["g"], m["b"])
            if new == colors:
                break
            colors = new
    finally:
        counted.unpersist()
    return colors


def interior_palette(pixels: DataFrame, label: str = "label", least: int = 16) -> DataFrame:
    """image_id, label, r, g, b, inner: lower median of each channel over interior pixels (all four neighbors alike), over all of a label with too few."""
    alike = None
    for n in grid.four(label):
        same = F.coalesce(n == F.col(label), F.lit(False))
        alike = same if alike is None else alike & same
    marked = grid.by_image(pixels).withColumn("inside", alike)
    count = F.sum(F.col("inside").cast("long")).over(Window.partitionBy("image_id", label))
    used = marked.withColumn("inner", count).filter((F.col("inner") < least) | F.col("inside"))
    return used.groupBy("image_id", F.col(label).alias("label")).agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast("int").alias(c) for c in "rgb"], F.min("inner").alias("inner"))


def dominant_tones(gray: DataFrame, k: int = 6, bars: int = 16) -> DataFrame:
    """image_id, rank, bar, n: the k most filled bars of the histogram, ties to the darker."""
    h = gray.groupBy("image_id", F.expr(f"int(g * {bars} div 256)").alias("bar")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "bar")
    return h.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("image_id", "rank", "bar", "n")


def mixture_candidates(palette: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """image_id, label, a, b: colors within tolerance of the line between two more frequent ones. palette: image_id, label, r, g, b, n; at most MOST_COLORS an image, else ValueError."""
    if palette.filter(F.col("label") >= MOST_COLORS).limit(1).count():
        raise ValueError(f"a palette has 1 to {MOST_COLORS} colors")
    p = palette
    cols = ["label", "r", "g", "b", "n"]
    m, a, b = (p.select("image_id", *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in "mab")
    tri = m.join(a, "image_id").filter("a_n > m_n").join(b, "image_id").filter("b_n > m_n and a_label < b_label")
    ab = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "rgb"]
    am = [F.col(f"m_{c}") - F.col(f"a_{c}") for c in "rgb"]
    dot, square = sum((x * y for x, y in zip(ab[1:], am[1:])), ab[0] * am[0]), sum((x * x for x in ab[1:]), ab[0] * ab[0])
    t = dot / square
    off = F.sqrt(sum(((y - t * x) * (y - t * x) for x, y in zip(ab[1:], am[1:])), (am[0] - t * ab[0]) * (am[0] - t * ab[0])))
    return tri.filter((square > 0) & (t > 0) & (t < 1) & (F.round(off, 6) <= tolerance)).select("image_id", F.col("m_label").alias("label"), F.col("a_label").alias("a"), F.col("b_label").alias("b"))
