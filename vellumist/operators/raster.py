"""Point and window operators on gray and color rasters."""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.functions import color
from vellumist.operators import grid

# Fixed value: the integral that makes the second difference an estimate of noise.
NOISE_QUANTILE, NOISE_SCALE = 0.1, 0.12566


def gray_lightness(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, v: Oklab lightness of color pixels."""
    return pixels.select("image_id", "x", "y", color.oklab(F.col("r"), F.col("g"), F.col("b"))[0].alias("v"))


def luma(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, v: Rec. 709 luma of the encoded bytes, in [0, 1]."""
    return pixels.select("image_id", "x", "y", ((0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")) / 255.0).alias("v"))


def flatten_alpha(pixels: DataFrame, alpha: Column, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Pixels composited over an opaque background, rounded half up."""
    a = alpha / 255.0
    return pixels.select("image_id", "x", "y", *[F.floor(F.col(c) * a + bg * (1 - a) + 0.5).cast("int").alias(c) for c, bg in zip("rgb", background)])


def border_dominant_color(pixels: DataFrame) -> DataFrame:
    """image_id, r, g, b, n: the commonest color on the border; ties to the smallest color."""
    size = Window.partitionBy("image_id")
    edge = pixels.withColumns({"mx": F.max("x").over(size), "my": F.max("y").over(size)}).filter("x = 0 or y = 0 or x = mx or y = my")
    counted = edge.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("image_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "r", "g", "b", "n")).alias("s")).select("image_id", "s.r", "s.g", "s.b", "s.n")


def otsu_bins(gray: DataFrame, value: str = "g") -> DataFrame:
    """image_id, bin: the byte that separates two classes best; 256-bin histograms, running sums, lowest and highest tied bin averaged."""
    histogram = gray.groupBy("image_id", F.col(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run, whole = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("image_id")
    mass = F.col("n") * F.col("bin")
    h = histogram.select("image_id", "bin", F.sum("n").over(run).alias("wb"), F.sum(mass).over(run).alias("sb"), F.sum("n").over(whole).alias("w"), F.sum(mass).over(whole).alias("s"))
    wf = F.col("w") - F.col("wb")
    # The squared difference of class means times both weights, as one exact fraction of integers.
    d = F.col("s") * F.col("wb") - F.col("w") * F.col("sb")
    between = h.filter(wf > 0).select("image_id", "bin", (d.cast("double") * d / (F.col("wb") * wf)).alias("score"))
    best = between.groupBy("image_id").agg(F.max("score").alias("top"))
    tied = between.join(best, "image_id").filter("score = top").groupBy("image_id").agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    return histogram.select("image_id").distinct().join(tied, "image_id", "left").select("image_id", F.coalesce((F.col("low") + F.col("high")) / 2, F.lit(127.0)).alias("bin"))


def binarize(gray: DataFrame, threshold: Column, invert: bool = False, value: str = "g") -> DataFrame:
    """image_id, x, y, m: 1 where the value is below the threshold (or not, if inverted)."""
    return gray.select("image_id", "x", "y", ((F.col(value) < threshold) != F.lit(invert)).cast("int").alias("m"))


def otsu_binarize(gray: DataFrame) -> DataFrame:
    return binarize(gray.join(otsu_bins(gray), "image_id"), F.col("bin") + 1)


def adaptive_binarize(gray: DataFrame, radius: int = 2, bias: float = 4.0) -> DataFrame:
    """Ink where a byte is below its window's mean less the bias; windows are cut at the image. Box sums run over rows, then columns."""
    row, column = grid.box("g", radius)
    sums = grid.by_image(gray).withColumns({"s": row(F.col("g")), "c": row(F.lit(1))}).withColumns({"s": column(F.col("s")), "c": column(F.col("c"))})
    return sums.select("image_id", "x", "y", (F.col("g") < F.col("s") / F.col("c") - bias).cast("int").alias("m"))


def signed_field(gray: DataFrame, threshold: float = 0.5, invert: bool = False) -> DataFrame:
    """image_id, x, y, f: distance of a value to the threshold, scaled so that both ends are half a unit away."""
    d = F.lit(threshold) - F.col("g") / 255.0
    f = F.when(d > 0, d * (0.5 / threshold)).otherwise(d * (0.5 / (1 - threshold)))
    return gray.select("image_id", "x", "y", (-f if invert else f).alias("f"))


def edge_mask(pixels: DataFrame, threshold: int = 40) -> DataFrame:
    """image_id, x, y, e: 1 where a 4-neighbor differs by the threshold or more in L1 of RGB."""
    df = grid.by_image(pixels)
    far = None
    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        gap = sum((F.abs(F.col(c) - grid.shifted(c, dx, dy)) for c in "gb"), F.abs(F.col("r") - grid.shifted("r", dx, dy)))
        hit = F.coalesce(gap >= threshold, F.lit(False))
        far = hit if far is None else far | hit
    return df.select("image_id", "x", "y", far.cast("int").alias("e"))


def gaussian_blur(gray: DataFrame, radius: int = 2) -> DataFrame:
    """image_id, x, y, v: separable Gaussian, sigma radius / 2, half width ceil(3 sigma), edges repeated."""
    if radius == 0:
        return gray.select("image_id", "x", "y", F.col("g").cast("double").alias("v"))
    half = ceil(1.5 * radius)
    weights = [exp(-2.0 * k * k / (radius * radius)) for k in range(-half, half + 1)]
    weights = [w / sum(weights) for w in weights]

    def pass_over(df: DataFrame, axis: tuple, order: str, src: str) -> DataFrame:
        w = Window.partitionBy(*axis).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(src).over(whole), F.last(src).over(whole)
        parts = [F.lit(wt) * (F.col(src) if k == 0 else F.coalesce(F.lag(src, -k).over(w), first) if k < 0 else F.coalesce(F.lead(src, k).over(w), last)) for k, wt in zip(range(-half, half + 1), weights)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return df.withColumn("v", total)

    df = pass_over(grid.by_image(gray).withColumn("s", F.col("g").cast("double")), grid.ROW, "x", "s")
    return pass_over(df.withColumn("s", F.col("v")), grid.COL, "y", "s").select("image_id", "x", "y", "v")


def median_filter(gray: DataFrame, radius: int = 1) -> DataFrame:
    """image_id, x, y, g: upper median of the window, cut at the image."""
    rows = grid.along_row().rowsBetween(-radius, radius)
    columns = grid.along_column().rowsBetween(-radius, radius)
    df = grid.by_image(gray).withColumn("a", F.collect_list("g").over(rows)).withColumn("a", F.sort_array(F.flatten(F.collect_list("a").over(columns))))
    return df.select("image_id", "x", "y", F.get("a", F.expr("int(size(a) div 2)")).alias("g"))


def bilateral_filter(gray: DataFrame, radius: int = 1, spatial: float = 2.0, spread: float = 35.0) -> DataFrame:
    """image_id, x, y, g: mean weighted by distance and by difference of value, rounded half up."""
    df = grid.by_image(gray)
    rows, columns = grid.along_row().rowsBetween(-radius, radius), grid.along_column().rowsBetween(-radius, radius)
    df = df.withColumn("near", F.collect_list(F.struct("x", "g")).over(rows)).withColumn("near", F.flatten(F.collect_list(F.transform("near", lambda s: F.struct(s["x"].alias("x"), F.col("y").alias("y"), s["g"].alias("v")))).over(columns)))
    df = df.select("image_id", "x", "y", "g", F.explode("near").alias("s"))
    dx, dy, dg = F.col("s.x") - F.col("x"), F.col("s.y") - F.col("y"), F.col("s.v") - F.col("g")
    w = F.exp(-(dx * dx + dy * dy) / (2 * spatial * spatial)) * F.exp(-(dg * dg) / (2 * spread * spread))
    means = df.withColumn("w", w).groupBy("image_id", "x", "y").agg((F.sum(F.col("w") * F.col("s.v")) / F.sum("w")).alias("m"))
    return means.select("image_id", "x", "y", F.floor(F.round("m", 6) + 0.5).cast("int").alias("g"))


def area_resize(gray: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """image_id, x, y, v: each source cell gives to the destination cells it overlaps, by the overlap; weights normalized."""

    def cover(axis: str, size: int, to: int) -> DataFrame:
        first, last = F.floor(F.col(axis) * to / size), F.ceil((F.col(axis) + 1) * to / size) - 1
        return F.explode(F.sequence(first, last))

    def overlap(axis: str, dest: str, size: int, to: int) -> Column:
        scale = size / to
        return F.least(F.col(axis) + 1.0, (F.col(dest) + 1) * scale) - F.greatest(F.col(axis) + 0.0, F.col(dest) * scale)

    df = gray.withColumn("dx", cover("x", width, to_width)).withColumn("dy", cover("y", height, to_height))
    w = overlap("x", "dx", width, to_width) * overlap("y", "dy", height, to_height)
    df = df.withColumn("w", w).filter("w > 1e-12").groupBy("image_id", F.col("dx").cast("int").alias("x"), F.col("dy").cast("int").alias("y"))
    return df.agg((F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("v"))


def noise(gray: DataFrame) -> DataFrame:
    """image_id, sigma: a low quantile of the Laplacian's magnitude, scaled to the deviation of white noise, in bytes."""
    left, right, up, down = grid.four("g")
    d = F.abs(4 * F.col("g") - left - right - up - down)
    inner = grid.by_image(gray).select("image_id", d.alias("d")).filter("d is not null")
    w = Window.partitionBy("image_id")
    ranked = inner.select("image_id", "d", (F.row_number().over(w.orderBy("d")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("m"))
    picked = ranked.filter(F.col("i") == F.floor(F.col("m") * NOISE_QUANTILE))
    return picked.select("image_id", F.greatest(F.lit(0.5), F.col("d") / NOISE_SCALE / F.sqrt(F.lit(20.0))).alias("sigma"))


def row_runs(mask: DataFrame, value: str = "m") -> DataFrame:
    """image_id, y, x0, x1, m: maximal runs of equal values in each row (gaps and islands)."""
    w = grid.along_row()
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = grid.by_image(mask).withColumn("start", fresh).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(value).alias("m")).select("image_id", "y", "x0", "x1", "m")


def luminance_histogram(gray: DataFrame, bars: int = 16) -> DataFrame:
    """image_id, bar, n."""
    return gray.groupBy("image_id", F.expr(f"int(g * {bars} div 256)").alias("bar")).agg(F.count(F.lit(1)).alias("n"))


def signed_adaptive_field(gray: DataFrame, radius: int = 2, bias: float = 0.05, invert: bool = False) -> DataFrame:
    """image_id, x, y, f: how far a value in [0, 1] lies below its window's mean less the bias, scaled so that both ends are half a unit away; windows are cut at the image."""
    row, column = grid.box("g", max(1, radius))
    sums = grid.by_image(gray).withColumns({"s": row(F.col("g")), "c": row(F.lit(1))}).withColumns({"s": column(F.col("s")), "c": column(F.col("c"))})
    t = F.col("s") / F.col("c") / 255.0 - bias
    d = t - F.col("g") / 255.0
    f = d * F.when(d > 0, 0.5 / F.greatest(t, F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - t, F.lit(1e-6)))
    return sums.select("image_id", "x", "y", (-f if invert else f).alias("f"))


def pad(pixels: DataFrame, margin: int) -> DataFrame:
    """RGBA images with a clear frame of so many pixels about them."""
    box = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    x, y = (F.explode(F.sequence(F.lit(0), F.col(c) + 2 * margin)) for c in ("mx", "my"))
    whole = box.withColumn("x", x).withColumn("y", y).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "mx", "my")
    frame = whole.filter((F.col("x") < margin) | (F.col("y") < margin) | (F.col("x") > F.col("mx") + margin) | (F.col("y") > F.col("my") + margin))
    inner = pixels.select("image_id", (F.col("x") + margin).cast("int").alias("x"), (F.col("y") + margin).cast("int").alias("y"), *"rgba")
    return inner.unionByName(frame.select("image_id", "x", "y", *[F.lit(0).alias(c) for c in "rgba"]))


def _cubic_weights(u: float) -> tuple[float, ...]:
    """Weights of four neighbors for a point at u between the inner two (Catmull and Rom)."""
    return 0.5 * u * (u * (2 - u) - 1), 0.5 * (u * u * (3 * u - 5) + 2), 0.5 * u * (u * (4 - 3 * u) + 1), 0.5 * u * u * (u - 1)


def upscale(pixels: DataFrame, factor: int, channels: tuple[str, ...], bounded: bool = True) -> DataFrame:
    """image_id, x, y and the channels of images enlarged by a whole factor: cubic weights along rows, then columns, edges repeated; bounded keeps each value between its two inner taps."""
    df = grid.by_image(pixels)
    for axis, other, window in (("x", "y", grid.along_row()), ("y", "x", grid.along_column())):
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def tap(c: str, step: int, w=window, every=whole) -> Column:
            if step == 0:
                return F.col(c)
            return F.coalesce(F.lag(c, -step).over(w), F.first(c).over(every)) if step < 0 else F.coalesce(F.lead(c, step).over(w), F.last(c).over(every))

        df = df.withColumns({f"{c}_{i}": tap(c, i - 2) for c in channels for i in range(5)})
        phases = []
        for r in range(factor):
            at = (r + 0.5) / factor - 0.5
            first = int(at // 1)
            values = []
            for c in channels:
                taps = [F.col(f"{c}_{first + 1 + i}") for i in range(4)]
                v = sum((w * t for w, t in zip(_cubic_weights(at - first)[1:], taps[1:])), _cubic_weights(at - first)[0] * taps[0])
                v = F.greatest(F.least(taps[1], taps[2]), F.least(F.greatest(taps[1], taps[2]), v)) if bounded else v
                values.append(v.alias(c))
            phases.append(F.struct((F.col(axis) * factor + r).cast("int").alias(axis), *values))
        df = df.select("image_id", other, F.explode(F.array(*phases)).alias("p")).select("image_id", other, "p.*")
    return df.select("image_id", "x", "y", *channels)
