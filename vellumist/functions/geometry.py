"""Measures of points, segments and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq")


def line_length(points: DataFrame, key: str = "line_id") -> DataFrame:
    """key, length, n of open polylines (key, seq, px, py)."""
    w = in_order(key)
    step = F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w))
    return points.select(key, step.alias("step")).groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n"))


def ring_area(points: DataFrame, key: str = "line_id") -> DataFrame:
    """key, area: signed shoelace area of closed rings; the last point meets the first."""
    w, whole = in_order(key), Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("px", "py"))
    return points.select(key, (F.col("px") * ny - nx * F.col("py")).alias("cross")).groupBy(key).agg((F.sum("cross") / 2).alias("area"))


def corner_angle(points: DataFrame, key: str = "line_id") -> DataFrame:
    """key, seq, angle: the angle at every inner point, in degrees; 180 where a neighbor coincides with the point."""
    w = in_order(key)
    ax, ay = F.lag("px").over(w) - F.col("px"), F.lag("py").over(w) - F.col("py")
    bx, by = F.lead("px").over(w) - F.col("px"), F.lead("py").over(w) - F.col("py")
    flat = ((ax == 0) & (ay == 0)) | ((bx == 0) & (by == 0))
    angle = F.when(flat, 180.0).otherwise(F.degrees(F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))))
    return points.select(key, "seq", F.when(ax.isNotNull() & bx.isNotNull(), angle).alias("angle")).filter("angle is not null")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to the segment a-b."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def chord_distance(points: DataFrame, key: str = "line_id") -> DataFrame:
    """key, seq, d: distance of every point to the chord from the first to the last point of its line."""
    whole = in_order(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [f(c).over(whole) for f in (F.first, F.last) for c in ("px", "py")]
    return points.select(key, "seq", segment_distance(F.col("px"), F.col("py"), *ends).alias("d"))


def prefix_moments(points: DataFrame, key: str = "line_id") -> DataFrame:
    """Running sums of x, y, xx, xy, yy along a line."""
    w = in_order(key).rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.col("px"), F.col("py")
    return points.select(key, "seq", *[F.sum(v).over(w).alias(n) for n, v in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y))])


def kasa_circle(points: DataFrame, key: str = "line_id") -> DataFrame:
    """key, cx, cy, r: algebraic least-squares circle; null for degenerate points."""
    x, y = F.col("px"), F.col("py")
    z = x * x + y * y
    m = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"),
        F.covar_pop(x, x).alias("cxx"), F.covar_pop(x, y).alias("cxy"), F.covar_pop(y, y).alias("cyy"), F.covar_pop(x, z).alias("cxz"), F.covar_pop(y, z).alias("cyz"),
    )
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    cx = (F.col("cxz") * F.col("cyy") - F.col("cyz") * F.col("cxy")) / (2 * det)
    cy = (F.col("cyz") * F.col("cxx") - F.col("cxz") * F.col("cxy")) / (2 * det)
    m = m.filter((F.col("n") >= 3) & (F.abs(det) > 1e-9)).withColumn("cx", cx).withColumn("cy", cy)
    r = F.sqrt(F.greatest(F.lit(0.0), F.col("mz") - 2 * F.col("cx") * F.col("mx") - 2 * F.col("cy") * F.col("my") + F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")))
    return m.select(key, "cx", "cy", r.alias("r"))
