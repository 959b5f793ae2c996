"""Roots, random numbers, moments and edge positions as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.functions import color
from vellumist.functions.geometry import in_order

# Fixed values.
BUDGET_SIDE, DPI, MM_PER_INCH = 4096, 96.0, 25.4
SIGMA_MODEL, LEAST_SIGMA, MOST_SIGMA = 0.05, 1e-3, 4.0
G1_BREAK_DEGREES = 10.0


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def copy_sign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def poly(coefficients: list[Column], x: Column) -> Column:
    """Value of a polynomial, lowest power first."""
    total = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        total = total * x + c
    return total


def quadratic_roots(c0: Column, c1: Column, c2: Column) -> Column:
    """Real roots of c0 + c1 x + c2 x^2 in rising order, each once; a leading coefficient of 0 leaves a line. Without cancellation."""
    p, q = F.try_divide(c1, c2), F.try_divide(c0, c2)
    gap = p * p - 4 * q
    far = -0.5 * (p + copy_sign(F.sqrt(F.greatest(gap, F.lit(0.0))), p))
    near = F.try_divide(q, far)
    both = F.when(near.isNull(), F.array(far)).otherwise(F.array(F.least(far, near), F.greatest(far, near)))
    none = F.expr("cast(array() as array<double>)")
    square = F.when(gap < 0, none).when(gap == 0, F.array(-0.5 * p)).otherwise(both)
    line = F.when(c1 != 0, F.array(-c0 / F.nullif(c1, F.lit(0.0)))).when(c0 == 0, F.array(F.lit(0.0))).otherwise(none)
    return F.when(c2 == 0, line).otherwise(square)


def _times32(a: Column, b: Column) -> Column:
    """Product of two 32-bit numbers modulo 2**32."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftrightunsigned(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def mulberry32(seed: Column, n: Column) -> Column:
    """The n-th number, from 1, of the published generator for a seed: its state is a counter, so no number needs the one before."""
    word = 0xFFFFFFFF
    a = (seed.cast("long") + _times32(n.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(word)
    t = _times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = ((t + _times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(word)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296.0


def supersample_factor(width: Column, height: Column, most: Column, asked: Column, highest: int = 8) -> Column:
    """The largest factor, at most the asked one, that keeps the fitted image within BUDGET_SIDE squared pixels; at least 1."""
    long = F.greatest(width, height)
    fit = F.when((most > 0) & (long > most), most / long).otherwise(1.0)
    pixels = F.greatest(F.lit(1), F.floor(width * fit + 0.5)) * F.greatest(F.lit(1), F.floor(height * fit + 0.5))
    fits = F.filter(F.sequence(F.lit(1), F.lit(highest)), lambda k: (k <= asked) & ((k == 1) | (pixels * k * k <= BUDGET_SIDE**2)))
    return F.when(asked <= 1, asked).otherwise(F.array_max(fits))


def mm_per_px(width: Column, width_mm: Column) -> Column:
    """Millimeters a pixel; 96 dots an inch where no width is given, 0 without pixels."""
    return F.when(width > 0, F.coalesce(F.when(width_mm > 0, width_mm), width / DPI * MM_PER_INCH) / width).otherwise(0.0)


def encoded_of_lightness(value: Column) -> Column:
    """sRGB value of a gray of so much Oklab lightness."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return color.encoded(v * v * v)


def alpha_field(alpha: Column, threshold: int) -> Column:
    """Signed coverage in [-0.5, 0.5] of an alpha byte about a threshold."""
    t = min(255, max(0, threshold)) / 255
    d = alpha / 255.0 - t
    return d * F.when(d > 0, 0.5 / max(1 - t, 1e-6)).otherwise(0.5 / max(t, 1e-6))


def unmix_coverage(p: list[Column], fg: list[Column], bg: list[Column]) -> Column:
    """Share of fg in a pixel between fg and bg, by projection, within [0, 1]; 0 where they are equal."""
    num, square = (sum(((x - b) * (f - b) for x, f, b in zip(v, fg, bg)), F.lit(0.0)) for v in (p, fg))
    return F.when(square <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / square)))


def position_sigma(sigma: Column, gradient: Column) -> Column:
    """Uncertainty of an edge position in pixels, from the noise of coverage and its slope."""
    noise = F.when(gradient <= 1e-6, MOST_SIGMA).otherwise(F.try_divide(sigma, gradient))
    return F.least(F.greatest(F.hypot(noise, F.lit(SIGMA_MODEL)), F.lit(LEAST_SIGMA)), F.lit(MOST_SIGMA))


def edge_offset(a: Column, na: Column, nb: Column) -> Column:
    """Signed distance of a straight edge from a pixel's center, from the pixel's coverage and the larger and smaller part of the edge's normal."""
    hi = F.when(a >= 0.5, a).otherwise(1 - a)
    straight = hi - 0.5 <= 0.5 * (na - nb) / na
    d = F.when(straight, (hi - 0.5) * na).otherwise(0.5 * (na + nb) - F.sqrt(F.greatest(2 * na * nb * (1 - hi), F.lit(0.0))))
    return F.when(a >= 0.5, d).otherwise(-d)


def round_rect_distance(px: Column, py: Column, cx: Column, cy: Column, hw: Column, hh: Column, r: Column, angle: Column) -> Column:
    """Signed distance of a point to a rotated rectangle with round corners, negative inside."""
    dx, dy, c, s = px - cx, py - cy, F.cos(angle), F.sin(angle)
    qx, qy = F.abs(c * dx + s * dy) - (hw - r), F.abs(c * dy - s * dx) - (hh - r)
    zero = F.lit(0.0)
    return F.hypot(F.greatest(qx, zero), F.greatest(qy, zero)) + F.least(F.greatest(qx, qy), zero) - r


def turn_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two directions, in radians; 0 if one has no length."""
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    short = (F.hypot(ax, ay) < 1e-12) | (F.hypot(bx, by) < 1e-12)
    return F.when(short, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, n)))))


def break_cost(turn: Column, price: float) -> Column:
    """Price of a break in direction: quadratic up to G1_BREAK_DEGREES, then the whole price."""
    share = turn / (G1_BREAK_DEGREES * pi / 180)
    return price * F.least(share * share, F.lit(1.0))


def span_forms(points: DataFrame, size: int = 8, key: str = "line_id") -> DataFrame:
    """Of each run of so many points of a line (key, seq of its last point): chord (root mean square distance to the chord times its length), center and
    direction of the best line, its quadratic form at the run's last point (squared distance), and the scatter's smaller eigenvalue."""
    run = in_order(key).rowsBetween(-(size - 1), 0)
    x, y = F.col("px"), F.col("py")
    sums = {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    df = points.select(key, "seq", "px", "py", F.lag("px", size - 1).over(in_order(key)).alias("ax"), F.lag("py", size - 1).over(in_order(key)).alias("ay"), *[F.sum(v).over(run).alias(n) for n, v in sums.items()])
    df = df.filter(F.col("n") == size)
    n, sx, sy, sxx, sxy, syy, ax, ay = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy", "ax", "ay"))
    mx, my, ex, ey = (ax + x) / 2, (ay + y) / 2, x - ax, y - ay
    a, b, c = (sxx - 2 * sx * mx) / n + mx * mx, (sxy - sx * my - sy * mx) / n + mx * my, (syy - 2 * sy * my) / n + my * my
    chord = F.sqrt(F.greatest(F.lit(0.0), ey * ey * a - 2 * ex * ey * b + ex * ex * c))
    cx, cy = sx / n, sy / n
    vx, vxy, vy = sxx / n - cx * cx, sxy / n - cx * cy, syy / n - cy * cy
    spread = F.sqrt(F.greatest(F.lit(0.0), (vx - vy) * (vx - vy) + 4 * vxy * vxy))
    top = (vx + vy + spread) / 2
    first = F.abs(vx - top) >= F.abs(vy - top)
    dx, dy = F.when(first, -vxy).otherwise(vy - top), F.when(first, vx - top).otherwise(-vxy)
    length = F.hypot(dx, dy)
    dx, dy = F.when(length < 1e-12, 1.0).otherwise(F.try_divide(dx, length)), F.when(length < 1e-12, 0.0).otherwise(F.try_divide(dy, length))
    off = dy * (x - cx) - dx * (y - cy)
    return df.select(key, "seq", chord.alias("chord"), cx.alias("cx"), cy.alias("cy"), F.abs(dx * dy).alias("slant"), (off * off).alias("square"), (n * F.greatest(F.lit(0.0), (vx + vy - spread) / 2)).alias("scatter"))


def circle_error(points: DataFrame, circles: DataFrame, sigma: Column, key: str = "line_id") -> DataFrame:
    """key, chi2, sweep: weighted squared distance of a line's points to its circle, and the angle that the line goes round the circle's center.

    circles: key, cx, cy, r.
    """
    df = points.join(circles, key)
    at = F.atan2(F.col("py") - F.col("cy"), F.col("px") - F.col("cx"))
    d = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")) - F.col("r")
    s = F.greatest(sigma, F.lit(LEAST_SIGMA))
    df = df.select(key, "seq", at.alias("at"), (d * d / (s * s)).alias("part"))
    step = F.col("at") - F.lag("at").over(in_order(key))
    step = F.when(step > pi, step - 2 * pi).when(step < -pi, step + 2 * pi).otherwise(step)
    return df.select(key, "part", step.alias("step")).groupBy(key).agg(F.sum("part").alias("chi2"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("sweep"))
