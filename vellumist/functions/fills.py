"""Fill models (flat, linear, radial) as column expressions.

A fill is a struct of FILL: kind, geometry, and stops (offset, color) in order, the first at 0 and the last at 1. Colors are sRGB in [0, 1]; interpolation
is in sRGB or in linear light. Doubles throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumist.functions import color

RGB = "struct<r:double,g:double,b:double>"
STOP = f"struct<offset:double,color:{RGB}>"
FILL = f"struct<kind:string,x0:double,y0:double,x1:double,y1:double,r:double,aspect:double,angle:double,linear_light:boolean,stops:array<{STOP}>>"

# Editable numbers of each family, and of a stop between the ends.
FLAT_NUMBERS, LINEAR_NUMBERS, RADIAL_NUMBERS, ELLIPTIC_NUMBERS, STOP_NUMBERS = 3, 10, 9, 11, 4
#: Offsets are found on a grid of so many steps; half a pixel lies between pixel centers and the fitting frame.
OFFSET_STEPS, FRAME_SHIFT = 1000, 0.5
MOST_SAMPLES = 4096


def clamp(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def to_light(v: Column) -> Column:
    """Linear light of an sRGB channel in [0, 1]."""
    return color.linear(v * 255.0)


def to_channel(light: Column) -> Column:
    """sRGB channel of a linear-light value, clamped first."""
    return color.encoded(clamp(light))


def is_gradient(fill: Column) -> Column:
    return fill["kind"] != "flat"


def numbers(fill: Column) -> Column:
    """Description length of a fill in editable numbers."""
    base = F.when(fill["kind"] == "linear", LINEAR_NUMBERS).otherwise(F.when(fill["aspect"] == 1, RADIAL_NUMBERS).otherwise(ELLIPTIC_NUMBERS))
    return F.when(fill["kind"] == "flat", FLAT_NUMBERS).otherwise(base + STOP_NUMBERS * (F.size(fill["stops"]) - 2))


def kind_name(fill: Column) -> Column:
    space = F.when(fill["linear_light"], "lin").otherwise("srgb")
    family = F.when(fill["kind"] == "linear", "linear").otherwise(F.when(fill["aspect"] == 1, "radial").otherwise("ellipse"))
    return F.when(fill["kind"] == "flat", "flat").otherwise(F.concat_ws("/", family, space))


def linear_t(fill: Column, x: Column, y: Column) -> Column:
    """Share of the axis at a point, within [0, 1]; 0 without an axis."""
    dx, dy = fill["x1"] - fill["x0"], fill["y1"] - fill["y0"]
    square = dx * dx + dy * dy
    return F.when(square <= 0, 0.0).otherwise(clamp(((x - fill["x0"]) * dx + (y - fill["y0"]) * dy) / square))


def radial_t(fill: Column, x: Column, y: Column) -> Column:
    """Elliptical radius of a point over the fill's own, within [0, 1]; 0 without a radius."""
    dx, dy = x - fill["x0"], y - fill["y0"]
    c, s = F.cos(fill["angle"]), F.sin(fill["angle"])
    u, v = c * dx + s * dy, (c * dy - s * dx) * fill["aspect"]
    rho = F.when(fill["aspect"] == 1, F.sqrt(dx * dx + dy * dy)).otherwise(F.sqrt(u * u + v * v))
    return F.when(fill["r"] <= 0, 0.0).otherwise(clamp(rho / fill["r"]))


def fill_t(fill: Column, x: Column, y: Column) -> Column:
    return F.when(fill["kind"] == "linear", linear_t(fill, x, y)).when(fill["kind"] == "radial", radial_t(fill, x, y)).otherwise(0.0)


def color_at(fill: Column, t: Column) -> Column:
    """The stop profile's color at t: the two stops about t, mixed in the fill's space. The piece is the first that ends at or after t; one without length gives its start."""
    stops = fill["stops"]
    at = F.aggregate(F.transform(stops, lambda s, i: F.when((i > 0) & (s["offset"] >= t), i)), F.lit(None).cast("int"), lambda acc, i: F.coalesce(acc, i))
    hi = F.coalesce(at, F.size(stops) - 1)
    a, b = F.get(stops, hi - 1), F.get(stops, hi)
    length = b["offset"] - a["offset"]
    u = F.when(length > 0, (t - a["offset"]) / length).otherwise(F.when(a["offset"] >= 1, 1.0).otherwise(0.0))

    def mixed(c: str) -> Column:
        p, q = a["color"][c], b["color"][c]
        light = to_channel(to_light(p) + (to_light(q) - to_light(p)) * u)
        return F.when(fill["linear_light"], light).otherwise(p + (q - p) * u)

    first = F.get(stops, 0)["color"]
    return F.struct(*[F.when(fill["kind"] == "flat", first[c]).otherwise(mixed(c)).alias(c) for c in "rgb"])


def representative(fill: Column) -> Column:
    """One color for the whole fill: the middle of its end stops."""
    a, b = F.get(fill["stops"], 0)["color"], F.element_at(fill["stops"], -1)["color"]
    return F.struct(*[((a[c] + b[c]) / 2).alias(c) for c in "rgb"])


def with_stops(fill: Column, stops: Column) -> Column:
    """The same geometry with other stops; a flat fill as it is."""
    return F.when(is_gradient(fill), fill.withField("stops", stops)).otherwise(fill)


def shifted(fill: Column, by: float) -> Column:
    moved = fill
    for c in ("x0", "y0", "x1", "y1"):
        moved = moved.withField(c, fill[c] + by)
    return F.when(is_gradient(fill), moved).otherwise(fill)


def to_pixel_frame(fill: Column) -> Column:
    return shifted(fill, FRAME_SHIFT)


def to_fitting_frame(fill: Column) -> Column:
    return shifted(fill, -FRAME_SHIFT)


def separation(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "rgb"), F.lit(0.0)))


def unmix_pair(a: Column, b: Column, x: Column, y: Column) -> Column:
    """struct(a, b, separation): what two fills are told apart by at a point, their colors there or one color of each, whichever are further apart."""
    here = (color_at(a, fill_t(a, x, y)), color_at(b, fill_t(b, x, y)))
    whole = (representative(a), representative(b))
    near, far = separation(*here), separation(*whole)
    local = (~is_gradient(a) & ~is_gradient(b)) | (near >= far)
    pick = [F.when(local, h).otherwise(w) for h, w in zip(here, whole)]
    return F.struct(pick[0].alias("a"), pick[1].alias("b"), F.when(local, near).otherwise(far).alias("separation"))


def bin_of(t: Column) -> Column:
    """Offset bin of a gradient coordinate."""
    return F.when(t > 0, F.least(F.floor(t * OFFSET_STEPS), F.lit(OFFSET_STEPS))).otherwise(0).cast("int")


def bin_offset(j: Column) -> Column:
    return F.least(j, F.lit(OFFSET_STEPS)) / float(OFFSET_STEPS)


def bic_price(n: Column, scale: float = 1.0) -> Column:
    """Price of a number for a region of n pixels, drawn at a scale."""
    area = scale * scale
    return area * 0.5 * F.ln(F.greatest(n / area, F.lit(2.0)))


def fit_stride(n: Column) -> Column:
    return F.greatest(F.floor(n / MOST_SAMPLES), F.lit(1)).cast("int")


def flat_cost(price: Column) -> Column:
    return price * FLAT_NUMBERS
