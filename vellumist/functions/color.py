"""Color conversions as column expressions; all run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published sRGB, Oklab and CIE Lab (D65) constants.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LMS_BACK = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
RGB_BACK = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _rows(matrix, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(F.lit(a) * x + F.lit(b) * y + F.lit(c) * z for a, b, c in matrix)


def linear(byte: Column) -> Column:
    """Linear light of an sRGB byte."""
    c = byte / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def encoded(light: Column) -> Column:
    """sRGB value in [0, 1] of linear light."""
    return F.when(light <= 0.0031308, light * 12.92).otherwise(1.055 * F.pow(F.greatest(light, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def byte(value: Column) -> Column:
    """Value in [0, 1] as a byte, rounded half up and clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value * 255.0 + 0.5))).cast("int")


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _rows(OKLAB, *(F.cbrt(c) for c in _rows(LMS, linear(r), linear(g), linear(b))))


def lightness(gray: Column) -> Column:
    """Oklab L of a gray byte."""
    return oklab(gray, gray, gray)[0]


def light_of_oklab(L: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear light of an Oklab color; not clamped."""
    return _rows(RGB_BACK, *(F.pow(c, F.lit(3.0)) for c in _rows(LMS_BACK, L, a, b)))


def oklab_to_rgb(L: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(byte(encoded(c)) for c in light_of_oklab(L, a, b))


def with_oklab(df: DataFrame, to: str = "LMN") -> DataFrame:
    """df (r, g, b) with the three Oklab columns, L, M (green to red) and N (blue to yellow); linear light and cone responses are columns of their own on the way, so that no expression is repeated."""
    steps = df.withColumns({f"__{c}": linear(F.col(c)) for c in "rgb"})
    steps = steps.withColumns({f"__c{i}": F.cbrt(c) for i, c in enumerate(_rows(LMS, *(F.col(f"__{c}") for c in "rgb")))})
    return steps.withColumns(dict(zip(to, _rows(OKLAB, *(F.col(f"__c{i}") for i in range(3)))))).drop("__r", "__g", "__b", "__c0", "__c1", "__c2")


def with_rgb(df: DataFrame, lab: str = "LMN", to: tuple = ("r", "g", "b")) -> DataFrame:
    """df with bytes of its three Oklab columns, step by step as in with_oklab."""
    light = df.withColumns({f"__{i}": c for i, c in enumerate(light_of_oklab(*(F.col(c) for c in lab)))})
    return light.withColumns({n: byte(encoded(F.col(f"__{i}"))) for i, n in enumerate(to)}).drop("__0", "__1", "__2")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* under D65."""
    f = []
    for v, w in zip(_rows(XYZ, linear(r), linear(g), linear(b)), WHITE):
        t = v / w
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def ciede2000(one: tuple, two: tuple) -> Column:
    """The CIEDE2000 difference of two Lab colors (Sharma, Wu, Dalal 2005)."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    c7 = F.pow((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2, F.lit(7.0))
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    p1, p2 = a1 * (1 + g), a2 * (1 + g)
    k1, k2 = F.hypot(p1, b1), F.hypot(p2, b2)

    def hue(b, a):
        return F.when((a == 0) & (b == 0), 0.0).otherwise((F.degrees(F.atan2(b, a)) + 360) % 360)

    h1, h2 = hue(b1, p1), hue(b2, p2)
    d = h2 - h1
    dh = F.when(k1 * k2 == 0, 0.0).when(F.abs(d) <= 180, d).when(d > 180, d - 360).otherwise(d + 360)
    dH = 2 * F.sqrt(k1 * k2) * F.sin(F.radians(dh / 2))
    ml, mc, s = (l1 + l2) / 2, (k1 + k2) / 2, h1 + h2
    mh = F.when(k1 * k2 == 0, s).when(F.abs(d) <= 180, s / 2).when(s < 360, (s + 360) / 2).otherwise((s - 360) / 2)
    t = 1 - 0.17 * F.cos(F.radians(mh - 30)) + 0.24 * F.cos(F.radians(2 * mh)) + 0.32 * F.cos(F.radians(3 * mh + 6)) - 0.20 * F.cos(F.radians(4 * mh - 63))
    sl = 1 + 0.015 * (ml - 50) * (ml - 50) / F.sqrt(20 + (ml - 50) * (ml - 50))
    m7 = F.pow(mc, F.lit(7.0))
    turn = -F.sin(F.radians(60 * F.exp(-((mh - 275) / 25) * ((mh - 275) / 25)))) * 2 * F.sqrt(m7 / (m7 + 25.0**7))
    x, y, z = (l2 - l1) / sl, (k2 - k1) / (1 + 0.045 * mc), dH / (1 + 0.015 * mc * t)
    return F.sqrt(x * x + y * y + z * z + turn * y * z)


def hex_parse(text: Column) -> Column:
    """struct(r, g, b) of 3 or 6 hex digits with an optional #, else null."""
    digits = F.lower(F.regexp_replace(text, "^#", ""))
    six = F.when(digits.rlike("^[0-9a-f]{3}$"), F.regexp_replace(digits, "(.)", "$1$1")).when(digits.rlike("^[0-9a-f]{6}$"), digits)
    return F.when(six.isNotNull(), F.struct(*[F.conv(F.substring(six, 2 * i + 1, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")]))


def hex_format(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("long")), 2, "0")) for c in (r, g, b)])
