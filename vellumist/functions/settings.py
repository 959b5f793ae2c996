"""Settings documents: reading JSON, clamping, profiles and the tunable parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, type, default, and range (numbers) or allowed values (enums).
NUMBERS = {
    "maxDimension": ("int", 1600, 64, 8192), "supersample": ("int", 1, 1, 4), "blurRadius": ("double", 0.0, 0, 10), "alphaThreshold": ("int", 8, 0, 255),
    "paletteSize": ("int", 16, 2, 64), "quantizeQuality": ("int", 5, 1, 10), "minRegionArea": ("int", 6, 0, 4096), "dissolveBands": ("int", 0, 0, 4),
    "colorCoherence": ("double", 0.0, 0, 1), "gapFill": ("double", 0.0, 0, 5), "gradientStrength": ("double", 0.5, 0, 1), "gradientMinArea": ("int", 0, 0, 1_000_000),
    "gradientMaxDimension": ("int", 384, 128, 4096), "threshold": ("int", 128, 0, 255), "adaptiveRadius": ("int", 16, 2, 128), "adaptiveBias": ("double", 4.0, -64, 64),
    "smoothing": ("double", 0.75, 0, 1), "optTolerance": ("double", 0.2, 0, 5), "cornerThreshold": ("double", 100.0, 0, 180), "fitTolerance": ("double", 1.2, 0.1, 10),
    "simplifyTolerance": ("double", 0.5, 0, 10), "strokeWidth": ("double", 0.0, 0, 64), "pruneLength": ("double", 8.0, 0, 256), "precision": ("int", 1, 0, 4), "widthMm": ("double", 0.0, 0, 10_000),
}
FLAGS = {
    "autoPaletteSize": False, "preserveDetails": False, "omitBackground": False, "gradients": False, "invert": False, "curveOptimize": True, "optimizeSvg": True, "groupByColor": False, "detectIslands": False,
}
CHOICES = {
    "mode": ("color", "grayscale", "bw", "centerline"), "denoise": ("none", "median", "bilateral"), "segmentation": ("quantize", "regions"), "colorSpace": ("oklab", "rgb"),
    "layering": ("stacked", "cutout", "nested"), "geometry": ("classic", "planar"), "frontEnd": ("classic", "ink"), "thresholdMode": ("auto", "fixed", "adaptive"),
    "curveMode": ("spline", "polygon", "pixel"), "turnPolicy": ("minority", "majority", "black", "white", "left", "right"), "unit": ("px", "mm"),
}
#: Where 0 means off and is kept.
OFF_AT_ZERO = ("maxDimension", "gradientMaxDimension")
PROFILES = {
    "illustration": {"mode": "color", "paletteSize": 24, "quantizeQuality": 7, "layering": "stacked", "smoothing": 0.8, "minRegionArea": 4, "colorCoherence": 0.5, "precision": 2},
    "photo": {"mode": "color", "paletteSize": 32, "quantizeQuality": 8, "denoise": "bilateral", "layering": "stacked", "smoothing": 0.85, "minRegionArea": 10, "colorCoherence": 0.5, "maxDimension": 1200},
    "logo": {"mode": "color", "paletteSize": 8, "autoPaletteSize": True, "layering": "nested", "smoothing": 0.8, "minRegionArea": 12, "curveOptimize": True, "optTolerance": 0.4, "precision": 2},
    "poster": {"mode": "color", "paletteSize": 6, "layering": "cutout", "groupByColor": True, "smoothing": 0.85, "minRegionArea": 24, "omitBackground": True, "gapFill": 0.2, "unit": "mm", "precision": 3},
    "pixel-art": {"mode": "color", "paletteSize": 64, "autoPaletteSize": True, "maxDimension": 0, "curveMode": "pixel", "layering": "cutout", "minRegionArea": 0, "denoise": "none", "blurRadius": 0, "precision": 0},
    "bw-sketch": {"mode": "bw", "thresholdMode": "auto", "smoothing": 0.75, "minRegionArea": 8},
    "vinyl-cut": {"mode": "color", "paletteSize": 6, "autoPaletteSize": True, "layering": "stacked", "groupByColor": True, "minRegionArea": 16, "preserveDetails": True, "omitBackground": True, "smoothing": 0.7, "curveOptimize": True, "unit": "mm", "precision": 3, "detectIslands": False},
    "laser-engrave": {"mode": "bw", "thresholdMode": "auto", "minRegionArea": 4, "smoothing": 0.6, "unit": "mm", "precision": 3},
    "pen-plotter": {"mode": "centerline", "thresholdMode": "auto", "pruneLength": 12, "smoothing": 0.8, "fitTolerance": 1.6, "unit": "mm", "precision": 3},
    "stencil": {"mode": "bw", "thresholdMode": "auto", "minRegionArea": 64, "smoothing": 0.8, "layering": "cutout", "detectIslands": True, "unit": "mm", "precision": 3},
}


def _number(name: str, raw: Column) -> Column:
    kind, default, low, high = NUMBERS[name]
    value = raw.try_cast("double")
    inside = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.floor(value + 0.5) if kind == "int" else value))
    if name in OFF_AT_ZERO:
        inside = F.when(value == 0, F.lit(0.0)).otherwise(inside)
    return F.coalesce(F.when(value.isNotNull() & ~F.isnan(value), inside), F.lit(float(default))).cast(kind)


def normalize(docs: DataFrame, json_col: str = "settings", keep: tuple = ()) -> DataFrame:
    """One column a setting from settings documents: unknown keys dropped, numbers rounded and clamped, unknown choices and what is missing by default; broken JSON gives the defaults."""

    def raw(name: str) -> Column:
        return F.get_json_object(json_col, f"$.{name}")

    out = [_number(n, raw(n)).alias(n) for n in NUMBERS]
    out += [F.when(raw(n).isin("true", "false"), raw(n) == "true").otherwise(F.lit(d)).alias(n) for n, d in FLAGS.items()]
    out += [F.when(raw(n).isin(*v), raw(n)).otherwise(F.lit(v[0])).alias(n) for n, v in CHOICES.items()]
    return docs.select(*keep, *out)


def document(settings: DataFrame, keep: tuple = (), version: int = 1) -> DataFrame:
    """Settings rows as versioned JSON documents."""
    names = [*NUMBERS, *FLAGS, *CHOICES]
    return settings.select(*keep, F.to_json(F.struct(F.lit(version).alias("version"), *[c for c in names if c in settings.columns])).alias("settings"))


def profile_patch(name: str) -> dict:
    """A profile's settings over the defaults."""
    base = {n: v[1] for n, v in NUMBERS.items()} | FLAGS | {n: v[0] for n, v in CHOICES.items()}
    return base | PROFILES[name]
