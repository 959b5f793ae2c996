"""Neighborhood access on complete pixel grids (image_id, x, y, ...), one shuffle by image.

Windows partition by (image_id, y) and (image_id, x); a repartition by image_id satisfies both, so a chain of operators on
one image set exchanges once. Very large images are cut into tiles first (operators.tiles), which makes the tile the image here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("image_id", "y")
COL = ("image_id", "x")


def by_image(pixels: DataFrame) -> DataFrame:
    return pixels.repartition("image_id")


def along_row():
    return Window.partitionBy(*ROW).orderBy("x")


def along_column():
    return Window.partitionBy(*COL).orderBy("y")


def shifted(value: Column | str, dx: int = 0, dy: int = 0) -> Column:
    """The value at (x + dx, y + dy), along one axis; null outside."""
    value = F.col(value) if isinstance(value, str) else value
    step, w = (dx, along_row()) if dx else (dy, along_column())
    return F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w)


def four(value: Column | str) -> list[Column]:
    return [shifted(value, dx=-1), shifted(value, dx=1), shifted(value, dy=-1), shifted(value, dy=1)]


def with_eight(pixels: DataFrame, value: str, prefix: str = "n") -> DataFrame:
    """pixels with n0 to n7, the values of the eight neighbors (null outside), row above first."""
    up, down = shifted(value, dy=-1), shifted(value, dy=1)
    df = pixels.withColumns({f"{prefix}1": up, f"{prefix}6": down})
    side = {f"{prefix}3": shifted(value, dx=-1), f"{prefix}4": shifted(value, dx=1)}
    for i, (row, step) in enumerate(((1, -1), (1, 1), (6, -1), (6, 1))):
        side[f"{prefix}{(0, 2, 5, 7)[i]}"] = shifted(f"{prefix}{row}", dx=step)
    return df.withColumns(side)


def box(value: Column | str, radius: int, aggregate=F.sum) -> tuple:
    """Aggregates over rows, then columns, of a box window cut at the image."""
    row = along_row().rowsBetween(-radius, radius)
    column = along_column().rowsBetween(-radius, radius)
    return lambda c: aggregate(c).over(row), lambda c: aggregate(c).over(column)
