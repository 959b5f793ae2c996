"""SVG text: writing paths, reading statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the shape elements of SVG.
SHAPES = "path|rect|circle|ellipse|line|polyline|polygon"


def number(value: Column, places: int = 2) -> Column:
    """Shortest decimal at so many places: no trailing zeros, no leading zero, no negative zero."""
    text = F.format_string(f"%.{places}f", F.round(value, places))
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.isin("0", "-0"), "0").otherwise(F.regexp_replace(text, r"^(-?)0\.", "$1."))


def path_data(points: DataFrame, key: str = "line_id", places: int = 2) -> DataFrame:
    """key, d: a closed path of straight lines through the points in order. The ordered list of a line is one row: lines are the unit of work here."""
    step = F.struct("seq", F.concat(number(F.col("px"), places), F.lit(" "), number(F.col("py"), places)).alias("t"))
    ordered = points.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("s"))
    return ordered.select(key, F.concat(F.lit("M"), F.array_join(F.transform("s", lambda s: s["t"]), "L"), F.lit("Z")).alias("d"))


def document(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, svg: shapes (image_id, place, d, fill) in paint order."""
    part = F.struct("place", F.concat(F.lit('<path d="'), F.col("d"), F.lit('" fill="'), F.col("fill"), F.lit('"/>')).alias("t"))
    rows = shapes.groupBy("image_id").agg(F.array_sort(F.collect_list(part)).alias("s"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">'
    return rows.select("image_id", F.concat(F.lit(head), F.array_join(F.transform("s", lambda s: s["t"]), ""), F.lit("</svg>")).alias("svg"))


def grouped_by_color(shapes: DataFrame) -> DataFrame:
    """image_id, fill, n, first: shapes of one color together, groups in the order of their first shape."""
    return shapes.groupBy("image_id", "fill").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))


def analyze(docs: DataFrame, text: str = "svg", key: str = "image_id") -> DataFrame:
    """key, shapes, nodes, colors, bytes: shape elements, drawing commands in path data (Z apart), distinct paints in order of first use, and size."""
    t = F.col(text)
    nodes = F.aggregate(F.regexp_extract_all(t, F.lit(r'\sd="([^"]*)"'), F.lit(1)), F.lit(0), lambda n, d: n + F.length(F.regexp_replace(d, "[^MLHVCSQTAmlhvcsqta]", "")))
    fills = F.transform(F.regexp_extract_all(t, F.lit(r'(?:fill|stroke|stop-color)="([^"]*)"'), F.lit(1)), F.lower)
    fills = F.transform(fills, lambda c: F.regexp_replace(c, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3"))
    fills = F.array_distinct(F.filter(fills, lambda c: ~c.isin("none", "transparent") & ~c.startswith("url(")))
    return docs.select(key, F.regexp_count(t, F.lit(rf"<({SHAPES})[\s/>]")).alias("shapes"), nodes.alias("nodes"), F.array_join(fills, ",").alias("colors"), F.octet_length(t).alias("bytes"))
