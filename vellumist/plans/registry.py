"""Every query of the image engine with its SQL oracle.

A query is registered by ``@query(sql)``; its name is the function's. SQL is None where a result has no SQL form (ordered walks
and iterative fits); tests hold those against brute force and invariants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumist.functions import color, geometry
from vellumist.operators import curves, grid, layers, palette, quality, raster, regions, search, skeleton, svg, tiles
from vellumist.sources import adapters
from vellumist.sources.adapters import px_gray, px_rgb

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

PALETTE = [(20, 20, 20), (235, 235, 235), (200, 60, 40), (40, 160, 80), (50, 80, 200), (128, 128, 128)]

# --- building blocks of the oracles

GRAY = """gray AS (SELECT vec_id AS image_id, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y,
    CAST(greatest(0, least(255, floor(128 + 256 * CAST(v AS DOUBLE)))) AS INTEGER) AS g
    FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""


def _channel(k: int) -> str:
    return f"CAST(greatest(0, least(255, floor(128 + 256 * CAST(e[(p + {k}) % len(e) + 1] AS DOUBLE)))) AS INTEGER)"


RGB = f"""rgb AS (SELECT vec_id AS image_id, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y,
    {_channel(0)} AS r, {_channel(21)} AS g, {_channel(42)} AS b
    FROM (SELECT vec_id, embedding AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
MASK = GRAY + ", mask AS (SELECT image_id, x, y, CAST(g < 128 AS INTEGER) AS m FROM gray)"
BANDS = GRAY + ", mask AS (SELECT image_id, x, y, CAST(g // 64 AS INTEGER) AS m FROM gray)"
SIDES = "WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)"


def components_sql(name: str = "comps", diagonal: bool = False) -> str:
    near = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)" if diagonal else "abs(a.x - b.x) + abs(a.y - b.y) = 1"
    return f"""{name}_edges AS (SELECT a.image_id, a.y * 1048576 + a.x AS p, b.y * 1048576 + b.x AS q FROM mask a JOIN mask b ON a.image_id = b.image_id AND a.m = b.m AND {near}),
    {name}_reach AS (SELECT image_id, y * 1048576 + x AS p, y * 1048576 + x AS root FROM mask
        UNION SELECT e.image_id, e.q, r.root FROM {name}_reach r JOIN {name}_edges e ON e.image_id = r.image_id AND e.p = r.p),
    {name} AS (SELECT m.image_id, m.x, m.y, m.m, CAST(t.comp AS BIGINT) AS comp FROM mask m
        JOIN (SELECT image_id, p, min(root) AS comp FROM {name}_reach GROUP BY ALL) t ON t.image_id = m.image_id AND t.p = m.y * 1048576 + m.x)"""


SHAPE = """shape AS (SELECT image_id, comp, min(m) AS label, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
    bool_or(x = 0 OR y = 0 OR x = 7 OR y = 7) AS on_border FROM comps GROUP BY ALL)"""


def lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


def dot(row: tuple, cols: tuple) -> str:
    return "(" + " + ".join(f"({k!r}::DOUBLE) * ({c})" for k, c in zip(row, cols)) + ")"


def oklab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    cones = [f"cbrt({dot(row, (lin(r), lin(g), lin(b)))})" for row in color.LMS]
    return tuple(dot(row, cones) for row in color.OKLAB)


def rounded(text: str, places: int = 6) -> str:
    return f"round({text}, {places}) + 0e0"


def rnd(value, places: int = 6):
    """Rounded, with one zero only."""
    return F.round(F.col(value) if isinstance(value, str) else value, places) + F.lit(0.0)


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def mask_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px_gray(spark, sf_dir).select("image_id", "x", "y", (F.col("g") < 128).cast("int").alias("m"))


def bands_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px_gray(spark, sf_dir).select("image_id", "x", "y", F.expr("int(g div 64)").alias("m"))


# --- color


@query("SELECT CAST(range AS INTEGER) AS byte, " + rounded(lin("range"), 9) + " AS light FROM range(0, 256)")
def srgb_linear(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("byte"), rnd(color.linear(F.col("id")), 9).alias("light"))


@query(f"WITH {RGB} SELECT DISTINCT r, g, b, " + ", ".join(f"{rounded(c)} AS {n}" for c, n in zip(oklab_sql("r", "g", "b"), ("l_", "a_", "b_"))) + " FROM rgb")
def oklab(spark, sf_dir):
    lab_ = color.oklab(F.col("r"), F.col("g"), F.col("b"))
    return px_rgb(spark, sf_dir).select("r", "g", "b").distinct().select("r", "g", "b", *[rnd(c).alias(n) for c, n in zip(lab_, ("l_", "a_", "b_"))])


def _back_sql(l_: str, a_: str, b_: str) -> list[str]:
    cubes = [f"pow({dot(row, (l_, a_, b_))}, 3)" for row in color.LMS_BACK]
    light = [dot(row, cubes) for row in color.RGB_BACK]
    return [f"CAST(greatest(0, least(255, floor(255 * (CASE WHEN {c} <= 0.0031308e0 THEN 12.92e0 * {c} ELSE 1.055e0 * pow(greatest({c}, 0e0), 1e0 / 2.4e0) - 0.055e0 END) + 0.5e0))) AS INTEGER)" for c in light]


@query(f"WITH {RGB}, o AS (SELECT DISTINCT r, g, b, " + ", ".join(f"1.1e0 * {c} AS {n}" for c, n in zip(oklab_sql("r", "g", "b"), ("l_", "a_", "b_"))) + " FROM rgb) SELECT r, g, b, " + ", ".join(f"{c} AS {n}" for c, n in zip(_back_sql("l_", "a_", "b_"), ("r2", "g2", "b2"))) + " FROM o")
def oklab_roundtrip(spark, sf_dir):
    """To Oklab, a tenth lighter and more colorful, and back with clamping."""
    lab_ = color.with_oklab(px_rgb(spark, sf_dir).select("r", "g", "b").distinct(), "LMN").withColumns({c: 1.1 * F.col(c) for c in "LMN"})
    return color.with_rgb(lab_, "LMN", ("r2", "g2", "b2")).drop(*"LMN")


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    f = []
    for row, w in zip(color.XYZ, color.WHITE):
        t = f"({dot(row, (lin(r), lin(g), lin(b)))} / {w!r}::DOUBLE)"
        f.append(f"(CASE WHEN {t} > 216e0 / 24389e0 THEN cbrt({t}) ELSE ({t} * (24389e0 / 27e0) + 16e0) / 116e0 END)")
    return f"(116e0 * {f[1]} - 16e0)", f"(500e0 * ({f[0]} - {f[1]}))", f"(200e0 * ({f[1]} - {f[2]}))"


@query(f"WITH {RGB} SELECT DISTINCT r, g, b, " + ", ".join(f"{rounded(c)} AS {n}" for c, n in zip(lab_sql("r", "g", "b"), ("l_", "a_", "b_"))) + " FROM rgb")
def lab(spark, sf_dir):
    lab_ = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return px_rgb(spark, sf_dir).select("r", "g", "b").distinct().select("r", "g", "b", *[rnd(c).alias(n) for c, n in zip(lab_, ("l_", "a_", "b_"))])


CIEDE = f"""WITH {RGB}, p AS (SELECT image_id, x, y, {lab_sql("r", "g", "b")[0]} AS l1, {lab_sql("r", "g", "b")[1]} AS a1, {lab_sql("r", "g", "b")[2]} AS b1 FROM rgb),
    q AS (SELECT image_id, x, y, l1, a1, b1, lead(l1) OVER h AS l2, lead(a1) OVER h AS a2, lead(b1) OVER h AS b2 FROM p WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
    k AS (SELECT *, 0.5e0 * (1 - sqrt(pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) / (pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) + pow(25e0, 7)))) AS gg FROM q WHERE l2 IS NOT NULL),
    c AS (SELECT *, a1 * (1 + gg) AS p1, a2 * (1 + gg) AS p2 FROM k),
    d AS (SELECT *, sqrt(p1*p1+b1*b1) AS k1, sqrt(p2*p2+b2*b2) AS k2,
        CASE WHEN b1 = 0 AND p1 = 0 THEN 0e0 ELSE degrees(atan2(b1, p1)) + CASE WHEN degrees(atan2(b1, p1)) < 0 THEN 360e0 ELSE 0e0 END END AS h1,
        CASE WHEN b2 = 0 AND p2 = 0 THEN 0e0 ELSE degrees(atan2(b2, p2)) + CASE WHEN degrees(atan2(b2, p2)) < 0 THEN 360e0 ELSE 0e0 END END AS h2 FROM c),
    e AS (SELECT *, CASE WHEN k1 * k2 = 0 THEN 0e0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
        CASE WHEN k1 * k2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (k1 + k2) / 2 AS mc FROM d),
    f AS (SELECT *, 1 - 0.17e0 * cos(radians(mh - 30)) + 0.24e0 * cos(radians(2 * mh)) + 0.32e0 * cos(radians(3 * mh + 6)) - 0.20e0 * cos(radians(4 * mh - 63)) AS t,
        2 * sqrt(k1 * k2) * sin(radians(dh / 2)) AS dhh, -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25e0, 7))) AS rt FROM e),
    g AS (SELECT *, (l2 - l1) / (1 + 0.015e0 * (ml - 50) * (ml - 50) / sqrt(20 + (ml - 50) * (ml - 50))) AS u, (k2 - k1) / (1 + 0.045e0 * mc) AS w, dhh / (1 + 0.015e0 * mc * t) AS z FROM f)
    SELECT image_id, x, y, round(sqrt(u * u + w * w + z * z + rt * w * z), 4) + 0e0 AS de FROM g"""


@query(CIEDE)
def ciede2000_pairs(spark, sf_dir):
    names = ("l_", "a_", "b_")
    df = px_rgb(spark, sf_dir)
    df = df.select("image_id", "x", "y", *[c.alias(n) for c, n in zip(color.lab(F.col("r"), F.col("g"), F.col("b")), names)])
    df = df.withColumns({f"{n}2": grid.shifted(n, dx=1) for n in names}).filter("l_2 is not null")
    return df.select("image_id", "x", "y", rnd(color.ciede2000(tuple(map(F.col, names)), tuple(F.col(f"{n}2") for n in names)), 4).alias("de"))


@query("""SELECT lang, count(*) AS n, CAST(sum(CAST(('0x' || substr(h, 1, 2)) AS INTEGER)) AS BIGINT) AS r, CAST(sum(CAST(('0x' || substr(h, 3, 2)) AS INTEGER)) AS BIGINT) AS g, CAST(sum(CAST(('0x' || substr(h, 5, 2)) AS INTEGER)) AS BIGINT) AS b
    FROM (SELECT lang, substr(md5(text), 1, 6) AS h FROM documents) GROUP BY lang""")
def hex_parse(spark, sf_dir):
    c = adapters.colors(spark, sf_dir).withColumn("c", color.hex_parse(F.concat(F.lit("#"), F.col("hex"))))
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"c.{x}")).cast("long").alias(x) for x in "rgb"])


@query(f"WITH {RGB} SELECT hex, count(*) AS n FROM (SELECT '#' || printf('%02x%02x%02x', r, g, b) AS hex FROM rgb) GROUP BY hex")
def hex_format(spark, sf_dir):
    return px_rgb(spark, sf_dir).groupBy(color.hex_format(F.col("r"), F.col("g"), F.col("b")).alias("hex")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RGB} SELECT image_id, x, y, {rounded(oklab_sql('r', 'g', 'b')[0])} AS v FROM rgb")
def gray_lightness(spark, sf_dir):
    return raster.gray_lightness(px_rgb(spark, sf_dir)).withColumn("v", rnd("v"))


@query(f"WITH {RGB} SELECT image_id, x, y, {rounded('(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255e0')} AS v FROM rgb")
def encoded_luma(spark, sf_dir):
    return raster.luma(px_rgb(spark, sf_dir)).withColumn("v", rnd("v"))


# --- geometry of lines

LINES = "p AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS px, value AS py FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"


@query(f"""WITH {LINES}, s AS (SELECT line_id, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, round(coalesce(sum(d), 0), 4) + 0e0 AS length, count(*) AS n FROM s GROUP BY line_id""")
def polyline_length(spark, sf_dir):
    return geometry.line_length(adapters.polyline(spark, sf_dir)).withColumn("length", rnd("length", 4))


@query(f"""WITH {LINES}, s AS (SELECT line_id, px * coalesce(lead(py) OVER w, first_value(py) OVER w) - coalesce(lead(px) OVER w, first_value(px) OVER w) * py AS c FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, round(sum(c) / 2, 4) + 0e0 AS area FROM s GROUP BY line_id""")
def shoelace_area(spark, sf_dir):
    return geometry.ring_area(adapters.polyline(spark, sf_dir)).withColumn("area", rnd("area", 4))


@query(f"""WITH {LINES}, s AS (SELECT line_id, seq, lag(px) OVER w - px AS ax, lag(py) OVER w - py AS ay, lead(px) OVER w - px AS bx, lead(py) OVER w - py AS by_ FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, CAST(seq AS INTEGER) AS seq, CASE WHEN (ax = 0 AND ay = 0) OR (bx = 0 AND by_ = 0) THEN 180e0 ELSE round(degrees(abs(atan2(ax * by_ - ay * bx, ax * bx + ay * by_))), 5) + 0e0 END AS angle FROM s WHERE ax IS NOT NULL AND bx IS NOT NULL""")
def interior_angle(spark, sf_dir):
    return geometry.corner_angle(adapters.polyline(spark, sf_dir)).withColumn("angle", rnd("angle", 5))


@query(f"""WITH {LINES}, s AS (SELECT *, first_value(px) OVER w AS ax, first_value(py) OVER w AS ay, last_value(px) OVER w AS bx, last_value(py) OVER w AS by_ FROM p
        WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    t AS (SELECT *, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) END AS t FROM s)
    SELECT line_id, CAST(seq AS INTEGER) AS seq, round(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2)), 5) + 0e0 AS d FROM t""")
def dist_to_segment(spark, sf_dir):
    return geometry.chord_distance(adapters.polyline(spark, sf_dir)).withColumn("d", rnd("d", 5))


@query(f"""WITH {LINES} SELECT line_id, CAST(seq AS INTEGER) AS seq, round(sum(px) OVER w, 5) + 0e0 AS sx, round(sum(py) OVER w, 5) + 0e0 AS sy, round(sum(px * px) OVER w, 5) + 0e0 AS sxx, round(sum(px * py) OVER w, 5) + 0e0 AS sxy, round(sum(py * py) OVER w, 5) + 0e0 AS syy
    FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def prefix_moments(spark, sf_dir):
    return geometry.prefix_moments(adapters.polyline(spark, sf_dir)).select("line_id", "seq", *[rnd(c, 5).alias(c) for c in ("sx", "sy", "sxx", "sxy", "syy")])


@query(f"""WITH {LINES}, q AS (SELECT line_id, px AS x, py AS y, px * px + py * py AS z FROM p),
    m AS (SELECT line_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS cxx, covar_pop(x, y) AS cxy, var_pop(y) AS cyy, covar_pop(x, z) AS cxz, covar_pop(y, z) AS cyz FROM q GROUP BY line_id),
    s AS (SELECT *, (cxz * cyy - cyz * cxy) / (2 * (cxx * cyy - cxy * cxy)) AS cx, (cyz * cxx - cxz * cxy) / (2 * (cxx * cyy - cxy * cxy)) AS cy FROM m WHERE n >= 3 AND abs(cxx * cyy - cxy * cxy) > 1e-9)
    SELECT line_id, round(cx, 3) + 0e0 AS cx, round(cy, 3) + 0e0 AS cy, round(sqrt(greatest(0e0, mz - 2 * cx * mx - 2 * cy * my + cx * cx + cy * cy)), 3) + 0e0 AS r FROM s""")
def kasa_circle(spark, sf_dir):
    return geometry.kasa_circle(adapters.polyline(spark, sf_dir)).select("line_id", *[rnd(c, 3).alias(c) for c in ("cx", "cy", "r")])


@query(None)
def douglas_peucker(spark, sf_dir):
    return curves.simplify(adapters.polyline(spark, sf_dir), 5.0)


@query(None)
def cubic_fit(spark, sf_dir):
    return curves.fit_curves(adapters.polyline(spark, sf_dir), 5.0)


@query(f"""WITH {LINES}, f AS (SELECT line_id, seq, replace(regexp_replace(regexp_replace(regexp_replace(printf('%.2f', px), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '^(-?)0\\.', '\\1.'), 'x', '') AS a,
        CASE WHEN round(py, 2) = 0 THEN '0' ELSE regexp_replace(regexp_replace(regexp_replace(printf('%.2f', round(py, 2)), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '^(-?)0\\.', '\\1.') END AS b FROM p)
    SELECT line_id, 'M' || string_agg(a || ' ' || b, 'L' ORDER BY seq) || 'Z' AS d FROM f GROUP BY line_id""")
def path_data(spark, sf_dir):
    return svg.path_data(adapters.polyline(spark, sf_dir))


# --- rasters

ALPHA = "(64 + (x * 23 + y * 41) % 192)"


@query(f"WITH {RGB} SELECT image_id, x, y, " + ", ".join(f"CAST(floor({c} * ({ALPHA} / 255e0) + 255 * (1 - {ALPHA} / 255e0) + 0.5e0) AS INTEGER) AS {c}" for c in "rgb") + " FROM rgb")
def flatten_alpha(spark, sf_dir):
    return raster.flatten_alpha(px_rgb(spark, sf_dir), F.expr(ALPHA))


@query(f"""WITH {RGB}, e AS (SELECT image_id, r, g, b, count(*) AS n FROM rgb WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY ALL)
    SELECT image_id, r, g, b, n FROM e QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) = 1""")
def border_dominant_color(spark, sf_dir):
    return raster.border_dominant_color(px_rgb(spark, sf_dir))


OTSU = """h AS (SELECT image_id, g AS bin, count(*) AS n FROM gray GROUP BY ALL),
    c AS (SELECT image_id, bin, sum(n) OVER w AS wb, sum(n * bin) OVER w AS sb, sum(n) OVER (PARTITION BY image_id) AS w_, sum(n * bin) OVER (PARTITION BY image_id) AS s_ FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin)),
    sc AS (SELECT image_id, bin, CAST(s_ * wb - w_ * sb AS DOUBLE) * CAST(s_ * wb - w_ * sb AS DOUBLE) / CAST(wb * (w_ - wb) AS DOUBLE) AS score FROM c WHERE w_ > wb),
    t AS (SELECT image_id, min(bin) AS lo, max(bin) AS hi FROM sc s WHERE score = (SELECT max(score) FROM sc o WHERE o.image_id = s.image_id) GROUP BY image_id),
    otsu AS (SELECT i.image_id, coalesce((lo + hi) / 2e0, 127e0) AS bin FROM (SELECT DISTINCT image_id FROM gray) i LEFT JOIN t USING (image_id))"""


@query(f"WITH {GRAY}, {OTSU} SELECT image_id, bin FROM otsu")
def otsu_threshold(spark, sf_dir):
    return raster.otsu_bins(px_gray(spark, sf_dir))


@query(f"WITH {GRAY}, {OTSU} SELECT image_id, x, y, CAST(g < bin + 1 AS INTEGER) AS m FROM gray JOIN otsu USING (image_id)")
def otsu_binarize(spark, sf_dir):
    return raster.otsu_binarize(px_gray(spark, sf_dir))


@query(f"WITH {GRAY} SELECT image_id, x, y, CAST(NOT g < 100 AS INTEGER) AS m FROM gray")
def binarize_fixed(spark, sf_dir):
    return raster.binarize(px_gray(spark, sf_dir), F.lit(100), invert=True)


@query(f"""WITH {GRAY}, s AS (SELECT a.image_id, a.x, a.y, a.g, sum(b.g) AS s, count(*) AS c FROM gray a JOIN gray b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL)
    SELECT image_id, x, y, CAST(g < s / CAST(c AS DOUBLE) - 4 AS INTEGER) AS m FROM s""")
def adaptive_binarize(spark, sf_dir):
    return raster.adaptive_binarize(px_gray(spark, sf_dir))


@query(f"WITH {GRAY} SELECT image_id, x, y, round(CASE WHEN 0.4e0 - g / 255e0 > 0 THEN (0.4e0 - g / 255e0) * (0.5e0 / 0.4e0) ELSE (0.4e0 - g / 255e0) * (0.5e0 / 0.6e0) END, 6) + 0e0 AS f FROM gray")
def signed_field(spark, sf_dir):
    return raster.signed_field(px_gray(spark, sf_dir), 0.4).withColumn("f", rnd("f"))


@query(f"""WITH {RGB} SELECT a.image_id, a.x, a.y, CAST(max(CASE WHEN abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) >= 40 THEN 1 ELSE 0 END) AS INTEGER) AS e
    FROM rgb a JOIN rgb b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL""")
def edge_mask(spark, sf_dir):
    return raster.edge_mask(px_rgb(spark, sf_dir))


@query(f"""WITH {GRAY}, k AS (SELECT CAST(range AS INTEGER) AS d, exp(-0.5e0 * range * range) AS w FROM range(-3, 4)),
    a AS (SELECT p.image_id, p.x, p.y, sum(k.w * q.g) / sum(k.w) AS v FROM gray p, k, gray q WHERE q.image_id = p.image_id AND q.y = p.y AND q.x = greatest(0, least(7, p.x + k.d)) GROUP BY ALL)
    SELECT p.image_id, p.x, p.y, round(sum(k.w * q.v) / sum(k.w), 6) + 0e0 AS v FROM a p, k, a q WHERE q.image_id = p.image_id AND q.x = p.x AND q.y = greatest(0, least(7, p.y + k.d)) GROUP BY ALL""")
def gaussian_blur(spark, sf_dir):
    return raster.gaussian_blur(px_gray(spark, sf_dir)).withColumn("v", rnd("v"))


@query(f"""WITH {GRAY}, s AS (SELECT a.image_id, a.x, a.y, list_sort(list(b.g)) AS l FROM gray a JOIN gray b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
    SELECT image_id, x, y, l[len(l) // 2 + 1] AS g FROM s""")
def median_filter(spark, sf_dir):
    return raster.median_filter(px_gray(spark, sf_dir))


@query(f"""WITH {GRAY}, s AS (SELECT a.image_id, a.x, a.y, b.g, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 8e0) * exp(-pow(a.g - b.g, 2) / 2450e0) AS w FROM gray a JOIN gray b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)
    SELECT image_id, x, y, CAST(floor(round(sum(w * g) / sum(w), 6) + 0.5e0) AS INTEGER) AS g FROM s GROUP BY ALL""")
def bilateral_filter(spark, sf_dir):
    return raster.bilateral_filter(px_gray(spark, sf_dir))


@query(f"""WITH {GRAY}, d AS (SELECT CAST(range AS INTEGER) AS i FROM range(0, 5))
    SELECT image_id, dx.i AS x, dy.i AS y, round(sum(g * wx * wy) / sum(wx * wy), 6) + 0e0 AS v FROM (
        SELECT gray.*, dx.i AS dxi, dy.i AS dyi, least(x + 1e0, (dx.i + 1) * 1.6e0) - greatest(x + 0e0, dx.i * 1.6e0) AS wx, least(y + 1e0, (dy.i + 1) * 1.6e0) - greatest(y + 0e0, dy.i * 1.6e0) AS wy FROM gray, d dx, d dy) t
    JOIN d dx ON dx.i = dxi JOIN d dy ON dy.i = dyi WHERE wx > 1e-9 AND wy > 1e-9 GROUP BY ALL""")
def area_resize(spark, sf_dir):
    return raster.area_resize(px_gray(spark, sf_dir), 8, 8, 5, 5).withColumn("v", rnd("v"))


@query(f"""WITH {GRAY}, d AS (SELECT image_id, abs(4 * g - lag(g) OVER h - lead(g) OVER h - lag(g) OVER v - lead(g) OVER v) AS d FROM gray {SIDES}),
    r AS (SELECT image_id, d, row_number() OVER (PARTITION BY image_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS m FROM d WHERE d IS NOT NULL)
    SELECT image_id, round(greatest(0.5e0, d / 0.12566e0 / sqrt(20e0)), 6) + 0e0 AS sigma FROM r WHERE i = floor(0.1e0 * m)""")
def noise_estimate(spark, sf_dir):
    return raster.noise(px_gray(spark, sf_dir)).withColumn("sigma", rnd("sigma"))


@query(f"""WITH {MASK}, s AS (SELECT *, CASE WHEN m = lag(m) OVER h THEN 0 ELSE 1 END AS st FROM mask WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
    t AS (SELECT *, sum(st) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM s)
    SELECT image_id, y, min(x) AS x0, max(x) AS x1, min(m) AS m FROM t GROUP BY image_id, y, run""")
def row_runs(spark, sf_dir):
    return raster.row_runs(mask_of(spark, sf_dir))


@query(f"WITH {GRAY} SELECT image_id, CAST(g * 16 // 256 AS INTEGER) AS bar, count(*) AS n FROM gray GROUP BY ALL")
def luminance_histogram(spark, sf_dir):
    return raster.luminance_histogram(px_gray(spark, sf_dir))


@query("SELECT CAST(l_quantity AS INTEGER) AS x, CAST(round(l_discount * 100) AS INTEGER) AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def density_canvas(spark, sf_dir):
    return adapters.canvas(spark, sf_dir)


# --- regions


@query(f"WITH RECURSIVE {MASK}, {components_sql()} SELECT image_id, x, y, m, comp FROM comps")
def connected_components(spark, sf_dir):
    return regions.connected_components(mask_of(spark, sf_dir))


@query(f"WITH RECURSIVE {MASK}, {components_sql(diagonal=True)} SELECT image_id, x, y, m, comp FROM comps")
def connected_components_8(spark, sf_dir):
    return regions.connected_components(mask_of(spark, sf_dir), diagonal=True)


@query(f"WITH RECURSIVE {MASK}, {components_sql()}, {SHAPE} SELECT * FROM shape")
def component_shape(spark, sf_dir):
    return regions.component_shape(regions.connected_components(mask_of(spark, sf_dir)))


@query(f"""WITH RECURSIVE {MASK}, {components_sql()}, {components_sql("ink", True)},
    specks AS (SELECT image_id, comp FROM ink GROUP BY ALL HAVING min(m) = 1 AND count(*) < 3),
    holes AS (SELECT image_id, comp FROM comps GROUP BY ALL HAVING min(m) = 0 AND count(*) < 3 AND NOT bool_or(x IN (0, 7) OR y IN (0, 7)))
    SELECT c.image_id, c.x, c.y, CASE WHEN EXISTS (SELECT 1 FROM specks s WHERE s.image_id = i.image_id AND s.comp = i.comp) OR EXISTS (SELECT 1 FROM holes s WHERE s.image_id = c.image_id AND s.comp = c.comp) THEN 1 - c.m ELSE c.m END AS m
    FROM comps c JOIN ink i ON i.image_id = c.image_id AND i.x = c.x AND i.y = c.y""")
def despeckle_mask(spark, sf_dir):
    return regions.despeckle(mask_of(spark, sf_dir), 3)


@query(f"WITH RECURSIVE {MASK}, {components_sql()}, {SHAPE} SELECT c.image_id, c.x, c.y, CASE WHEN s.label = 1 AND s.on_border THEN 0 ELSE c.m END AS m FROM comps c JOIN shape s USING (image_id, comp)")
def border_clear(spark, sf_dir):
    return regions.clear_border(mask_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {BANDS}, {components_sql()}, {SHAPE},
    o AS (SELECT a.image_id, a.comp, min(b.m) AS lo, max(b.m) AS hi FROM comps a JOIN comps b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.m <> b.m GROUP BY ALL)
    SELECT image_id, comp, label, area, lo AS around FROM shape JOIN o USING (image_id, comp) WHERE NOT on_border AND lo = hi""")
def enclosed_islands(spark, sf_dir):
    return regions.enclosed(bands_of(spark, sf_dir))


@query(f"""WITH {BANDS} SELECT a.image_id, least(a.m, b.m) AS a, greatest(a.m, b.m) AS b, count(*) AS n FROM mask a JOIN mask b ON a.image_id = b.image_id AND a.m <> b.m AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY ALL""")
def region_adjacency(spark, sf_dir):
    return regions.adjacency(bands_of(spark, sf_dir))


PERIMETER = f"""sides AS (SELECT image_id, m, CASE WHEN m = lag(m) OVER h THEN 0 ELSE 1 END + CASE WHEN m = lead(m) OVER h THEN 0 ELSE 1 END + CASE WHEN m = lag(m) OVER v THEN 0 ELSE 1 END + CASE WHEN m = lead(m) OVER v THEN 0 ELSE 1 END AS p FROM mask {SIDES}),
    perimeter AS (SELECT image_id, m AS label, CAST(sum(p) AS BIGINT) AS perimeter, count(*) AS n FROM sides GROUP BY ALL)"""


@query(f"WITH {BANDS}, {PERIMETER} SELECT image_id, label, perimeter FROM perimeter")
def label_perimeter(spark, sf_dir):
    return regions.perimeter(bands_of(spark, sf_dir))


VOTES = "near AS (SELECT a.image_id, a.x, a.y, a.m, b.m AS o FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y))"


@query(f"""WITH {BANDS}, {VOTES}, t AS (SELECT image_id, x, y, m, o, count(*) AS n FROM near GROUP BY ALL),
    b AS (SELECT image_id, x, y, m, coalesce(max(n) FILTER (o = m), 0) AS own, min(struct_pack(n := -n, o := o)) FILTER (o <> m) AS best FROM t GROUP BY ALL)
    SELECT image_id, x, y, CASE WHEN own <= 2 AND best.n <= -3 THEN best.o ELSE m END AS m FROM b""")
def dissolve_bands(spark, sf_dir):
    return regions.dissolve_bands(bands_of(spark, sf_dir))


def _potts_costs(spark, sf_dir):
    tone = [color.lightness(F.lit(64 * k + 32)) for k in range(4)]
    d = [(color.lightness(F.col("g")) - t) * (color.lightness(F.col("g")) - t) for t in tone]
    return px_gray(spark, sf_dir).select("image_id", "x", "y", F.array(*[x.cast("double") for x in d]).alias("costs"))


@query(f"""WITH {BANDS}, {VOTES}, cand AS (SELECT DISTINCT image_id, x, y, m, m AS k, -1 AS i FROM mask
        UNION ALL SELECT a.image_id, a.x, a.y, a.m, b.m, min((b.y - a.y + 1) * 3 + (b.x - a.x + 1)) FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.m <> a.m GROUP BY ALL),
    c AS (SELECT c.*, pow({oklab_sql('g.g', 'g.g', 'g.g')[0]} - {oklab_sql('(64 * k + 32)', '(64 * k + 32)', '(64 * k + 32)')[0]}, 2) + 0.004e0 * (SELECT count(*) FROM near n WHERE n.image_id = c.image_id AND n.x = c.x AND n.y = c.y AND n.o <> k) AS cost FROM cand c JOIN gray g USING (image_id, x, y))
    SELECT image_id, x, y, k AS m FROM c QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY round(cost, 9), i) = 1""")
def potts_smooth(spark, sf_dir):
    return regions.potts_round(bands_of(spark, sf_dir), _potts_costs(spark, sf_dir), 0.004)


@query(f"""WITH RECURSIVE {BANDS}, {components_sql()} SELECT image_id, CAST(floor(log2(area) + 1e-9) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT image_id, comp, count(*) AS area FROM comps GROUP BY ALL) GROUP BY ALL""")
def region_area_histogram(spark, sf_dir):
    return regions.region_area_histogram(regions.connected_components(bands_of(spark, sf_dir)))


@query(f"""WITH RECURSIVE {BANDS}, {components_sql()}, small AS (SELECT image_id, comp FROM comps GROUP BY ALL HAVING count(*) < 3),
    v AS (SELECT a.image_id, a.comp, b.m AS o, count(*) AS n FROM comps a JOIN small s ON s.image_id = a.image_id AND s.comp = a.comp JOIN comps b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.m <> b.m GROUP BY ALL),
    t AS (SELECT image_id, comp, o FROM v QUALIFY row_number() OVER (PARTITION BY image_id, comp ORDER BY n DESC, o) = 1)
    SELECT c.image_id, c.x, c.y, coalesce(t.o, c.m) AS m FROM comps c LEFT JOIN t ON t.image_id = c.image_id AND t.comp = c.comp""")
def merge_small_round(spark, sf_dir):
    return regions.merge_small(bands_of(spark, sf_dir), 3, rounds=1)


@query(None)
def merge_small_regions(spark, sf_dir):
    return regions.merge_small(bands_of(spark, sf_dir), 3)


@query(f"""WITH {MASK} SELECT a.image_id, a.x, a.y, min(CASE WHEN b.m = 0 THEN 3 * greatest(abs(a.x - b.x), abs(a.y - b.y)) + least(abs(a.x - b.x), abs(a.y - b.y)) END) / 3e0 AS d FROM mask a JOIN mask b USING (image_id) GROUP BY ALL""")
def chamfer_distance(spark, sf_dir):
    return skeleton.chamfer(mask_of(spark, sf_dir))


WALK = "(0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)"
RING = f"""walk(i, dx, dy) AS (VALUES {WALK}),
    ring AS (SELECT a.image_id, a.x, a.y, a.m, list(coalesce(b.m, 0) ORDER BY w.i) AS p FROM mask a CROSS JOIN walk w LEFT JOIN mask b ON b.image_id = a.image_id AND b.x = a.x + w.dx AND b.y = a.y + w.dy GROUP BY ALL)"""


@query(f"""WITH {MASK}, {RING}, s AS (SELECT *, list_sum(p) AS t, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN p[i] = 0 AND p[i % 8 + 1] = 1 THEN 1 ELSE 0 END)) AS a FROM ring)
    SELECT image_id, x, y, CASE WHEN m = 1 AND t BETWEEN 2 AND 6 AND a = 1 AND p[1] * p[3] * p[5] = 0 AND p[3] * p[5] * p[7] = 0 THEN 0 ELSE m END AS m FROM s""")
def thin_step(spark, sf_dir):
    return skeleton.thin_pass(mask_of(spark, sf_dir), second=False)


@query(None)
def thinned(spark, sf_dir):
    return skeleton.thin(mask_of(spark, sf_dir))


@query(f"WITH {MASK}, {RING} SELECT image_id, x, y, CAST(list_sum(p) AS INTEGER) AS degree FROM ring WHERE m = 1")
def skeleton_degree(spark, sf_dir):
    return skeleton.degree(mask_of(spark, sf_dir))


# --- palettes


def nearest_sql(places: int = 9) -> str:
    own = oklab_sql("r", "g", "b")
    tries = []
    for i, c in enumerate(PALETTE):
        other = oklab_sql(*(str(v) for v in c))
        tries.append(f"struct_pack(d := round({' + '.join(f'pow({a} - {b}, 2)' for a, b in zip(own, other))}, {places}), i := {i})")
    return f"list_min([{', '.join(tries)}])"


NEAREST = f"near AS (SELECT r, g, b, ({nearest_sql()}).i AS label FROM (SELECT DISTINCT r, g, b FROM rgb))"


@query(f"WITH {RGB}, {NEAREST} SELECT image_id, x, y, CAST(label AS INTEGER) AS label FROM rgb JOIN near USING (r, g, b)")
def quantize_fixed_palette(spark, sf_dir):
    return palette.quantize_fixed(px_rgb(spark, sf_dir), PALETTE)


@query(f"WITH {RGB}, c AS (SELECT image_id, r, g, b, count(*) AS n FROM rgb GROUP BY ALL) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) - 1 AS INTEGER) AS label, r, g, b, n FROM c")
def quantize_exact(spark, sf_dir):
    return palette.quantize_exact(px_rgb(spark, sf_dir))


@query(f"WITH {RGB}, {NEAREST} SELECT CAST(label AS INTEGER) AS label, round(avg(r), 6) + 0e0 AS r, round(avg(g), 6) + 0e0 AS g, round(avg(b), 6) + 0e0 AS b, count(*) AS n FROM rgb JOIN near USING (r, g, b) GROUP BY label")
def lloyd_step(spark, sf_dir):
    return palette.lloyd_round(px_rgb(spark, sf_dir), PALETTE).select("label", *[rnd(c).alias(c) for c in "rgb"], "n")


@query(None)
def kmeans_labels(spark, sf_dir):
    return palette.quantize_fixed(px_rgb(spark, sf_dir), palette.kmeans(px_rgb(spark, sf_dir), PALETTE))


@query(f"""WITH {RGB}, l AS (SELECT *, CAST(r // 64 AS INTEGER) AS label FROM rgb),
    m AS (SELECT *, coalesce(lag(label) OVER h = label AND lead(label) OVER h = label AND lag(label) OVER v = label AND lead(label) OVER v = label, false) AS inside FROM l {SIDES}),
    i AS (SELECT *, sum(CAST(inside AS INTEGER)) OVER (PARTITION BY image_id, label) AS inner_ FROM m)
    SELECT image_id, label, CAST(quantile_disc(r, 0.5) AS INTEGER) AS r, CAST(quantile_disc(g, 0.5) AS INTEGER) AS g, CAST(quantile_disc(b, 0.5) AS INTEGER) AS b, CAST(min(inner_) AS BIGINT) AS "inner" FROM i WHERE inner_ < 16 OR inside GROUP BY ALL""")
def interior_palette(spark, sf_dir):
    return palette.interior_palette(px_rgb(spark, sf_dir).withColumn("label", F.expr("int(r div 64)")))


@query(f"""WITH {GRAY}, h AS (SELECT image_id, CAST(g * 16 // 256 AS INTEGER) AS bar, count(*) AS n FROM gray GROUP BY ALL)
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bar) AS INTEGER) AS rank, bar, n FROM h QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bar) <= 6""")
def dominant_tones(spark, sf_dir):
    return palette.dominant_tones(px_gray(spark, sf_dir))


COARSE = "p AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) - 1 AS INTEGER) AS label, r, g, b, n FROM (SELECT image_id, r // 64 * 64 AS r, g // 64 * 64 AS g, b // 64 * 64 AS b, count(*) AS n FROM rgb GROUP BY ALL))"


@query(f"""WITH {RGB}, {COARSE}, t AS (SELECT m.image_id, m.label, a.label AS a, b.label AS b, b.r - a.r AS dr, b.g - a.g AS dg, b.b - a.b AS db, m.r - a.r AS er, m.g - a.g AS eg, m.b - a.b AS eb
        FROM p m JOIN p a ON m.image_id = a.image_id AND a.n > m.n JOIN p b ON m.image_id = b.image_id AND b.n > m.n AND a.label < b.label),
    u AS (SELECT *, (dr * er + dg * eg + db * eb) / CAST(dr * dr + dg * dg + db * db AS DOUBLE) AS t FROM t)
    SELECT image_id, label, a, b FROM u WHERE t > 0 AND t < 1 AND round(sqrt(pow(er - t * dr, 2) + pow(eg - t * dg, 2) + pow(eb - t * db, 2)), 6) <= 12""")
def mixture_candidates(spark, sf_dir):
    coarse = px_rgb(spark, sf_dir).select("image_id", *[F.expr(f"int({c} div 64) * 64").alias(c) for c in "rgb"])
    return palette.mixture_candidates(palette.quantize_exact(coarse))


# --- layers and outlines

STACK = """cand AS (SELECT *, perimeter >= 0.8e0 * max(perimeter) OVER (PARTITION BY image_id) AND row_number() OVER (PARTITION BY image_id ORDER BY perimeter DESC, label) <= 3 AS near FROM perimeter),
    based AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY CAST(near AS INTEGER) DESC, n DESC, label) = 1 AS INTEGER) AS base FROM cand),
    stack AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY base DESC, n DESC, label) - 1 AS INTEGER) AS place, n, perimeter FROM based)"""


@query(f"WITH {BANDS}, {PERIMETER}, {STACK} SELECT * FROM stack")
def stack_order(spark, sf_dir):
    return layers.stack_order(bands_of(spark, sf_dir))


@query(f"WITH {BANDS}, {PERIMETER}, {STACK} SELECT image_id, layer, count(*) AS n FROM (SELECT m.image_id, unnest(range(0, s.place + 1)) AS layer FROM mask m JOIN stack s ON s.image_id = m.image_id AND s.label = m.m) GROUP BY ALL")
def layer_masks(spark, sf_dir):
    labels = bands_of(spark, sf_dir)
    return layers.layer_masks(labels, layers.stack_order(labels)).groupBy("image_id", F.col("layer").cast("long").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


CRACKS = """nb AS (SELECT *, lag(m) OVER h AS l, lead(m) OVER h AS r, lag(m) OVER v AS u, lead(m) OVER v AS d FROM mask WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)),
    cracks AS (SELECT image_id, x AS ax, y AS ay, x + 1 AS bx, y AS by_ FROM nb WHERE m = 1 AND u IS DISTINCT FROM 1
        UNION ALL SELECT image_id, x + 1, y, x + 1, y + 1 FROM nb WHERE m = 1 AND r IS DISTINCT FROM 1
        UNION ALL SELECT image_id, x + 1, y + 1, x, y + 1 FROM nb WHERE m = 1 AND d IS DISTINCT FROM 1
        UNION ALL SELECT image_id, x, y + 1, x, y FROM nb WHERE m = 1 AND l IS DISTINCT FROM 1)"""


@query(f"WITH {MASK}, {CRACKS} SELECT image_id, ax, ay, bx, by_ AS \"by\" FROM cracks")
def crack_edges(spark, sf_dir):
    return layers.crack_edges(mask_of(spark, sf_dir))


@query(f"WITH {MASK} SELECT image_id, CAST(sum(m) AS DOUBLE) AS area FROM mask GROUP BY image_id HAVING sum(m) > 0")
def ring_area(spark, sf_dir):
    """By Green's theorem the outlines hold as much as there are ink pixels."""
    return layers.outline_area(mask_of(spark, sf_dir)).select("image_id", "area")


@query(f"WITH {MASK}, {CRACKS} SELECT image_id, CAST((SELECT sum(m) FROM mask k WHERE k.image_id = c.image_id) AS DOUBLE) AS area, count(*) AS length FROM cracks c GROUP BY image_id")
def traced_rings(spark, sf_dir):
    """Rings walked one by one, summed up again by image."""
    return curves.rings(layers.crack_edges(mask_of(spark, sf_dir))).groupBy("image_id").agg(F.sum("area").alias("area"), F.sum("length").alias("length"))


@query(None)
def ring_table(spark, sf_dir):
    return curves.rings(layers.crack_edges(mask_of(spark, sf_dir)))


@query(f"""WITH {BANDS}, seg AS (
        SELECT image_id, x AS ax, y AS ay, x AS bx, y + 1 AS by_ FROM (SELECT *, lag(m) OVER h AS o FROM mask WINDOW h AS (PARTITION BY image_id, y ORDER BY x)) WHERE o IS DISTINCT FROM m
        UNION ALL SELECT image_id, x, y, x + 1, y FROM (SELECT *, lag(m) OVER v AS o FROM mask WINDOW v AS (PARTITION BY image_id, x ORDER BY y)) WHERE o IS DISTINCT FROM m
        UNION ALL SELECT image_id, 8, y, 8, y + 1 FROM mask WHERE x = 7 UNION ALL SELECT image_id, x, 8, x + 1, 8 FROM mask WHERE y = 7)
    SELECT image_id, nx, ny, count(*) AS degree FROM (SELECT image_id, ax AS nx, ay AS ny FROM seg UNION ALL SELECT image_id, bx, by_ FROM seg) GROUP BY ALL HAVING count(*) >= 3""")
def node_degree(spark, sf_dir):
    return layers.node_degree(bands_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {MASK}, {components_sql()}, w AS (SELECT *, sum(CASE WHEN m IS NOT DISTINCT FROM o THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, y ORDER BY x) AS crossed FROM (SELECT *, lag(m) OVER (PARTITION BY image_id, y ORDER BY x) AS o FROM comps))
    SELECT image_id, comp, m AS label, CAST(crossed AS BIGINT) AS crossings FROM w WHERE y * 1048576 + x = comp""")
def face_nesting(spark, sf_dir):
    return layers.nesting(mask_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {MASK}, {components_sql()}, {SHAPE} SELECT a.image_id, a.comp AS a, b.comp AS b FROM shape a JOIN shape b ON a.image_id = b.image_id AND a.comp < b.comp AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def box_overlap_pairs(spark, sf_dir):
    return layers.box_overlaps(regions.component_shape(regions.connected_components(mask_of(spark, sf_dir))))


@query(f"WITH {MASK} SELECT image_id, x + 0.5e0 AS px, y + 0.5e0 AS py, m AS inside FROM mask")
def point_in_polygon(spark, sf_dir):
    """Pixel centers against the outlines of the mask: inside is ink."""
    m = mask_of(spark, sf_dir)
    return layers.points_inside(m.select("image_id", (F.col("x") + F.lit(0.5)).alias("px"), (F.col("y") + F.lit(0.5)).alias("py")), layers.crack_edges(m))


@query(f"""WITH {GRAY}, m AS (SELECT image_id, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, g) AS xv, covar_pop(y, g) AS yv, var_pop(g) AS vv, avg(x) AS mx, avg(y) AS my, avg(g) AS mv FROM gray GROUP BY image_id),
    s AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS gx, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS gy FROM m)
    SELECT image_id, round(gx, 6) + 0e0 AS gx, round(gy, 6) + 0e0 AS gy, round(mv - gx * mx - gy * my, 6) + 0e0 AS c, round(CASE WHEN vv > 0 THEN (gx * xv + gy * yv) / vv ELSE 1e0 END, 6) + 0e0 AS r2 FROM s""")
def linear_gradient_fit(spark, sf_dir):
    return curves.linear_gradient(px_gray(spark, sf_dir)).select("image_id", *[rnd(c).alias(c) for c in ("gx", "gy", "c", "r2")])


# --- SVG


def _shapes(spark, sf_dir):
    s = regions.component_shape(regions.connected_components(mask_of(spark, sf_dir)))
    d = F.format_string("M%d %dH%dV%dH%dZ", "x0", "y0", F.col("x1") + 1, F.col("y1") + 1, "x0")
    return s.select("image_id", F.col("comp").alias("place"), d.alias("d"), F.when(F.col("label") == 1, "#000").when(F.col("on_border"), "none").otherwise("#FFFFFF").alias("fill"))


SVG_SHAPES = SHAPE + """, shapes AS (SELECT image_id, comp AS place, printf('M%d %dH%dV%dH%dZ', x0, y0, x1 + 1, y1 + 1, x0) AS d, CASE WHEN label = 1 THEN '#000' WHEN on_border THEN 'none' ELSE '#FFFFFF' END AS fill FROM shape),
    svg AS (SELECT image_id, '<svg xmlns="http://www.w3.org/2000/svg" width="8" height="8" viewBox="0 0 8 8">' || string_agg('<path d="' || d || '" fill="' || fill || '"/>', '' ORDER BY place) || '</svg>' AS svg FROM shapes GROUP BY image_id)"""


@query(f"WITH RECURSIVE {MASK}, {components_sql()}, {SVG_SHAPES} SELECT image_id, svg FROM svg")
def svg_document(spark, sf_dir):
    return svg.document(_shapes(spark, sf_dir), 8, 8)


@query(f"WITH RECURSIVE {MASK}, {components_sql()}, {SVG_SHAPES} SELECT image_id, fill, count(*) AS n, min(place) AS first FROM shapes GROUP BY ALL")
def svg_group_by_color(spark, sf_dir):
    return svg.grouped_by_color(_shapes(spark, sf_dir))


@query(f"""WITH RECURSIVE {MASK}, {components_sql()}, {SVG_SHAPES}, f AS (SELECT image_id, CASE WHEN fill = '#000' THEN '#000000' ELSE lower(fill) END AS c, min(place) AS first FROM shapes WHERE fill <> 'none' GROUP BY ALL)
    SELECT s.image_id, CAST(count(*) AS INTEGER) AS shapes, CAST(count(*) * 4 AS INTEGER) AS nodes, coalesce((SELECT string_agg(c, ',' ORDER BY first) FROM f WHERE f.image_id = s.image_id), '') AS colors, CAST(min(strlen(v.svg)) AS INTEGER) AS bytes
    FROM shapes s JOIN svg v USING (image_id) GROUP BY s.image_id""")
def svg_analyze(spark, sf_dir):
    return svg.analyze(svg.document(_shapes(spark, sf_dir), 8, 8))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<(path|rect|circle|ellipse|line|polyline|polygon)[\\s/>]')) AS INTEGER) AS shapes, CAST(strlen(html) AS INTEGER) AS bytes FROM pages")
def markup_analyze(spark, sf_dir):
    from vellumist.runtime import read_table

    return svg.analyze(read_table(spark, sf_dir, "pages"), "html", "page_id").select("page_id", "shapes", "bytes")


# --- analysis and quality


@query(f"""WITH {RGB}, l AS (SELECT *, CAST(floor((r * 2126 + g * 7152 + b * 722) / 10000e0) AS INTEGER) AS l FROM rgb),
    s AS (SELECT a.image_id, abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) AS d FROM rgb a JOIN rgb b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))),
    t AS (SELECT image_id, count(*) AS sides, count(*) FILTER (d = 0) AS flat, count(*) FILTER (d > 3 AND d <= 72) AS micro, count(*) FILTER (d > 72) AS edges FROM s GROUP BY image_id),
    e AS (SELECT image_id, -sum(n / 64e0 * log2(n / 64e0)) AS entropy FROM (SELECT image_id, l, count(*) AS n FROM l GROUP BY ALL) GROUP BY image_id),
    w AS (SELECT image_id, count(*) AS pixels, least(65536, count(DISTINCT r * 65536 + g * 256 + b)) AS colors, avg(l) AS mean_luma FROM l GROUP BY image_id)
    SELECT image_id, pixels, colors, round(mean_luma, 6) + 0e0 AS mean_luma, sides, flat, micro, edges, round(entropy, 6) + 0e0 AS entropy FROM w JOIN t USING (image_id) JOIN e USING (image_id)""")
def image_analysis(spark, sf_dir):
    return quality.analysis(px_rgb(spark, sf_dir)).withColumns({"mean_luma": rnd("mean_luma"), "entropy": rnd("entropy")})


RENDER = f"{RGB}, pair AS (SELECT *, CAST(r // 32 * 32 + 16 AS INTEGER) AS r2, CAST(g // 32 * 32 + 16 AS INTEGER) AS g2, CAST(b // 32 * 32 + 16 AS INTEGER) AS b2 FROM rgb)"
DELTA = "sqrt(" + " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(oklab_sql("r", "g", "b"), oklab_sql("r2", "g2", "b2"))) + ")"


def _pairs(spark, sf_dir):
    px = px_rgb(spark, sf_dir)
    return quality.paired(px, px.select("image_id", "x", "y", *[F.expr(f"int({c} div 32) * 32 + 16").alias(c) for c in "rgb"]))


@query(f"WITH {RENDER} SELECT image_id, round(avg({DELTA}), 6) + 0e0 AS de FROM pair GROUP BY image_id")
def mean_delta_e(spark, sf_dir):
    return quality.mean_error(_pairs(spark, sf_dir)).withColumn("de", rnd("de"))


@query(f"""WITH {RENDER}, e AS (SELECT DISTINCT a.image_id, a.x, a.y FROM rgb a JOIN rgb b ON a.image_id = b.image_id AND (b.x - a.x = 1 AND b.y = a.y OR b.y - a.y = 1 AND b.x = a.x) AND abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 48),
    band AS (SELECT DISTINCT p.image_id, p.x, p.y FROM rgb p JOIN e ON e.image_id = p.image_id AND abs(e.x - p.x) <= 2 AND abs(e.y - p.y) <= 2)
    SELECT image_id, round(avg({DELTA}), 6) + 0e0 AS de, count(*) AS n FROM pair JOIN band USING (image_id, x, y) GROUP BY image_id""")
def edge_delta_e(spark, sf_dir):
    return quality.edge_error(_pairs(spark, sf_dir)).withColumn("de", rnd("de"))


@query(f"""WITH {RENDER}, h AS (SELECT image_id, CAST(least(1023, floor(round({DELTA} / 0.5e0 * 1024, 6))) AS INTEGER) AS bin, count(*) AS n FROM pair GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS run, sum(n) OVER (PARTITION BY image_id) AS t FROM h) SELECT image_id, min(bin) AS bin FROM r WHERE run >= 0.95e0 * t GROUP BY image_id""")
def p95_delta_e(spark, sf_dir):
    return quality.p95_error(_pairs(spark, sf_dir))


def _gradient_sql(name: str, src: str) -> str:
    return f"""{name}_s AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg({src}) AS v FROM pair GROUP BY ALL),
    {name} AS (SELECT a.image_id, a.x, a.y, sqrt(pow(sum(CASE WHEN b.x < a.x THEN b.v WHEN b.x > a.x THEN -b.v ELSE 0 END) / 3, 2) + pow(sum(CASE WHEN b.y < a.y THEN b.v WHEN b.y > a.y THEN -b.v ELSE 0 END) / 3, 2)) AS {name}
        FROM {name}_s a JOIN {name}_s b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)"""


@query(f"""WITH {RENDER}, {_gradient_sql("ga", "r")}, {_gradient_sql("gb", "r2")}
    SELECT image_id, round(sqrt(greatest(0e0, var_pop((2 * ga * gb + 170) / (ga * ga + gb * gb + 170)))), 6) + 0e0 AS gmsd FROM ga JOIN gb USING (image_id, x, y) GROUP BY image_id""")
def gmsd(spark, sf_dir):
    px = px_rgb(spark, sf_dir)
    a, b = px.select("image_id", "x", "y", F.col("r").cast("double").alias("v")), px.select("image_id", "x", "y", F.expr("double(int(r div 32) * 32 + 16)").alias("v"))
    return quality.gmsd(a, b).withColumn("gmsd", rnd("gmsd"))


@query(f"""WITH {GRAY}, s AS (SELECT a.image_id, a.x, a.y, b.x - a.x AS way, a.g // 64 <> b.g // 64 AS p, a.g // 48 <> b.g // 48 AS q FROM gray a JOIN gray b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)))
    SELECT image_id, count(*) FILTER (p AND q) AS both, count(*) FILTER (p AND NOT q) AS only_a, count(*) FILTER (q AND NOT p) AS only_b FROM s WHERE p OR q GROUP BY image_id""")
def boundary_error(spark, sf_dir):
    g = px_gray(spark, sf_dir)
    return quality.boundary_error(g.select("image_id", "x", "y", F.expr("int(g div 64)").alias("m")), g.select("image_id", "x", "y", F.expr("int(g div 48)").alias("m")))


# --- search

CANDIDATES = """cand AS (SELECT p_brand AS run_id, p_partkey AS id, p_size / 200e0 AS mean_de, (p_partkey % 97) / 200e0 AS p95_de, p_partkey % 613 + 10 AS nodes, p_partkey % 41 + 1 AS paths, CAST(floor(p_retailprice) AS BIGINT) AS bytes, CAST(p_partkey % 31 + 2 AS INTEGER) AS colors,
        ([0.2e0, 0.15e0, 0.15e0, 0.05e0, 0.1e0, 0e0, 0e0])[p_partkey % 7 + 1] * CASE WHEN p_partkey % 2 = 0 THEN 0.5e0 ELSE 1e0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.2e0 ELSE 0e0 END AS dirt, p_partkey % 7 = 5 AS empty FROM part),
    base AS (SELECT run_id, nodes AS bn, bytes AS bb, colors AS bc FROM cand QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY id) = 1),
    u AS (SELECT cand.*, greatest(0e0, least(1e0, 1 - 4 * (0.65e0 * mean_de + 0.35e0 * greatest(mean_de, p95_de)))) AS u_fidelity, 1 / (1 + nodes / CAST(greatest(1, bn) AS DOUBLE)) AS u_nodes, 1 / (1 + bytes / CAST(greatest(1, bb) AS DOUBLE)) AS u_bytes,
        1 / (1 + (colors - 1) / CAST(greatest(1, bc - 1) AS DOUBLE)) AS u_colors, greatest(0e0, least(1e0, 1 - dirt)) AS u_clean FROM cand JOIN base USING (run_id)),
    scored AS (SELECT *, CASE WHEN empty THEN 0e0 ELSE exp((0.5e0 * ln(greatest(1e-4, u_fidelity)) + 0.2e0 * ln(greatest(1e-4, u_nodes)) + 0.2e0 * ln(greatest(1e-4, u_bytes)) + 0.1e0 * ln(greatest(1e-4, u_colors)) + 0.1e0 * ln(greatest(1e-4, u_clean))) / 1.1e0) END AS score FROM u),
    guarded AS (SELECT *, NOT empty AND round(u_fidelity, 9) >= round(floor_ - 1e-9, 9) AS eligible FROM (SELECT *, greatest(0e0, coalesce(max(u_fidelity) FILTER (NOT empty) OVER (PARTITION BY run_id), 0e0) - 0.2e0) AS floor_ FROM scored))"""


def _scored(spark, sf_dir):
    """Candidates scored against the first of their run."""
    c = adapters.candidates(spark, sf_dir)
    first = c.groupBy("run_id").agg(F.min_by(F.struct("nodes", "bytes", "colors"), "id").alias("b")).select("run_id", "b.*")
    return search.utilities(c, first)


UTILITIES = ("u_fidelity", "u_nodes", "u_bytes", "u_colors", "u_clean")


@query(f"WITH {CANDIDATES} SELECT run_id, id, empty, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in (*UTILITIES, "score")) + " FROM scored")
def utility_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("run_id", "id", "empty", *[rnd(c).alias(c) for c in (*UTILITIES, "score")])


@query(f"WITH {CANDIDATES} SELECT run_id, id, round(floor_, 6) + 0e0 AS floor, eligible FROM guarded")
def fidelity_guard(spark, sf_dir):
    return search.fidelity_guard(_scored(spark, sf_dir)).select("run_id", "id", rnd("floor").alias("floor"), "eligible")


@query(f"""WITH {CANDIDATES}, pool AS (SELECT * FROM guarded WHERE eligible) SELECT run_id, id FROM pool a WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.run_id = a.run_id AND b.id <> a.id
    AND b.u_fidelity >= a.u_fidelity - 1e-9 AND b.u_nodes >= a.u_nodes - 1e-9 AND b.u_colors >= a.u_colors - 1e-9 AND (b.u_fidelity > a.u_fidelity + 1e-9 OR b.u_nodes > a.u_nodes + 1e-9 OR b.u_colors > a.u_colors + 1e-9))""")
def pareto_front(spark, sf_dir):
    return search.pareto_front(search.fidelity_guard(_scored(spark, sf_dir)))


@query(f"WITH {CANDIDATES} SELECT run_id, id, round(max(score) OVER (PARTITION BY run_id ORDER BY id), 6) + 0e0 AS best FROM scored")
def best_score_curve(spark, sf_dir):
    return search.best_so_far(_scored(spark, sf_dir)).withColumn("best", rnd("best"))


@query(f"""WITH {CANDIDATES}, l AS (SELECT colors, count(*) AS n, avg(score) AS m FROM scored GROUP BY colors) SELECT round((SELECT sum(n * m * m) - pow(sum(n * m), 2) / sum(n) FROM l) / (SELECT var_pop(score) * count(*) FROM scored), 6) + 0e0 AS eta2""")
def variance_explained(spark, sf_dir):
    return search.variance_explained(_scored(spark, sf_dir), "colors").withColumn("eta2", rnd("eta2"))


@query(f"""WITH {CANDIDATES} SELECT run_id, id, round((row_number() OVER (PARTITION BY run_id ORDER BY md5('0:' || id), id) - 0.5e0) / count(*) OVER (PARTITION BY run_id), 6) + 0e0 AS u0, round((row_number() OVER (PARTITION BY run_id ORDER BY md5('1:' || id), id) - 0.5e0) / count(*) OVER (PARTITION BY run_id), 6) + 0e0 AS u1 FROM cand""")
def latin_hypercube(spark, sf_dir):
    return search.latin_hypercube(adapters.candidates(spark, sf_dir).select("run_id", "id"), 2).select("run_id", "id", rnd("u0").alias("u0"), rnd("u1").alias("u1"))


@query("""WITH r AS (SELECT d.lang AS family, d.doc_id, (n_chars % 1000) / 10000e0 AS a, (n_chars % 1000) / 10000e0 + ((d.doc_id % 11) - 5) * CASE WHEN quality = 1 THEN 0.002e0 ELSE 0.001e0 END AS b FROM documents d JOIN labels USING (doc_id)),
    s AS (SELECT *, CASE WHEN round(abs(b - a), 9) < 0.0005e0 OR round(abs(b - a), 9) < round(0.02e0 * a, 9) THEN 0 WHEN b < a THEN 1 ELSE -1 END AS side FROM r)
    SELECT family, count(*) AS n, round(avg(a), 6) + 0e0 AS de_a, round(avg(b), 6) + 0e0 AS de_b, count(*) FILTER (side = 1) AS wins, count(*) FILTER (side = -1) AS losses, CAST(grouping(family) AS INTEGER) AS total FROM s GROUP BY ROLLUP (family)""")
def ab_verdict_rollup(spark, sf_dir):
    return search.verdict(adapters.reports(spark, sf_dir)).withColumns({"de_a": rnd("de_a"), "de_b": rnd("de_b")})


# --- tiles


def _images(spark, sf_dir):
    return px_gray(spark, sf_dir).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query(f"WITH {GRAY}, t(s) AS (VALUES (0), (3)) SELECT i.image_id, a.s AS tx, b.s AS ty, 5 AS w, 5 AS h FROM (SELECT DISTINCT image_id FROM gray) i, t a, t b")
def tile_plan(spark, sf_dir):
    return tiles.plan(_images(spark, sf_dir), 5, 2)


@query(f"WITH {GRAY} SELECT image_id, x, y, CAST(g AS DOUBLE) AS v FROM gray")
def tile_stitch(spark, sf_dir):
    """Cutting and stitching gives the image back."""
    g = px_gray(spark, sf_dir)
    return tiles.stitch(tiles.cut(g, tiles.plan(_images(spark, sf_dir), 5, 2), side=8)).withColumn("v", rnd("v"))


@query(f"WITH {GRAY} SELECT DISTINCT image_id, 13 AS w, 13 AS h, 0 AS \"left\", 0 AS top FROM gray")
def letterbox(spark, sf_dir):
    return tiles.letterbox(_images(spark, sf_dir), 13)


@query(f"WITH {GRAY}, t AS (SELECT *, greatest(0e0, least(1e0, (g - 64) / 128e0)) AS t FROM gray) SELECT image_id, x, y, CAST(floor(t * t * (3 - 2 * t) * 255 + 0.5e0) AS INTEGER) AS a FROM t")
def alpha_matte(spark, sf_dir):
    return tiles.matte(px_gray(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRAY}, {OTSU}, mask AS (SELECT image_id, x, y, CAST(g < bin + 1 AS INTEGER) AS m FROM gray JOIN otsu USING (image_id)), {components_sql()}, s AS (SELECT image_id, comp, count(*) AS area FROM comps WHERE m = 1 GROUP BY ALL)
    SELECT image_id, comp, area, CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp) AS INTEGER) AS rank FROM s""")
def flagship(spark, sf_dir):
    """Gray images to ink by Otsu, to components, ranked by area."""
    from pyspark.sql import Window

    ink = regions.component_shape(regions.connected_components(raster.otsu_binarize(px_gray(spark, sf_dir)))).filter("label = 1")
    return ink.select("image_id", "comp", "area", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "comp")).alias("rank"))


# --- settings and whole pipelines


@query("""WITH s AS (SELECT event_id, user_id % 90 - 10 AS k, value, event_type FROM events)
    SELECT event_id, CAST(greatest(2, least(64, k)) AS INTEGER) AS paletteSize, CASE WHEN value IS NULL THEN 128 ELSE CAST(greatest(0, least(255, floor(value + 0.5e0))) AS INTEGER) END AS threshold,
        CASE WHEN value IS NULL THEN 0.75e0 ELSE round(greatest(0e0, least(1e0, value / 100)), 6) END AS smoothing, CASE WHEN k = 0 THEN 0 ELSE CAST(greatest(64, least(8192, k * 50)) AS INTEGER) END AS maxDimension,
        k % 2 = 0 AS invert, CASE k % 3 WHEN 0 THEN 'median' ELSE 'none' END AS denoise FROM s""")
def settings_normalize(spark, sf_dir):
    from vellumist.functions import settings
    from vellumist.runtime import read_table

    e = read_table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 90 - 10)
    doc = F.to_json(F.struct(F.col("k").alias("paletteSize"), F.col("value").alias("threshold"), (F.col("value") / 100).alias("smoothing"), (F.col("k") * 50).alias("maxDimension"), (F.col("k") % 2 == 0).alias("invert"), F.when(F.col("k") % 3 == 0, "median").otherwise("other").alias("denoise"), F.lit(1).alias("unknown")))
    out = settings.normalize(e.select("event_id", doc.alias("settings")), keep=("event_id",))
    return out.select("event_id", "paletteSize", "threshold", rnd("smoothing").alias("smoothing"), "maxDimension", "invert", "denoise")


@query(None)
def ink_pipeline(spark, sf_dir):
    from vellumist.plans import pipelines

    return pipelines.ink(px_gray(spark, sf_dir), 8, 8)


@query(None)
def centerline_pipeline(spark, sf_dir):
    from vellumist.plans import pipelines

    return pipelines.centerline(px_gray(spark, sf_dir))


@query(None)
def color_pipeline(spark, sf_dir):
    from vellumist.plans import pipelines

    return pipelines.color_layers(px_rgb(spark, sf_dir), PALETTE, 8, 8)


from vellumist.plans import shapes  # noqa: E402, F401  registers its queries; it takes the building blocks above
