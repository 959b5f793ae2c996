"""Queries over curves, paths, fills, roots and fields, with their SQL oracles.

Each vector of 64 numbers is eight cubics here: eight numbers in turn are the coordinates of four control points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumist.functions import color, fills, geometry, numeric, paths
from vellumist.operators import raster
from vellumist.plans.registry import GRAY, LINES, RGB, lin, oklab_sql, query, rnd
from vellumist.runtime import read_table
from vellumist.sources import adapters
from vellumist.sources.adapters import px_gray, px_rgb

POINTS = [f"{c}{i}" for i in range(4) for c in "xy"]
CUBICS = "cub AS (SELECT vec_id AS image_id, CAST(k AS INTEGER) AS k, " + ", ".join(f"32 + 64 * CAST(embedding[8 * k + {i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(POINTS)) + " FROM embeddings, range(0, 8) t(k))"


def cubics(spark, sf_dir) -> DataFrame:
    """image_id, k, x0, y0 to x3, y3."""
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return v.select("image_id", "k", *[(32 + 64 * F.get("embedding", 8 * F.col("k") + i).cast("double")).alias(c) for i, c in enumerate(POINTS)])


def outs(df: DataFrame, keys: list[str], **values) -> DataFrame:
    return df.select(*keys, *[rnd(v).alias(n) for n, v in values.items()])


def rounds(**values: str) -> str:
    return ", ".join(f"round({v}, 6) + 0e0 AS {n}" for n, v in values.items())


# --- cubics

AT = "pow(1 - t, 3) * {0}0 + 3 * pow(1 - t, 2) * t * {0}1 + 3 * (1 - t) * t * t * {0}2 + t * t * t * {0}3"
ALONG = "3 * pow(1 - t, 2) * ({0}1 - {0}0) + 6 * (1 - t) * t * ({0}2 - {0}1) + 3 * t * t * ({0}3 - {0}2)"


@query(f"""WITH {CUBICS}, p AS (SELECT image_id, k, t, {AT.format("x")} AS px, {AT.format("y")} AS py, {ALONG.format("x")} AS tx, {ALONG.format("y")} AS ty FROM cub, (VALUES (0.25e0), (0.5e0), (0.75e0)) v(t))
    SELECT image_id, k, t, {rounds(px="px", py="py", tx="tx", ty="ty", ux="tx / sqrt(tx * tx + ty * ty)", uy="ty / sqrt(tx * tx + ty * ty)")} FROM p""")
def cubic_points(spark, sf_dir):
    """Points, tangents and directions of cubics."""
    b = cubics(spark, sf_dir).withColumn("t", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    at, way = paths.cubic_at(paths.cubic_columns(), F.col("t")), paths.cubic_tangent(paths.cubic_columns(), F.col("t"))
    one = paths.unit(*way)
    return outs(b, ["image_id", "k", "t"], px=at[0], py=at[1], tx=way[0], ty=way[1], ux=one["x"], uy=one["y"])


@query("SELECT t, " + rounds(b0="pow(1 - t, 3)", b1="3 * pow(1 - t, 2) * t", b2="3 * (1 - t) * t * t", b3="pow(t, 3)", total="1e0") + " FROM (SELECT range / 16e0 AS t FROM range(0, 17))")
def bernstein_weights(spark, sf_dir):
    w = paths.bernstein(F.col("t"))
    return outs(spark.range(17).select((F.col("id") / 16.0).alias("t")), ["t"], **{f"b{i}": x for i, x in enumerate(w)}, total=w[0] + w[1] + w[2] + w[3])


MEASURES = f"""{CUBICS}, m AS (SELECT *, pow(x3 - x0, 2) + pow(y3 - y0, 2) AS chord,
    (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) AS c0, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) AS c1,
    x2 - 2 * x1 + x0 AS ax, y2 - 2 * y1 + y0 AS ay, x3 - 2 * x2 + x1 AS bx, y3 - 2 * y2 + y1 AS by_,
    3 * x1 - 3 * x2 + x3 - x0 AS qx, 3 * y1 - 3 * y2 + y3 - y0 AS qy, 3 * (x0 - 2 * x1 + x2) AS rx, 3 * (y0 - 2 * y1 + y2) AS ry, 3 * (x1 - x0) AS sx, 3 * (y1 - y0) AS sy FROM cub),
    n AS (SELECT *, c0 * c1 < -1e-6 * greatest(chord, 1) AS bends, CASE WHEN chord <= 1e-12 THEN 0 ELSE 12 * (ax * ax + ay * ay + ax * bx + ay * by_ + bx * bx + by_ * by_) / chord END AS energy, qx * ry - qy * rx AS det FROM m),
    d AS (SELECT *, (sy * rx - sx * ry) / det AS w, (sx * qy - sy * qx) / det AS u FROM n),
    e AS (SELECT *, u * u - 4 * (u * u - w) AS disc FROM d), f AS (SELECT *, (u - sqrt(greatest(disc, 0))) / 2 AS lo, (u + sqrt(greatest(disc, 0))) / 2 AS hi FROM e)"""


@query(f"""WITH {MEASURES} SELECT image_id, k, bends, {rounds(energy="energy", wobble="CASE WHEN bends THEN 4e0 ELSE 0e0 END + CASE WHEN energy > 2.5e0 THEN least(energy - 2.5e0, 10e0) ELSE 0e0 END")},
    abs(det) >= 1e-12 AND disc > 0 AND lo > 1e-9 AND hi < 1 - 1e-9 AND lo < 1 - 1e-9 AND hi > 1e-9 AND hi - lo > 1e-9 AS loops FROM f""")
def cubic_measures(spark, sf_dir):
    """Inflection, bending, the penalty of both at a price of 2, and self-crossing."""
    b = paths.cubic_columns()
    df = cubics(spark, sf_dir).select("image_id", "k", paths.has_inflection(b).alias("bends"), paths.bending_energy(b).alias("energy"), paths.wobble_penalty(b, 2.0).alias("wobble"), paths.self_intersects(b).alias("loops"))
    return df.withColumns({"energy": rnd("energy"), "wobble": rnd("wobble")})


# --- arcs

ARCS = f"""{CUBICS}, h AS (SELECT image_id, k, x0, y0, x3, y3, abs(x1) AS rx, abs(y1) AS ry, radians(x2) AS phi, y2 > 32 AS large, k % 2 = 0 AS sweep, (x0 - x3) / 2 AS hx, (y0 - y3) / 2 AS hy FROM cub),
    r AS (SELECT *, cos(phi) * hx + sin(phi) * hy AS px, cos(phi) * hy - sin(phi) * hx AS py FROM h),
    g AS (SELECT *, rx * sqrt(greatest(1, px * px / (rx * rx) + py * py / (ry * ry))) AS gx, ry * sqrt(greatest(1, px * px / (rx * rx) + py * py / (ry * ry))) AS gy FROM r),
    q AS (SELECT *, CASE WHEN large = sweep THEN -1 ELSE 1 END * sqrt(greatest(gx * gx * gy * gy - gx * gx * py * py - gy * gy * px * px, 0) / (gx * gx * py * py + gy * gy * px * px)) AS c FROM g),
    z AS (SELECT *, c * gx * py / gy AS qx, -c * gy * px / gx AS qy FROM q), th AS (SELECT *, atan2((py - qy) / gy, (px - qx) / gx) AS t1, atan2((-py - qy) / gy, (-px - qx) / gx) AS t2 FROM z),
    a AS (SELECT *, cos(phi) * qx - sin(phi) * qy + (x0 + x3) / 2 AS cx, sin(phi) * qx + cos(phi) * qy + (y0 + y3) / 2 AS cy, CASE WHEN NOT sweep AND t2 > t1 THEN t2 - t1 - 2 * pi() WHEN sweep AND t2 < t1 THEN t2 - t1 + 2 * pi() ELSE t2 - t1 END AS delta FROM th)"""


@query(f"""WITH {ARCS} SELECT image_id, k, {rounds(cx="cx", cy="cy", rx="gx", ry="gy", theta="t1", delta="delta", span="abs(greatest(gx, gy) * delta)", mx="cx + cos(phi) * gx * cos(t1 + delta / 2) - sin(phi) * gy * sin(t1 + delta / 2)",
    my="cy + sin(phi) * gx * cos(t1 + delta / 2) + cos(phi) * gy * sin(t1 + delta / 2)", ex="x3", axis="phi - pi() * ceil(phi / pi() - 0.5e0)")} FROM a""")
def arc_frames(spark, sf_dir):
    """Arcs from end points to centers, their middles, lengths and where they end again."""
    c = cubics(spark, sf_dir).select("image_id", "k", "x0", "y0", F.col("x1").alias("rx"), F.col("y1").alias("ry"), F.radians("x2").alias("phi"), (F.col("y2") > 32).alias("large"), (F.col("k") % 2 == 0).alias("sweep"), "x3", "y3")
    c = paths.with_arc_frame(c, ("x0", "y0", "rx", "ry", "phi", "large", "sweep", "x3", "y3"))
    f, phi = F.col("frame"), F.col("phi")
    middle, end = paths.arc_point(f, phi, f["theta1"] + f["delta"] / 2), paths.arc_point(f, phi, f["theta1"] + f["delta"])
    return outs(c, ["image_id", "k"], cx=f["cx"], cy=f["cy"], rx=f["rx"], ry=f["ry"], theta=f["theta1"], delta=f["delta"], span=paths.arc_span(f), mx=middle[0], my=middle[1], ex=end[0], axis=paths.canonical_angle(phi))


# --- paths

PATH = """cmd AS (SELECT image_id, k, 0 AS seq, 'M' AS type, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2, x0 AS x, y0 AS y, NULL::DOUBLE AS rx, NULL::BOOLEAN AS sweep FROM cub
    UNION ALL SELECT image_id, k, 1, 'L', NULL, NULL, NULL, NULL, x1, y1, NULL, NULL FROM cub UNION ALL SELECT image_id, k, 2, 'C', y1, x2, y2, x3, x2, y2, NULL, NULL FROM cub
    UNION ALL SELECT image_id, k, 3, 'A', NULL, NULL, NULL, NULL, x3, y3, abs(y0) + 1, k % 2 = 0 FROM cub UNION ALL SELECT image_id, k, 4, 'Q', y3, x3, NULL, NULL, y0, x0, NULL, NULL FROM cub
    UNION ALL SELECT image_id, k, 5, 'Z', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cub)"""
COORDS = ("x1", "y1", "x2", "y2", "x", "y", "rx")


def drawn(spark, sf_dir) -> DataFrame:
    """image_id, k, path: a move, a line, a cubic, an arc, a quadratic and a close for each cubic."""
    x, y = ([F.col(f"{c}{i}") for i in range(4)] for c in "xy")
    steps = [
        paths.move_to(x[0], y[0]), paths.line_to(x[1], y[1]), paths.cubic_to(y[1], x[2], y[2], x[3], x[2], y[2]),
        F.when(F.col("k") < 4, paths.circular_arc(F.abs(y[0]) + 1, F.lit(False), F.col("k") % 2 == 0, x[3], y[3])).otherwise(paths.elliptical_arc(F.abs(y[0]) + 1, F.abs(y[0]) + 2, F.lit(0.5), F.lit(True), F.col("k") % 2 == 0, x[3], y[3])),
        paths.quad_to(y[3], x[3], y[0], x[0]), paths.close(),
    ]
    return cubics(spark, sf_dir).select("image_id", "k", F.array(*steps).alias("path"))


def spelled(df: DataFrame) -> DataFrame:
    """A row for each command."""
    flat = df.select("image_id", "k", F.posexplode("path").alias("seq", "c")).select("image_id", "k", "seq", "c.*")
    return flat.select("image_id", "k", "seq", "type", *[rnd(c).alias(c) for c in COORDS], F.coalesce("sweep", F.lit(False)).alias("sweep"))


def spelled_sql(**changed: str) -> str:
    return ", ".join(f"round({changed.get(c, c)}, 6) + 0e0 AS {c}" for c in COORDS)


@query(f"WITH {CUBICS}, {PATH} SELECT image_id, k, CAST(seq AS INTEGER) AS seq, type, {spelled_sql(x1='x1 * 1.5e0 + 3', y1='y1 * 1.5e0 - 2', x2='x2 * 1.5e0 + 3', y2='y2 * 1.5e0 - 2', x='x * 1.5e0 + 3', y='y * 1.5e0 - 2', rx='rx * 1.5e0')}, coalesce(sweep, false) AS sweep FROM cmd")
def path_place(spark, sf_dir):
    return spelled(drawn(spark, sf_dir).withColumn("path", paths.place(F.col("path"), F.lit(1.5), F.lit(3.0), F.lit(-2.0))))


@query(f"""WITH {CUBICS}, {PATH}, p AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM cmd WHERE type <> 'Z' WINDOW w AS (PARTITION BY image_id, k ORDER BY seq)),
    b AS (SELECT image_id, k, 5 - seq AS seq, type, CASE WHEN type = 'C' THEN x2 ELSE x1 END AS x1, CASE WHEN type = 'C' THEN y2 ELSE y1 END AS y1, CASE WHEN type = 'C' THEN x1 END AS x2, CASE WHEN type = 'C' THEN y1 END AS y2, bx AS x, by_ AS y, rx, NOT sweep AS sweep FROM p WHERE seq > 0
        UNION ALL SELECT image_id, k, 0, 'M', NULL, NULL, NULL, NULL, x, y, NULL, NULL FROM cmd WHERE seq = 4 UNION ALL SELECT * FROM cmd WHERE type = 'Z')
    SELECT image_id, k, CAST(seq AS INTEGER) AS seq, type, {spelled_sql()}, coalesce(sweep, false) AS sweep FROM b""")
def path_reverse(spark, sf_dir):
    return spelled(drawn(spark, sf_dir).withColumn("path", paths.reverse(F.col("path"))))


@query(f"""WITH {CUBICS}, {PATH} SELECT image_id, k, CAST(seq AS INTEGER) AS seq, type, {spelled_sql(x="CASE WHEN seq = 4 THEN 7e0 ELSE x END", y="CASE WHEN seq = 4 THEN 9e0 ELSE y END")}, coalesce(sweep, false) AS sweep FROM cmd""")
def path_pin_end(spark, sf_dir):
    return spelled(drawn(spark, sf_dir).withColumn("path", paths.pin_end(F.col("path"), F.lit(7.0), F.lit(9.0))))


@query(f"WITH {CUBICS} SELECT image_id, k, 5 AS nodes, CAST(2 + 2 + 6 + CASE WHEN k < 4 THEN 5 ELSE 7 END AS INTEGER) AS numbers, round(y0, 6) + 0e0 AS ex, round(x0, 6) + 0e0 AS ey FROM cub")
def path_numbers(spark, sf_dir):
    """Anchor points, editable numbers and ends of paths."""
    p = F.col("path")
    end = paths.path_end(p)
    return drawn(spark, sf_dir).select("image_id", "k", paths.node_count(p).alias("nodes"), paths.path_numbers(p).cast("int").alias("numbers"), rnd(end["x"]).alias("ex"), rnd(end["y"]).alias("ey"))


# --- roots, numbers, spans

QUADRATIC = f"""{CUBICS}, q AS (SELECT image_id, k, x0 - 32 AS c0, x1 - 32 AS c1, CASE WHEN k = 7 THEN 0e0 ELSE x2 - 32 END AS c2 FROM cub), d AS (SELECT *, c1 * c1 - 4 * c0 * c2 AS disc FROM q),
    r AS (SELECT *, CASE WHEN c2 = 0 THEN -c0 / c1 WHEN disc >= 0 THEN least((-c1 - sqrt(disc)) / (2 * c2), (-c1 + sqrt(disc)) / (2 * c2)) END AS lo, CASE WHEN c2 <> 0 AND disc > 0 THEN greatest((-c1 - sqrt(disc)) / (2 * c2), (-c1 + sqrt(disc)) / (2 * c2)) END AS hi FROM d)"""


@query(f"""WITH {QUADRATIC} SELECT image_id, k, round(lo, 3) + 0e0 AS lo, round(hi, 3) + 0e0 AS hi, round(coalesce(c0 + c1 * 0.5e0 + c2 * 0.25e0, 0), 6) + 0e0 AS half FROM r WHERE abs(c1) > 0.5e0 AND abs(coalesce(lo, 0)) < 1e3 AND abs(coalesce(hi, 0)) < 1e3""")
def quadratic_roots(spark, sf_dir):
    c = cubics(spark, sf_dir).select("image_id", "k", (F.col("x0") - 32).alias("c0"), (F.col("x1") - 32).alias("c1"), F.when(F.col("k") == 7, 0.0).otherwise(F.col("x2") - 32).alias("c2"))
    c = c.withColumn("r", numeric.quadratic_roots(F.col("c0"), F.col("c1"), F.col("c2"))).withColumns({"lo": F.get("r", 0), "hi": F.get("r", 1)})
    near = (F.abs("c1") > 0.5) & (F.abs(F.coalesce("lo", F.lit(0.0))) < 1e3) & (F.abs(F.coalesce("hi", F.lit(0.0))) < 1e3)
    half = numeric.poly([F.col("c0"), F.col("c1"), F.col("c2")], F.lit(0.5))
    return c.filter(near).select("image_id", "k", rnd("lo", 3).alias("lo"), rnd("hi", 3).alias("hi"), rnd(half).alias("half"))


W32 = 4294967296


def times32(a: str, b: str) -> str:
    return f"CAST((({a})::HUGEINT * ({b})::HUGEINT) % {W32} AS BIGINT)"


@query(f"""WITH s AS (SELECT p_partkey AS seed, n, (p_partkey + {times32("n", "1831565813")}) % {W32} AS a FROM part, range(1, 5) t(n)),
    t AS (SELECT *, {times32("xor(a, a >> 15)", "a | 1")} AS t FROM s), u AS (SELECT *, xor((t + {times32("xor(t, t >> 7)", "t | 61")}) % {W32}, t) AS u FROM t)
    SELECT seed, CAST(n AS INTEGER) AS n, xor(u, u >> 14) / {W32}e0 AS value FROM u""")
def seeded_random(spark, sf_dir):
    """The first four numbers of a generator for each seed, each by itself."""
    seeds = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    return seeds.select("seed", "n", numeric.mulberry32(F.col("seed"), F.col("n")).alias("value"))


@query("""WITH s AS (SELECT p_partkey, p_size * 120 AS w, p_size * 90 AS h, CAST(p_partkey % 3 * 1024 AS INTEGER) AS most, CAST(p_partkey % 5 AS INTEGER) AS asked FROM part),
    f AS (SELECT *, CASE WHEN most > 0 AND w > most THEN most / CAST(w AS DOUBLE) ELSE 1e0 END AS fit FROM s),
    k AS (SELECT p_partkey, max(k) AS k FROM f, range(1, 9) t(k) WHERE k <= asked AND (k = 1 OR greatest(1, floor(w * fit + 0.5e0)) * greatest(1, floor(h * fit + 0.5e0)) * k * k <= 16777216) GROUP BY ALL)
    SELECT s.p_partkey, CAST(CASE WHEN asked <= 1 THEN asked ELSE k.k END AS INTEGER) AS factor, round(CASE WHEN w > 0 THEN CASE WHEN most > 0 THEN most ELSE w / 96e0 * 25.4e0 END / w ELSE 0 END, 9) + 0e0 AS mm FROM s LEFT JOIN k USING (p_partkey)""")
def output_scale(spark, sf_dir):
    """Supersampling within the pixel budget, and millimeters a pixel."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 120).alias("w"), (F.col("p_size") * 90).alias("h"), (F.col("p_partkey") % 3 * 1024).cast("int").alias("most"), (F.col("p_partkey") % 5).cast("int").alias("asked"))
    return p.select("p_partkey", numeric.supersample_factor(F.col("w"), F.col("h"), F.col("most"), F.col("asked")).cast("int").alias("factor"), rnd(numeric.mm_per_px(F.col("w"), F.col("most")), 9).alias("mm"))


SPANS = f"""{LINES}, run AS (SELECT line_id, seq, px, py, lag(px, 7) OVER l AS ax, lag(py, 7) OVER l AS ay, count(*) OVER w AS n, avg(px) OVER w AS cx, avg(py) OVER w AS cy, var_pop(px) OVER w AS vx, var_pop(py) OVER w AS vy, covar_pop(px, py) OVER w AS vxy FROM p
        WINDOW l AS (PARTITION BY line_id ORDER BY seq), w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, sqrt(greatest(0, pow(vx - vy, 2) + 4 * vxy * vxy)) AS spread, px - ax AS ex, py - ay AS ey, (ax + px) / 2 - cx AS mx, (ay + py) / 2 - cy AS my FROM run WHERE n = 8),
    dir AS (SELECT *, (vx + vy + spread) / 2 AS top FROM f), d AS (SELECT *, CASE WHEN abs(vx - top) >= abs(vy - top) THEN -vxy ELSE vy - top END AS dx, CASE WHEN abs(vx - top) >= abs(vy - top) THEN vx - top ELSE -vxy END AS dy FROM dir)"""


@query(f"""WITH {SPANS} SELECT line_id, CAST(seq AS INTEGER) AS seq, round(sqrt(greatest(0, ey * ey * (vx + mx * mx) - 2 * ex * ey * (vxy + mx * my) + ex * ex * (vy + my * my))), 4) + 0e0 AS chord, round(8 * cx, 3) + 0e0 AS sx, round(8 * cy, 3) + 0e0 AS sy,
    round(abs(dx * dy) / (dx * dx + dy * dy), 4) + 0e0 AS slant, round(pow(dy * (px - cx) - dx * (py - cy), 2) / (dx * dx + dy * dy), 4) + 0e0 AS square, round(8 * greatest(0, (vx + vy - spread) / 2), 4) + 0e0 AS scatter FROM d""")
def span_forms(spark, sf_dir):
    """Chord penalty, best line, its quadratic form and scatter of every run of eight points."""
    df = numeric.span_forms(adapters.polyline(spark, sf_dir))
    return df.select("line_id", F.col("seq").cast("int").alias("seq"), rnd(8 * F.col("cx"), 3).alias("sx"), rnd(8 * F.col("cy"), 3).alias("sy"), *[rnd(c, 4).alias(c) for c in ("chord", "slant", "square", "scatter")])


@query(f"""WITH {LINES}, c AS (SELECT line_id, avg(px) AS cx, avg(py) AS cy, max(py) - min(py) AS r FROM p GROUP BY line_id), a AS (SELECT line_id, seq, atan2(py - cy, px - cx) AS way, pow(sqrt(pow(px - cx, 2) + pow(py - cy, 2)) - r, 2) / pow(0.25e0 + seq % 3, 2) AS part FROM p JOIN c USING (line_id)),
    s AS (SELECT *, way - lag(way) OVER (PARTITION BY line_id ORDER BY seq) AS step FROM a)
    SELECT line_id, round(sum(part), 3) + 0e0 AS chi2, round(coalesce(sum(CASE WHEN step > pi() THEN step - 2 * pi() WHEN step < -pi() THEN step + 2 * pi() ELSE step END), 0), 6) + 0e0 AS sweep FROM s GROUP BY line_id""")
def circle_error(spark, sf_dir):
    """Weighted distance of lines to a circle about their mean, and how far they go round it."""
    p = adapters.polyline(spark, sf_dir)
    c = p.groupBy("line_id").agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"), (F.max("py") - F.min("py")).alias("r"))
    return numeric.circle_error(p, c, 0.25 + F.col("seq") % 3).select("line_id", rnd("chi2", 3).alias("chi2"), rnd("sweep").alias("sweep"))


TURNS = f"""{LINES}, v AS (SELECT line_id, seq, px - lag(px) OVER w AS ax, py - lag(py) OVER w AS ay, lead(px) OVER w - px AS bx, lead(py) OVER w - py AS by_ FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    t AS (SELECT *, acos(greatest(-1e0, least(1e0, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))))) AS turn FROM v WHERE ax IS NOT NULL AND bx IS NOT NULL)"""


@query(f"WITH {TURNS} SELECT line_id, CAST(seq AS INTEGER) AS seq, round(turn, 5) + 0e0 AS turn, round(2 * least(pow(turn / (10 * pi() / 180), 2), 1), 5) + 0e0 AS cost FROM t")
def break_costs(spark, sf_dir):
    """Turns of lines at their points and what they cost at a price of 2."""
    w = geometry.in_order("line_id")
    steps = [F.col(c) - F.lag(c).over(w) for c in ("px", "py")] + [F.lead(c).over(w) - F.col(c) for c in ("px", "py")]
    df = adapters.polyline(spark, sf_dir).select("line_id", "seq", *[s.alias(n) for s, n in zip(steps, ("ax", "ay", "bx", "by"))]).filter("ax is not null and bx is not null")
    turn = numeric.turn_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return df.select("line_id", F.col("seq").cast("int").alias("seq"), rnd(turn, 5).alias("turn"), rnd(numeric.break_cost(turn, 2.0), 5).alias("cost"))


@query(f"""WITH {CUBICS}, q AS (SELECT image_id, k, abs(cos(k / 4e0) * (x0 - 32) + sin(k / 4e0) * (y0 - 32)) - 8 AS qx, abs(cos(k / 4e0) * (y0 - 32) - sin(k / 4e0) * (x0 - 32)) - 4 AS qy FROM cub)
    SELECT image_id, k, {rounds(d="sqrt(pow(greatest(qx, 0e0), 2) + pow(greatest(qy, 0e0), 2)) + least(greatest(qx, qy), 0e0) - 2")} FROM q""")
def round_rect_distance(spark, sf_dir):
    d = numeric.round_rect_distance(F.col("x0"), F.col("y0"), F.lit(32.0), F.lit(32.0), F.lit(10.0), F.lit(6.0), F.lit(2.0), F.col("k") / 4.0)
    return outs(cubics(spark, sf_dir), ["image_id", "k"], d=d)


# --- coverage and fields


@query(f"""WITH {RGB}, u AS (SELECT *, greatest(0e0, least(1e0, ((r / 255e0 - 0.1e0) * 0.8e0 + (g / 255e0 - 0.2e0) * 0.6e0 + (b / 255e0 - 0.3e0) * -0.2e0) / (0.64e0 + 0.36e0 + 0.04e0))) AS a FROM rgb), f AS (SELECT *, CASE WHEN a >= 0.5e0 THEN a ELSE 1 - a END AS hi FROM u),
    o AS (SELECT *, CASE WHEN hi - 0.5e0 <= 0.5e0 * (0.9e0 - 0.4e0) / 0.9e0 THEN (hi - 0.5e0) * 0.9e0 ELSE 0.65e0 - sqrt(greatest(0.72e0 * (1 - hi), 0)) END AS d FROM f)
    SELECT image_id, x, y, {rounds(a="a", d="CASE WHEN a >= 0.5e0 THEN d ELSE -d END", sigma="least(greatest(sqrt(pow(CASE WHEN a <= 1e-6 THEN 4e0 ELSE 0.02e0 / a END, 2) + 0.0025e0), 1e-3), 4e0)")} FROM o""")
def edge_positions(spark, sf_dir):
    """Coverage of pixels between two colors, the edge's offset and its uncertainty."""
    p = [F.col(c) / 255.0 for c in "rgb"]
    px = px_rgb(spark, sf_dir).withColumn("a", numeric.unmix_coverage(p, [F.lit(v) for v in (0.9, 0.8, 0.1)], [F.lit(v) for v in (0.1, 0.2, 0.3)]))
    return outs(px, ["image_id", "x", "y"], a=F.col("a"), d=numeric.edge_offset(F.col("a"), F.lit(0.9), F.lit(0.4)), sigma=numeric.position_sigma(F.lit(0.02), F.col("a")))


@query(f"WITH {GRAY} SELECT image_id, x, y, {rounds(f='(g / 255e0 - 100 / 255e0) * CASE WHEN g > 100 THEN 0.5e0 / (1 - 100 / 255e0) ELSE 0.5e0 / (100 / 255e0) END')} FROM gray")
def alpha_field(spark, sf_dir):
    return outs(px_gray(spark, sf_dir), ["image_id", "x", "y"], f=numeric.alpha_field(F.col("g"), 100))


@query(f"WITH s AS (SELECT range / 64e0 - 0.25e0 AS l_ FROM range(0, 128)), c AS (SELECT l_, pow(greatest(0e0, least(1e0, l_)), 3) AS v FROM s) SELECT l_, {rounds(v='CASE WHEN v <= 0.0031308e0 THEN v * 12.92e0 ELSE 1.055e0 * pow(v, 1 / 2.4e0) - 0.055e0 END')} FROM c")
def encoded_lightness(spark, sf_dir):
    return outs(spark.range(128).select((F.col("id") / 64.0 - 0.25).alias("l_")), ["l_"], v=numeric.encoded_of_lightness(F.col("l_")))


@query(f"""WITH {RGB}, o AS (SELECT DISTINCT r, g, b FROM rgb) SELECT r, g, b, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS hex FROM o""")
def oklab_to_hex(spark, sf_dir):
    """Colors to Oklab and to hex text."""
    px = color.with_rgb(color.with_oklab(px_rgb(spark, sf_dir).select("r", "g", "b").distinct()), to=("r2", "g2", "b2"))
    return px.select("r", "g", "b", color.hex_format(F.col("r2"), F.col("g2"), F.col("b2")).alias("hex"))


@query(f"""WITH {GRAY}, s AS (SELECT a.image_id, a.x, a.y, a.g, sum(b.g) / CAST(count(*) AS DOUBLE) / 255e0 AS m FROM gray a JOIN gray b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL)
    SELECT image_id, x, y, {rounds(f="(m - 0.05e0 - g / 255e0) * CASE WHEN m - 0.05e0 > g / 255e0 THEN 0.5e0 / greatest(m - 0.05e0, 1e-6) ELSE 0.5e0 / greatest(1e0 - (m - 0.05e0), 1e-6) END")} FROM s""")
def signed_adaptive_field(spark, sf_dir):
    return raster.signed_adaptive_field(px_gray(spark, sf_dir), 2, 0.05).withColumn("f", rnd("f"))


@query(f"""WITH {RGB}, s AS (SELECT DISTINCT image_id FROM rgb), p AS (SELECT image_id, CAST(i % 12 AS INTEGER) AS x, CAST(i // 12 AS INTEGER) AS y FROM s, range(0, 144) t(i))
    SELECT p.image_id, p.x, p.y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a FROM p LEFT JOIN rgb ON rgb.image_id = p.image_id AND rgb.x = p.x - 2 AND rgb.y = p.y - 2""")
def pad_image(spark, sf_dir):
    return raster.pad(px_rgb(spark, sf_dir).withColumn("a", F.lit(255)), 2)


def cubic_weights(u: float) -> list[float]:
    return [(-u + 2 * u**2 - u**3) / 2, (2 - 5 * u**2 + 3 * u**3) / 2, (u + 4 * u**2 - 3 * u**3) / 2, (u**3 - u**2) / 2]


TAPS = "taps(r, t, w) AS (VALUES " + ", ".join(f"({r}, {t + (0 if r else -1) - 1}, {w!r}::DOUBLE)" for r, u in ((0, 0.75), (1, 0.25)) for t, w in enumerate(cubic_weights(u))) + ")"


@query(f"""WITH {GRAY}, {TAPS}, h AS (SELECT a.image_id, a.x * 2 + r AS x, a.y, sum(w * b.g) AS v, min(b.g) FILTER (t - CASE WHEN r = 0 THEN -1 ELSE 0 END IN (0, 1)) AS lo, max(b.g) FILTER (t - CASE WHEN r = 0 THEN -1 ELSE 0 END IN (0, 1)) AS hi
        FROM gray a CROSS JOIN taps JOIN gray b ON b.image_id = a.image_id AND b.y = a.y AND b.x = greatest(0, least(7, a.x + t)) GROUP BY a.image_id, a.x, a.y, r), hc AS (SELECT image_id, x, y, greatest(lo, least(hi, v)) AS g FROM h),
    v AS (SELECT a.image_id, a.x, a.y * 2 + r AS y, sum(w * b.g) AS v, min(b.g) FILTER (t - CASE WHEN r = 0 THEN -1 ELSE 0 END IN (0, 1)) AS lo, max(b.g) FILTER (t - CASE WHEN r = 0 THEN -1 ELSE 0 END IN (0, 1)) AS hi
        FROM hc a CROSS JOIN taps JOIN hc b ON b.image_id = a.image_id AND b.x = a.x AND b.y = greatest(0, least(7, a.y + t)) GROUP BY a.image_id, a.x, a.y, r)
    SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(floor(round(greatest(lo, least(hi, v)), 6) + 0.5e0) AS INTEGER) AS g FROM v""")
def bicubic_upscale(spark, sf_dir):
    """Twice as large by cubic weights, each value kept between its two inner taps."""
    return raster.upscale(px_gray(spark, sf_dir).withColumn("g", F.col("g").cast("double")), 2, ("g",)).withColumn("g", F.floor(F.round("g", 6) + 0.5).cast("int"))


# --- fills

C0, C1, MID = ((x0, x1, m) for x0, x1, m in (("k / 8e0", "1 - k / 16e0", "0.25e0"), ("0.9e0 - k / 10e0", "0.1e0 + k / 12e0", "0.5e0"), ("0.3e0", "k / 9e0", "0.75e0")))
CHANNELS = {"r": C0, "g": C1, "b": MID}


def _fill(k: Column, x: list[Column], y: list[Column]) -> Column:
    """A fill of each family by turns: flat, linear, circular, elliptic; every second in linear light, with a middle stop."""
    rgb = lambda at: F.struct(*[F.expr(CHANNELS[c][at].replace("e0", "D")).cast("double").alias(c) for c in "rgb"])
    stop = lambda o, c: F.struct(F.lit(o).cast("double").alias("offset"), c.alias("color"))
    stops = F.when(k % 4 == 0, F.array(stop(0.0, rgb(0)))).when(k >= 4, F.array(stop(0.0, rgb(0)), stop(0.4, rgb(2)), stop(1.0, rgb(1)))).otherwise(F.array(stop(0.0, rgb(0)), stop(1.0, rgb(1))))
    kind = F.when(k % 4 == 0, "flat").when(k % 4 == 1, "linear").otherwise("radial")
    return F.struct(
        kind.alias("kind"), x[0].alias("x0"), y[0].alias("y0"), x[1].alias("x1"), y[1].alias("y1"), F.lit(20.0).alias("r"), F.when(k % 4 == 3, 1.5).otherwise(1.0).alias("aspect"), F.lit(0.7).alias("angle"), (k >= 4).alias("linear_light"), stops.alias("stops")
    )


FILLS = f"""{CUBICS}, t AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0e0 WHEN k % 4 = 1 THEN greatest(0e0, least(1e0, ((x2 - x0) * (x1 - x0) + (y2 - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2))))
        WHEN k % 4 = 2 THEN least(1e0, sqrt(pow(x2 - x0, 2) + pow(y2 - y0, 2)) / 20) ELSE least(1e0, sqrt(pow(cos(0.7e0) * (x2 - x0) + sin(0.7e0) * (y2 - y0), 2) + pow((cos(0.7e0) * (y2 - y0) - sin(0.7e0) * (x2 - x0)) * 1.5e0, 2)) / 20) END AS t FROM cub),
    u AS (SELECT *, CASE WHEN k < 4 THEN t WHEN t <= 0.4e0 THEN t / 0.4e0 ELSE (t - 0.4e0) / 0.6e0 END AS u, k >= 4 AND t > 0.4e0 AS late FROM t),
    e AS (SELECT *, {", ".join(f"CASE WHEN late THEN {v[2]} ELSE {v[0]} END AS {c}a, CASE WHEN k >= 4 AND NOT late THEN {v[2]} ELSE {v[1]} END AS {c}b" for c, v in CHANNELS.items())} FROM u)"""


def _mixed_sql(c: str) -> str:
    light = f"({lin(f'({c}a * 255)')} + ({lin(f'({c}b * 255)')} - {lin(f'({c}a * 255)')}) * u)"
    enc = f"CASE WHEN {light} <= 0.0031308e0 THEN {light} * 12.92e0 ELSE 1.055e0 * pow({light}, 1 / 2.4e0) - 0.055e0 END"
    return f"CASE WHEN k % 4 = 0 THEN {CHANNELS[c][0]} WHEN k >= 4 THEN {enc} ELSE {c}a + ({c}b - {c}a) * u END"


@query(f"""WITH {FILLS} SELECT image_id, k, {rounds(t="t", **{c: _mixed_sql(c) for c in "rgb"}, rep=f"CASE WHEN k % 4 = 0 THEN {C0[0]} ELSE ({C0[0]} + {C0[1]}) / 2 END")},
    CASE k % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'linear/' WHEN 2 THEN 'radial/' ELSE 'ellipse/' END || CASE WHEN k % 4 = 0 THEN '' WHEN k >= 4 THEN 'lin' ELSE 'srgb' END AS kind,
    CAST(CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN 9 ELSE 11 END + CASE WHEN k > 4 THEN 4 ELSE 0 END AS INTEGER) AS numbers, CAST(least(floor(t * 1000), 1000) AS INTEGER) AS bin FROM e""")
def fill_colors(spark, sf_dir):
    """Gradient coordinates and colors of fills at a point, their names and lengths."""
    xs, ys = ([F.col(f"{c}{i}") for i in range(4)] for c in "xy")
    df = cubics(spark, sf_dir).withColumn("f", _fill(F.col("k"), xs, ys)).withColumn("t", fills.fill_t(F.col("f"), xs[2], ys[2]))
    f, c = F.col("f"), fills.color_at(F.col("f"), F.col("t"))
    return df.select("image_id", "k", rnd("t").alias("t"), *[rnd(c[n]).alias(n) for n in "rgb"], rnd(fills.representative(f)["r"]).alias("rep"), fills.kind_name(f).alias("kind"), fills.numbers(f).cast("int").alias("numbers"), fills.bin_of(F.col("t")).alias("bin"))


@query("SELECT CAST(n AS BIGINT) AS n, " + rounds(price="0.5e0 * ln(greatest(n, 2e0))", wide="2e0 * ln(greatest(n / 4e0, 2e0))", flat="1.5e0 * ln(greatest(n, 2e0))", back="least(n, 1000) / 1000e0") + ", CAST(greatest(floor(n / 4096), 1) AS INTEGER) AS stride FROM (SELECT range * 37 AS n FROM range(1, 500))")
def fill_prices(spark, sf_dir):
    """What a number costs in regions of so many pixels, a flat fill's cost, sampling strides and offsets of bins."""
    n = F.col("n")
    df = spark.range(1, 500).select((F.col("id") * 37).alias("n"))
    return outs(df.withColumn("stride", fills.fit_stride(n)), ["n", "stride"], price=fills.bic_price(n), wide=fills.bic_price(n, 2.0), flat=fills.flat_cost(fills.bic_price(n)), back=fills.bin_offset(n))


@query(f"""WITH {CUBICS} SELECT image_id, k, {rounds(x0="x0 + CASE WHEN k % 4 = 0 THEN 0 ELSE 0.5e0 END", y1="y1 + CASE WHEN k % 4 = 0 THEN 0 ELSE 0.5e0 END", back="x0")}, CAST(CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS stops FROM cub""")
def fill_frames(spark, sf_dir):
    """Fills moved to the pixel frame and back, and given new stops."""
    xs, ys = ([F.col(f"{c}{i}") for i in range(4)] for c in "xy")
    df = cubics(spark, sf_dir).withColumn("f", _fill(F.col("k"), xs, ys))
    moved, f = fills.to_pixel_frame(F.col("f")), F.col("f")
    two = F.array(F.get(f["stops"], 0), F.element_at(f["stops"], -1))
    return outs(df.withColumn("stops", F.size(fills.with_stops(f, two)["stops"])), ["image_id", "k", "stops"], x0=moved["x0"], y1=moved["y1"], back=fills.to_fitting_frame(moved)["x0"])
