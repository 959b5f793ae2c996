"""Images and geometry read from the relational tables.

A vector of 64 numbers is an 8 x 8 raster; events of a user are a polyline; digests of texts are colors. Every adapter is a lazy
projection of one scan: filters and column pruning reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumist.runtime import read_table

SIDE = 8
#: Warnings that the candidates bring, by turns.
CODES = ("tiny-features", "stencil-islands", "node-count", "palette-clamped", "centerline-input", "empty-result", "other")


def _byte(v):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128) + F.lit(256) * v.cast("double")))).cast("int")


def px_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray bytes: image_id, x, y, g."""
    cells = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return cells.select("image_id", (F.col("p") % SIDE).alias("x"), F.expr(f"int(p div {SIDE})").alias("y"), _byte(F.col("v")).alias("g"))


def px_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """color bytes: image_id, x, y, r, g, b; the channels are three rotations of the vector."""
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.posexplode("embedding").alias("p", "v"))
    turned = [F.get("embedding", (F.col("p") + k) % F.size("embedding")) for k in (21, 42)]
    return v.select(
        "image_id", (F.col("p") % SIDE).alias("x"), F.expr(f"int(p div {SIDE})").alias("y"),
        _byte(F.col("v")).alias("r"), _byte(turned[0]).alias("g"), _byte(turned[1]).alias("b"),
    )


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One density raster of line items: x = quantity, y = discount in percent, n."""
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"))
    return items.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every user's line: line_id, seq (by time, then event), px = seq, py = value."""
    from pyspark.sql import Window

    events = read_table(spark, sf_dir, "events").filter("user_id is not null and value is not null").select("user_id", "ts", "event_id", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("line_id"), seq.alias("seq"), seq.cast("double").alias("px"), F.col("value").alias("py"))


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hex color of every document: doc_id, lang, hex."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.substring(F.md5("text"), 1, 6).alias("hex"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search candidates: one a part, grouped into runs by brand, with error, size and node counts and warnings."""
    codes = F.array(*[F.lit(c) for c in CODES])
    warning = F.struct(F.element_at(codes, (F.col("p_partkey") % 7 + 1).cast("int")).alias("code"), F.when(F.col("p_partkey") % 2 == 0, "info").otherwise("warning").alias("severity"))
    tiny = F.struct(F.lit("tiny-features").alias("code"), F.lit("warning").alias("severity"))
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("id"),
        (F.col("p_size") / 200.0).alias("mean_de"), ((F.col("p_partkey") % 97) / 200.0).alias("p95_de"),
        (F.col("p_partkey") % 613 + 10).cast("long").alias("nodes"), (F.col("p_partkey") % 41 + 1).cast("long").alias("paths"),
        F.floor(F.col("p_retailprice")).cast("long").alias("bytes"), (F.col("p_partkey") % 31 + 2).cast("int").alias("colors"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(warning, tiny)).otherwise(F.array(warning)).alias("warnings"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides of a comparison: family, image, de_a, de_b."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    marks = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    both = docs.join(marks, "doc_id")
    a = (F.col("n_chars") % 1000) / 10000.0
    return both.select(F.col("lang").alias("family"), F.col("doc_id").alias("image"), a.alias("de_a"), (a + ((F.col("doc_id") % 11) - 5) * F.when(F.col("quality") == 1, 0.002).otherwise(0.001)).alias("de_b"))
