"""Queries of the training-data operators, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumist.llm import bpe, html_text, jaccard, lang_kernel, licences, line_crf, media, mixing, secrets, topk
from vellumist.runtime import read_table


def op1_licence_scan(spark, sf_dir):
    return licences.scan(read_table(spark, sf_dir, "documents"))


TOKENIZER = "byte_bpe_50k.tiktoken"


def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op3_secret_scan(spark, sf_dir):
    found = secrets.find(read_table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in secrets.STRONG_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), "n_links", secrets.grouped(F.col("credentials")).alias("credentials"))


def op4_language_kernel(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = lang_kernel.train(docs, crc_remainder("doc_id", 4) != 2)
    found = lang_kernel.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_media_fingerprints(spark, sf_dir):
    """Every recording with its class (match null), and every match of a class that holds a query."""
    prints = media.fingerprints(media.play(read_table(spark, sf_dir, "embeddings")))
    members, matches = media.align(prints, F.col("id") % 50 == 0)
    return members.select(F.col("id").alias("vec_id"), "class_id", *[F.lit(None).cast(t).alias(c) for c, t in (("match_class", "long"), ("offset", "int"), ("overlap", "int"), ("bit_error", "double"))]).unionByName(
        matches.select(F.lit(None).cast("long").alias("vec_id"), F.col("query_class").alias("class_id"), F.col("class_id").alias("match_class"), "offset", "overlap", "bit_error")
    )


def op6_html_main_text(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark, sf_dir):
    linked = jaccard.join(read_table(spark, sf_dir, "documents"))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def crc_remainder(column, modulus):
    """crc32 of a number as text, modulo modulus: the contract's split into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op8_quality_crf(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    crf = line_crf.train(docs, labels, crc_remainder("doc_id", 5) != 0)
    scored = line_crf.classify(docs.select("doc_id", "text"), crf)
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_exact_top_k(spark, sf_dir):
    best = topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_mix_sources(spark, sf_dir):
    mixed = mixing.entropy_mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


ORACLE_SQL = {
    "op9_exact_top_k": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
        queries AS (SELECT vec_id, max(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                          CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
                   FROM queries q JOIN v c ON q.vec_id <> c.vec_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}


def oracle_sql():
    return dict(ORACLE_SQL)
