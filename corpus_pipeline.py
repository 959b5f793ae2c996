"""From raw documents to token ids: each stage works on all that the one before it kept.

A stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

Defined cases, for every stage: a null or empty text is scored as an empty line is, links with nothing, holds no secret, is taken once by the mix and has
no tokens; rows that repeat id and text count once after the join, and rows without an id stay; an empty table gives an empty one; other columns go through as they are,
whatever their names, and the last stage leaves them out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumist.llm import bpe, jaccard, line_crf, mixing, secrets
from vellumist.llm.catalog import TOKENIZER, crc_remainder
from vellumist.runtime import materialize, read_table

#: Executors hold what the stages before have touched of their heaps, so BPE workers hold a quarter of what they may alone, for more work.
BPE_SHARE = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, learned from the labelled ones outside the held-out fold, does not reject."""
    crf = line_crf.train(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    taken = {c.lower() for c in docs.columns}
    score, passed = (next(n for n in (f"__{x}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for x in ("score", "passed"))
    return line_crf.classify(docs, crf, score_col=score, predicted_col=passed).filter(F.col(passed) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    return jaccard.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every reported secret replaced; n_chars follows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the entropy-balanced mix takes them."""
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document of the mix."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, with_ids=True, share=BPE_SHARE)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_redaction),
    ("source_mixing", source_mix),
    ("byte_level_bpe", token_ids),
]

#: Forward-backward marginals, connected components and BPE have no SQL form over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
