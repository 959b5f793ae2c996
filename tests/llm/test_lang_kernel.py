import zlib

import numpy as np
from pyspark.sql import functions as F

from vellumist.llm import lang_kernel



def split():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def test_presence_and_kernel_by_hand():
    rows = lang_kernel.presence([b"abab", b"ABAB", "É".encode(), "é".encode(), b"a1b", b"a, b", b""])
    assert (rows[0] == rows[1]).all() and (rows[2] == rows[3]).all() and (rows[4] == rows[5]).all()
    assert rows[0].sum() <= 2 + 2 + 1 + 3 and rows.max() == 1


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_kernel.train(docs, split())
    assert np.allclose(model["v"], lang_kernel.train(docs.repartition(5), split())["v"], atol=1e-5)
    got = lang_kernel.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_kernel.train(docs, split())
    odd = spark.createDataFrame([(1, None, "de", 1.0), (1, None, "de", 1.0), (2, "", None, 0.0), (3, "12 %% ...", "fr", 0.0), (None, "the house and the garden", None, 0.0), (5, "der und die " * 40_000, None, 0.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in lang_kernel.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[None].lang_pred in model["names"] and got[5].lang_pred == "de"
    assert lang_kernel.train(docs.filter("lang is null"), split()) is None
    assert {r.lang_pred for r in lang_kernel.identify(odd, None).collect()} == {"und"}
    assert lang_kernel.identify(odd.limit(0), model).count() == 0
