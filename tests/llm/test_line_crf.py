import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from vellumist.llm import line_crf


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    unary, t = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    z, prob, pairs = line_crf.marginals(unary, lengths, t)
    want_pairs, at = np.zeros((2, 2)), 0
    for chain, n in enumerate(lengths):
        total, p = 0.0, np.zeros((n, 2))
        e = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i, y[i]] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            for i in range(n):
                p[i, y[i]] += w
                if i:
                    e[y[i - 1], y[i]] += w
        assert np.isclose(z[chain], np.log(total)) and np.allclose(prob[at : at + n], p / total)
        want_pairs += e / total
        at += n
    assert np.allclose(pairs, want_pairs)


def fixture(spark, path="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy_and_reruns(spark):
    docs, labels = fixture(spark)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    crf = line_crf.train(docs, labels, train)
    again = line_crf.train(docs.repartition(5), labels, train)
    assert np.allclose(crf["w"], again["w"])
    scored = line_crf.classify(docs, crf)
    assert scored.columns == [*docs.columns, "score", "predicted"]
    held = [r for r in scored.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in held)


def test_nulls_empty_texts_and_missing_labels(spark):
    docs, labels = fixture(spark)
    odd = spark.createDataFrame([(1, None, "a", 0.5), (1, None, "a", 0.5), (2, "", None, None), (None, " \n\n ", "b", 1.0), (3, "x" * 200_000, "b", 1.0)], "doc_id long, text string, lang string, score double")
    crf = line_crf.train(docs, labels, F.lit(True))
    rows = line_crf.classify(odd, crf).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert line_crf.classify(odd.limit(0), crf).count() == 0
    none = line_crf.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in line_crf.classify(odd, none).collect()} == {0.5}


def test_a_fit_holds_the_lines_once():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = [(rng.normal(size=(50, line_crf.FEATURES)).astype(np.float32), np.ones(50)) for _ in range(400)]
    tracemalloc.start()
    line_crf.fit(texts, np.arange(400) % 2, steps=2)
    assert tracemalloc.get_traced_memory()[1] < 1.5 * 8 * 50 * 400 * line_crf.FEATURES
    tracemalloc.stop()
