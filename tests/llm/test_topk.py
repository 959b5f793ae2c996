import random

from pyspark.sql import functions as F

from vellumist.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q string"


def brute(rows, k):
    import math

    ready = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ready = list(dict.fromkeys((i, tuple(v)) for i, v in ready))
    queries = {}
    for i, v in ready:
        if i % 50 == 0:
            queries[i] = max(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), i) for i, w in ready if i != q})[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect())


def test_against_brute_force_with_ties_nulls_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-40, 40) / 64 for _ in range(20)]) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 460)]  # ties
    rows += [(3, rows[3][1]), (50, rows[50][1]), (500, None), (501, [None, 1.0]), (502, [float("nan")]), (503, [float("inf"), 1.0]), (None, rows[0][1]), (550, []), (551, [2.0] * 30)]
    want = brute(rows, 5)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    assert run(spark, rows) == want


def test_small_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [1.0]), (2, [-1.0])]) == [(0, 1, 1, 65536), (0, 2, 2, -65536)]
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, []) == []


def test_copies_of_a_row_leave_room_for_others(spark, monkeypatch):
    rows = [(0, [1.0, 0.0])] + [(1, [3.0, 0.0])] * 40 + [(2, [2.0, 0.0]), (4, [1.0, 5.0]), (4, [1.0, 7.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).coalesce(1)
    want = [(0, 1, 1, 3 << 16), (0, 2, 2, 2 << 16), (0, 3, 4, 1 << 16), (0, 4, 4, 1 << 16), (0, 5, 3, 1 << 15)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, 5).collect())) == want
    more = df.unionByName(df.filter("vec_id = 0").withColumn("vec_id", F.lit(100).cast("long")).withColumn("embedding", F.array(F.lit(-1.0), F.lit(0.0)).cast("array<float>")))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    assert [tuple(r) for r in topk.top_k(more.coalesce(1), F.col("vec_id") % 100 == 0, 5).filter("query_id = 0").orderBy("rank").collect()] == want
