import random
import re

import pytest

from vellumist.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, copies string"


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Shares by weight; what exceeds the cap is dealt again among the others until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        goal = {s: cap * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        full |= over


def fixture():
    rng = random.Random(8)
    rows = []
    for i in range(900):
        s = rng.choice(["b", "a", "é", "Z", None, "tiny", "big", "big", "big"])
        n = rng.choice([1, 5, 40, 200]) if s != "tiny" else 2
        rows.append((i, " ".join("w" for _ in range(n)), s, 1, "x"))
    rows += [(1000, None, "a", 1, "x"), (1001, "", "empty", 1, "x"), (1002, " \t\n ", "empty", 1, "x"), (None, "one two", "b", 1, "x"), (5, rows[5][1], rows[5][2], 1, "x"), (1003, "long " * 60_000, "big", 1, "x")]
    return rows


def test_targets_taken_and_reruns(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.entropy_mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, s, *_ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    goal = brute_targets(totals)
    source = {r[0]: r[2] for r in rows}
    taken, largest = {}, {}
    for r in got:
        s = source[r.id]
        assert r.source_size == totals[s] and r.target == pytest.approx(goal[s])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s in totals:
        assert abs(taken[s] - goal[s]) <= largest[s], s
    assert sum(goal.values()) == pytest.approx(sum(totals.values()))
    again = mixing.entropy_mix(df.repartition(11)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_solve_the_dual(spark):
    df = spark.createDataFrame(fixture(), SCHEMA)
    sizes, params, n = mixing.plan(df)
    rows = mixing.with_source(sizes.filter("size > 0"), params, n).withColumn("r", mixing.rate(*map(mixing.F.col, ("lam", "size", "mean", "full")), 3)).collect()
    got, goal = {}, {}
    for r in rows:
        got[r.skey] = got.get(r.skey, 0) + r.r * r.size
        goal[r.skey] = r.target
        assert 0 <= r.r <= 3
    for s in goal:
        assert got[s] == pytest.approx(goal[s], rel=1e-4)


def test_apply_repeats_rows_and_keeps_columns(spark):
    df = spark.createDataFrame(fixture(), SCHEMA)
    taken = {r.id: r.copies for r in mixing.entropy_mix(df).collect() if r.size > 0}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert {1000, 1001, 1002} <= set(count)  # empty texts stay, once
    assert all(count.get(i, 0) == c for i, c in taken.items() if i not in (5,))
    assert count.get(5, 0) == 2 * taken[5]


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.entropy_mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 1, ""), (2, "", None, 1, "")], SCHEMA)
    assert [(r.taken, r.target) for r in mixing.entropy_mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_a_step_of_the_dual_has_the_state_once(spark, monkeypatch):
    plans, write = [], mixing.materialize

    def seen(df, tag, *rest):
        plans.extend([df._jdf.queryExecution().optimizedPlan().toString()] if tag == "mix-dual" else [])
        return write(df, tag, *rest)

    monkeypatch.setattr(mixing, "materialize", seen)
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 7 + 1)) for i in range(40)], "doc_id long, source string, text string")
    assert mixing.entropy_mix(docs).count() == 40
    assert plans and all(p.count("Join Inner") == mixing.STEPS_A_JOB for p in plans)
