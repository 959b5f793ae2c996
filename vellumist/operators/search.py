"""Settings search: utilities, guard, Pareto front and curves over candidate tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the utility axes, where a caller gives none.
WEIGHTS = {"fidelity": 0.5, "nodes": 0.2, "bytes": 0.2, "colors": 0.1, "clean": 0.1}
FLOOR, SLACK = 1e-4, 0.2
#: What a warning takes from cleanliness; one of severity info takes half.
PENALTIES = {"tiny-features": 0.2, "stencil-islands": 0.15, "node-count": 0.15, "palette-clamped": 0.05, "centerline-input": 0.1}


def error(mean: Column, p95: Column) -> Column:
    return F.when(p95.isNull(), mean).otherwise(0.65 * mean + 0.35 * F.greatest(mean, p95))


def cleanliness(warnings: Column) -> Column:
    """1 less the penalties of an array of struct(code, severity), at least 0."""
    cost = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])
    total = F.aggregate(warnings, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(cost, w["code"]), F.lit(0.0)) * F.when(w["severity"] == "info", 0.5).otherwise(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total))


def is_empty(paths: Column, nodes: Column, warnings: Column) -> Column:
    return (paths == 0) | (nodes == 0) | F.exists(warnings, lambda w: w["code"] == "empty-result")


def utilities(candidates: DataFrame, baseline: DataFrame, weights: dict | None = None) -> DataFrame:
    """candidates with one utility an axis, empty, and their weighted geometric mean (0 if empty); baseline: one row a run with nodes, bytes and colors.

    Counts are anchored so that the baseline has 0.5; a color count starts at one color.
    """
    base = baseline.select("run_id", *[F.col(c).alias(f"base_{c}") for c in ("nodes", "bytes", "colors")])
    df = candidates.join(base, "run_id").withColumn("u_fidelity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 4 * error(F.col("mean_de"), F.col("p95_de")))))
    for c, least in (("nodes", 0), ("bytes", 0), ("colors", 1)):
        df = df.withColumn(f"u_{c}", 1 / (1 + F.greatest(F.lit(0), F.col(c) - least) / F.greatest(F.lit(1), F.col(f"base_{c}") - least)))
    df = df.withColumn("u_clean", cleanliness(F.col("warnings"))).withColumn("empty", is_empty(F.col("paths"), F.col("nodes"), F.col("warnings")))
    used = {k: w for k, w in (weights or WEIGHTS).items() if w > 0}
    log = sum((F.lit(w) * F.ln(F.greatest(F.lit(FLOOR), F.col(f"u_{k}"))) for k, w in used.items()), F.lit(0.0))
    score = F.exp(log / sum(used.values())) if used else F.lit(0.0)
    return df.withColumn("score", F.when(F.col("empty"), 0.0).otherwise(score)).drop("base_nodes", "base_bytes", "base_colors")


def fidelity_guard(scored: DataFrame, explicit: float = 0.0) -> DataFrame:
    """scored with floor and eligible: fidelity may fall so far below the best of the run's candidates that are not empty; applied to all of the run afterwards."""
    best = F.max(F.when(~F.col("empty"), F.col("u_fidelity"))).over(Window.partitionBy("run_id"))
    floor = F.greatest(F.lit(explicit), F.coalesce(best, F.lit(0.0)) - SLACK)
    return scored.withColumn("floor", floor).withColumn("eligible", ~F.col("empty") & (F.round("u_fidelity", 9) >= F.round(floor - 1e-9, 9)))


AXES = ("u_fidelity", "u_nodes", "u_colors")
#: Candidates compared at once.
PARETO_BLOCK = 512


def pareto_front(guarded: DataFrame, axes: tuple = AXES, slack: float = 1e-9) -> DataFrame:
    """run_id, id of the eligible candidates that no other eligible one of the run beats: none is at least as good, within slack, on every axis and better on one.

    A run's candidates, as many as its search had steps, are compared in one task, block by block.
    """

    def front(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows[list(axes)].to_numpy()
        stays = np.ones(len(v), bool)
        for at in range(0, len(v), PARETO_BLOCK):
            mine = v[at : at + PARETO_BLOCK, None, :]
            for other in range(0, len(v), PARETO_BLOCK):
                theirs = v[None, other : other + PARETO_BLOCK, :]
                beaten = (theirs >= mine - slack).all(axis=2) & (theirs > mine + slack).any(axis=2)
                stays[at : at + PARETO_BLOCK] &= ~beaten.any(axis=1)
        return rows.loc[stays, ["run_id", "id"]]

    rows = guarded.filter("eligible").select("run_id", "id", *axes)
    return rows.groupBy("run_id").applyInPandas(front, rows.select("run_id", "id").schema)


def best_so_far(scored: DataFrame) -> DataFrame:
    """run_id, id, best: running best score in order of id."""
    return scored.select("run_id", "id", F.max("score").over(Window.partitionBy("run_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("best"))


def variance_explained(scored: DataFrame, by: str, value: str = "score") -> DataFrame:
    """One row, eta2: share of the value's variance that the levels of a parameter explain; two aggregations."""
    levels = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = levels.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    middle = F.col("s") * F.col("s") / F.col("n")
    return t.select((F.col("b") - middle).alias("between"), (F.col("q") - middle).alias("total")).select(F.when(F.col("total") > 0, F.col("between") / F.col("total")).otherwise(0.0).alias("eta2"))


def latin_hypercube(rows: DataFrame, axes: int, key: str = "id", group: str = "run_id") -> DataFrame:
    """rows with u0, u1, ...: in each axis every candidate of a group has its own stratum, in an order given by a hash."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    out = rows
    for i in range(axes):
        order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(i), F.col(key))), key)
        out = out.withColumn(f"u{i}", (F.row_number().over(order) - 0.5) / n)
    return out


def verdict(reports: DataFrame, tie: float = 0.0005, least: float = 0.02) -> DataFrame:
    """family, n, de_a, de_b, wins, losses, total: by family and, in the rollup's last row, over all (family null)."""
    change = F.col("de_b") - F.col("de_a")
    held = (F.round(F.abs(change), 9) < tie) | (F.round(F.abs(change), 9) < F.round(least * F.col("de_a"), 9))
    side = F.when(held, 0).otherwise(-F.signum(change)).cast("int")
    return reports.withColumn("side", side).rollup("family").agg(
        F.count(F.lit(1)).alias("n"), F.avg("de_a").alias("de_a"), F.avg("de_b").alias("de_b"), F.count(F.when(F.col("side") == 1, 1)).alias("wins"), F.count(F.when(F.col("side") == -1, 1)).alias("losses"), F.grouping_id().cast("int").alias("total")
    )
