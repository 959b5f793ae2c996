"""Mixing sources to target weights by entropy balancing (JVM functions only).

Every document gets a rate r, its expected number of copies, between 0 and ``cap``. Among all rates
whose tokens add up to each source's target, the entropy-balancing ones maximise the entropy of r
relative to one copy each, inside the box [0, cap]. Their form is an exponential tilt by size,

    r = cap / (1 + (cap - 1) * exp(-lambda_s * size / mean_s)),

with one multiplier per source, the solution of a convex dual. Newton iterations solve the dual over
the table of (source, size, count), an exact sufficient statistic that is aggregated once; each
iteration is one distributed aggregation, with a bracket that catches overshooting steps. Sources
whose target reaches the cap take rate ``cap`` throughout.

Rates become copies by a rounding threshold: a document rounds up when u / frac(r) <= K_s, u being a
hash of its id. K_s is the weighted quantile at which the source's words come nearest its target, found
exactly by refining histograms, so no source is ever gathered in one task.

Defined cases: a null or empty text has size 0, takes part with taken 0; a null source is a source of its
own, last in order; rows that repeat a doc_id are mixed each for themselves with the same u; an empty table
gives an empty result; columns of the input other than id, source and text are ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.runtime import materialize

#: Fixed by the contract: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Per-source parameters are broadcast up to so many sources; beyond, Spark shuffles and AQE splits skew.
BROADCAST_SOURCES = 20_000
BINS, REFINEMENTS, KAPPA_MAX = 1024, 3, 4.0
STEPS_A_JOB, JOBS, TOLERANCE = 5, 40, 1e-7


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key for a nullable source."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def uniform(key: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) from a key."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def with_source(df: DataFrame, params: DataFrame, n_sources: int) -> DataFrame:
    return df.join(F.broadcast(params) if n_sources <= BROADCAST_SOURCES else params, "skey")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (skey, source, source_size) with target: shares by repeating weights, water-filled below cap."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last(), "skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("q", F.col("most") / F.col("w"))
    before = Window.orderBy("q", "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level)
    # Of the levels that stop below their own row's cap, the first in order is the largest.
    water = F.max(F.when(F.col("level") <= F.col("q"), F.col("level"))).over(everything)
    return filled.withColumn("water", water).select(
        "skey", "source", "source_size", F.least(F.col("most"), F.coalesce(F.col("w") * F.col("water"), F.col("most"))).alias("target")
    )


def rate(lam: Column, size: Column, mean: Column, full: Column, cap: float) -> Column:
    tilt = F.lit(float(cap)) / (1.0 + (cap - 1.0) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * size / mean))))
    return F.when(full, F.lit(float(cap))).otherwise(tilt)


def solve(histogram: DataFrame, sources: DataFrame, n_sources: int, cap: float = CAP) -> DataFrame:
    """One multiplier for each source of positive size: (skey, source_size, target, mean, full, lam)."""
    unbounded = float("inf")
    state = sources.select(
        "skey", "source_size", "target", "mean", (F.col("target") >= F.lit(float(cap) * (1 - 1e-12)) * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-unbounded).alias("lo"), F.lit(unbounded).alias("hi"), F.lit(unbounded).alias("gap"),
    )
    for _ in range(JOBS):
        for _ in range(STEPS_A_JOB):
            r = rate(F.col("lam"), F.col("size"), F.col("mean"), F.col("full"), cap)
            mass = F.col("n") * F.col("size")
            # The state goes through the aggregation: joined to its own sums, it would stand twice in the plan of each step, 32 times after five.
            sums = with_source(histogram, state.drop("gap"), n_sources).groupBy("skey").agg(
                F.sum(mass * r).alias("got"), F.sum(mass * F.col("size") / F.col("mean") * r * (1.0 - r / float(cap))).alias("slope"),
                *[F.first(c).alias(c) for c in state.columns if c not in ("skey", "gap")],
            )
            g = F.col("got") - F.col("target")
            lo, hi = F.when(g < 0, F.col("lam")).otherwise(F.col("lo")), F.when(g > 0, F.col("lam")).otherwise(F.col("hi"))
            most = 2.0 + F.abs("lam")
            step = F.greatest(-most, F.least(most, F.when(F.col("slope") > 0, -g / F.col("slope")).otherwise(-F.signum(g) * most)))
            new = F.col("lam") + step
            inside = (new > lo) & (new < hi)
            new = F.when(g == 0, F.col("lam")).when(inside, new).otherwise((lo + hi) / 2.0)
            state = sums.select(
                "skey", "source_size", "target", "mean", "full", new.alias("lam"), lo.alias("lo"), hi.alias("hi"),
                F.when(F.col("full"), 0.0).otherwise(F.abs(g) / F.col("target")).alias("gap"),
            )
        state = materialize(state, "mix-dual")
        if (state.agg(F.max("gap")).first()[0] or 0.0) < TOLERANCE:
            return state
    raise ArithmeticError(f"the dual did not converge in {JOBS * STEPS_A_JOB} steps")


def thresholds(sizes: DataFrame, state: DataFrame, n_sources: int, cap: float = CAP) -> DataFrame:
    """state with k, the rounding threshold of each source."""
    r = rate(F.col("lam"), F.col("size"), F.col("mean"), F.col("full"), cap)
    low = F.floor("r").cast("double")
    frac = F.col("r") - low
    docs = with_source(sizes.filter("size > 0"), state.select("skey", "lam", "mean", "full"), n_sources).withColumn("r", r).select(
        "skey", "size", (low * F.col("size")).alias("base"), F.when(frac > 0, F.col("u") / frac).alias("kappa")
    )
    base = docs.groupBy("skey").agg(F.sum("base").alias("base"))
    state = state.join(base, "skey").select("*", (F.col("target") - F.col("base")).alias("left"), F.lit(0.0).alias("k"), F.lit(KAPPA_MAX).alias("width")).drop("base")
    state = materialize(state, "mix-round")
    for step in range(REFINEMENTS):
        inside = with_source(docs, state.select("skey", "k", "width"), n_sources).filter((F.col("kappa") > F.col("k")) & (F.col("kappa") <= F.col("k") + F.col("width")))
        bin_ = F.least(F.lit(BINS - 1), F.ceil((F.col("kappa") - F.col("k")) / F.col("width") * BINS).cast("int") - 1)
        bins = inside.groupBy("skey", bin_.alias("bin")).agg(F.sum("size").alias("mass"))
        run = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        # The first bin that the running sum oversteps is looked at more closely; all before it round up.
        over = bins.withColumn("cum", F.sum("mass").over(run)).join(state.select("skey", "left"), "skey").filter(F.col("cum") > F.col("left"))
        first = over.groupBy("skey").agg(F.min(F.struct("bin", "cum", "mass")).alias("at")).select("skey", "at.*")
        found = F.col("bin").isNotNull()
        done = F.coalesce(F.col("cum") - F.col("mass"), F.lit(0.0))
        if step == REFINEMENTS - 1:  # now a bin holds about one document: take it if that comes nearer
            taken = F.when(F.col("cum") - F.col("left") < F.col("left") - done, F.col("bin") + 1).otherwise(F.col("bin"))
            k = F.when(found, F.col("k") + taken * F.col("width") / BINS).otherwise(F.col("k") + F.col("width"))
            state = state.join(first, "skey", "left").select("skey", "source_size", "target", "mean", "full", "lam", k.alias("k"))
        else:
            k = F.when(found, F.col("k") + F.col("bin") * F.col("width") / BINS).otherwise(F.col("k") + F.col("width"))
            state = state.join(first, "skey", "left").select(
                "skey", "source_size", "target", "mean", "full", "lam", (F.col("left") - done).alias("left"), k.alias("k"),
                F.when(found, F.col("width") / BINS).otherwise(0.0).alias("width"),
            )
        state = materialize(state, "mix-round")
    return state


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 17) -> tuple[DataFrame, DataFrame, int]:
    """The sizes (id, skey, size, u), the parameters of each source, and the number of sources."""
    sizes = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"), words(F.col(text_col)).alias("size")).withColumn(
            "u", uniform(F.col("id"), seed)
        ),
        "mix-sizes",
    )
    sources = sizes.groupBy("skey", "source").agg(F.sum("size").cast("double").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"))
    sources = materialize(sources, "mix-sources")
    n_sources = sources.count()
    goals = targets(sources, weights, cap).join(sources.select("skey", "n_docs"), "skey").withColumn("mean", F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)))
    goals = materialize(goals, "mix-targets")
    histogram = materialize(sizes.filter("size > 0").groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    state = solve(histogram, goals.filter("source_size > 0"), n_sources, cap)
    found = thresholds(sizes, state, n_sources, cap)
    params = goals.select("skey", "source_size", "target").join(found.select("skey", "mean", "full", "lam", "k"), "skey", "left")
    return sizes, materialize(params, "mix-params"), n_sources


def copies(size: Column, u: Column, cap: int = CAP) -> Column:
    """Copies of a document from its source's parameters, which are in the same row."""
    r = rate(F.col("lam"), size, F.col("mean"), F.col("full"), cap)
    up = (r > F.floor(r)) & (u / (r - F.floor(r)) <= F.col("k"))
    return F.when((size > 0) & F.col("lam").isNotNull(), F.least(F.lit(cap), F.floor(r).cast("int") + up.cast("int"))).otherwise(0).cast("int")


def entropy_mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: id, size, source_size, target (its source's), copies, taken = copies * size."""
    cap = options.get("cap", CAP)
    sizes, params, n_sources = plan(docs, **options)
    mixed = with_source(sizes, params, n_sources).withColumn("copies", copies(F.col("size"), F.col("u"), cap))
    return mixed.select("id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, cap: int = CAP, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it. The text never moves: only parameters are joined.

    An empty text adds no words at any number of copies; it stays, once.
    """
    _, params, n_sources = plan(docs, id_col, source_col, text_col, seed=seed, cap=cap, **options)
    own = {c: f"__mix_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*own.values())
    keyed = inner.withColumn("skey", source_key(F.col(own[source_col]))).withColumn("size", words(F.col(own[text_col]))).withColumn("u", uniform(F.col(own[id_col]), seed))
    n = F.when(F.col("size") == 0, 1).otherwise(copies(F.col("size"), F.col("u"), cap))
    taken = with_source(keyed, params, n_sources).withColumn("n", n).filter("n > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), *own.values()).select(*[F.col(v).alias(c) for c, v in own.items()])
