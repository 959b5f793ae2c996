"""Connected regions of label maps and what is done to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumist.operators import grid
from vellumist.runtime import materialize

#: Positions are y * WIDE + x, so images may have as many columns.
WIDE = 1 << 20
#: Rows of an image that one task labels; regions of taller images are joined over the seams.
STRIP = 2048
#: Pixels that a task labels at once, or one strip.
CHUNK = 1 << 18


def position() -> Column:
    return F.col("y").cast("long") * WIDE + F.col("x")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that links (a, b) reach from each of n: hook the larger root to the smaller, halve all paths, until no link is open."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _marks(group: np.ndarray, x: np.ndarray, y: np.ndarray, label: np.ndarray, diagonal: bool) -> np.ndarray:
    """Marks of pixels sorted by group, y and x."""
    at = y * WIDE + x
    key = group * (1 << 40) + at
    ends = []
    for step in (0, 1, WIDE, *((WIDE - 1, WIDE + 1) if diagonal else ())):
        j = np.searchsorted(key, key + step) if step else np.arange(1, len(key) + 1)
        i = np.flatnonzero(j < len(key))
        i = i[(key[j[i]] == key[i] + step) & (label[j[i]] == label[i]) & (label[i] >= 0)]
        ends.append((i, j[i]))
    root = _roots(np.concatenate([i for i, _ in ends]), np.concatenate([j for _, j in ends]), len(key))
    return np.where(label < 0, -1, at[root])


def _label_strips(columns: list[str], label: str, diagonal: bool):
    """mapInArrow function: rows sorted by image, strip, y and x get their marks, whole strips at a time."""
    place = {c: columns.index(c) for c in ("image_id", "x", "y", label)}

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.fill_null(batch.column(place[name]).cast(pa.int64()), -1).to_numpy(zero_copy_only=False)

    def groups(batch: pa.RecordBatch) -> np.ndarray:
        image, strip = numbers(batch, "image_id"), numbers(batch, "y") // STRIP
        return np.cumsum(np.append(0, (image[1:] != image[:-1]) | (strip[1:] != strip[:-1])))

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        comp = _marks(groups(batch), numbers(batch, "x"), numbers(batch, "y"), numbers(batch, label), diagonal)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(comp, pa.int64())], names=[*columns, "comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, CHUNK
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                whole = pa.concat_batches(held)
                of = groups(whole)
                cut = int(np.searchsorted(of, of[-1]))  # the last strip may go on
                if cut:
                    yield marked(whole.slice(0, cut))
                held, rows = [whole.slice(cut)], whole.num_rows - cut
                enough = max(CHUNK, 2 * rows)
        if rows:
            yield marked(pa.concat_batches(held))

    return run


def _over_seams(marked: DataFrame, label: str, diagonal: bool) -> DataFrame:
    """marked with the regions that touch over a seam between strips under one mark."""
    at = F.col("y") % STRIP
    above = marked.filter((at == STRIP - 1) & (F.col(label) >= 0)).select("image_id", F.col("comp").alias("a"), F.col(label).alias("__l"), (F.col("y") + 1).alias("y"), F.explode(F.array(*[F.col("x") + d for d in ((-1, 0, 1) if diagonal else (0,))])).alias("x"))
    below = marked.filter((at == 0) & (F.col("y") > 0) & (F.col(label) >= 0)).select("image_id", F.col("comp").alias("b"), F.col(label).alias("__l"), "y", "x")
    edges = above.join(below, ["image_id", "__l", "y", "x"]).select("image_id", "a", "b").distinct()
    both = materialize(edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))), "seams")
    names = materialize(both.groupBy("image_id", "a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "seams")
    while True:
        near = both.join(names.select("image_id", F.col("a").alias("b"), "to"), ["image_id", "b"]).groupBy("image_id", "a").agg(F.min("to").alias("near"))
        hop = names.join(near, ["image_id", "a"]).select("image_id", "a", F.col("to").alias("old"), F.least("to", "near").alias("mid"))
        new = hop.join(names.select("image_id", F.col("a").alias("mid"), F.col("to").alias("far")), ["image_id", "mid"])
        new = materialize(new.select("image_id", "a", "old", F.least("mid", "far").alias("to")), "seams")
        names = new.select("image_id", "a", "to")
        if not new.filter("old != to").limit(1).count():
            break
    named = marked.join(names.withColumnRenamed("a", "comp"), ["image_id", "comp"], "left").withColumn("comp", F.coalesce("to", "comp"))
    return materialize(named.select(*marked.columns), "regions")


def connected_components(labels: DataFrame, label: str = "m", diagonal: bool = False) -> DataFrame:
    """labels with comp: the smallest position (y * WIDE + x) of the pixel's region; -1 labels belong to none (comp -1).

    One pass: strips of ``STRIP`` rows are labeled where they are, by union-find over arrays; only images that are taller have regions to join over
    seams, by rounds over the pairs that touch there, as many as a chain of strips halves. A strip of 2048 x 8192 pixels takes about a gigabyte.
    """
    columns = labels.columns
    dealt = labels.withColumn("__strip", F.expr(f"int(y div {STRIP})"))
    dealt = dealt.repartition("image_id", "__strip").sortWithinPartitions("image_id", "__strip", "y", "x").select(*columns)
    marked = materialize(dealt.mapInArrow(_label_strips(columns, label, diagonal), T.StructType([*labels.schema.fields, T.StructField("comp", T.LongType())])), "regions")
    return _over_seams(marked, label, diagonal) if marked.filter(F.col("y") >= STRIP).limit(1).count() else marked


def component_shape(components: DataFrame, label: str = "m") -> DataFrame:
    """image_id, comp, label, area, box and whether a region touches the border."""
    size = Window.partitionBy("image_id")
    df = components.filter("comp >= 0").withColumns({"mx": F.max("x").over(size), "my": F.max("y").over(size)})
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("mx")) | (F.col("y") == F.col("my"))
    return df.groupBy("image_id", "comp").agg(
        F.min(label).alias("label"), F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(edge).alias("on_border")
    )


def despeckle(mask: DataFrame, min_area: int = 2) -> DataFrame:
    """image_id, x, y, m: specks (8-connected ink) and holes (4-connected, not on the border) below min_area flip; both are found on the input."""
    if min_area <= 1:
        return mask.select("image_id", "x", "y", "m")
    ink = connected_components(mask, diagonal=True)
    specks = component_shape(ink).filter((F.col("label") == 1) & (F.col("area") < min_area)).select("image_id", "comp")
    ground = connected_components(mask)
    holes = component_shape(ground).filter((F.col("label") == 0) & (F.col("area") < min_area) & ~F.col("on_border")).select("image_id", "comp")
    flips = ink.join(specks, ["image_id", "comp"], "left_semi").select("image_id", "x", "y").unionByName(ground.join(holes, ["image_id", "comp"], "left_semi").select("image_id", "x", "y"))
    return mask.join(flips.withColumn("flip", F.lit(1)), ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.when(F.col("flip") == 1, 1 - F.col("m")).otherwise(F.col("m")).alias("m"))


def clear_border(mask: DataFrame) -> DataFrame:
    """image_id, x, y, m: ink without the regions that touch the border."""
    regions = connected_components(mask)
    touching = component_shape(regions).filter("label = 1 and on_border").select("image_id", "comp", F.lit(1).alias("gone"))
    return regions.join(touching, ["image_id", "comp"], "left").select("image_id", "x", "y", F.when(F.col("gone") == 1, 0).otherwise(F.col("m")).alias("m"))


def adjacency(labels: DataFrame, label: str = "m") -> DataFrame:
    """image_id, a, b, n: how many pixel sides two labels share (a < b)."""
    df = grid.by_image(labels)
    pairs = None
    for dx, dy in ((1, 0), (0, 1)):
        side = df.select("image_id", F.col(label).alias("u"), grid.shifted(label, dx, dy).alias("v")).filter("u != v and u >= 0 and v >= 0")
        pairs = side if pairs is None else pairs.unionByName(side)
    return pairs.groupBy("image_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def enclosed(labels: DataFrame, label: str = "m") -> DataFrame:
    """image_id, comp, label, area, around: regions off the border whose neighbors all have one label."""
    regions = connected_components(labels, label)
    shape = component_shape(regions, label).filter("not on_border")
    near = grid.by_image(regions)
    around = None
    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        part = near.select("image_id", "comp", F.col(label).alias("own"), grid.shifted(label, dx, dy).alias("o")).filter("o is not null and o != own")
        around = part if around is None else around.unionByName(part)
    one = around.groupBy("image_id", "comp").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo = hi and lo >= 0")
    return shape.join(one, ["image_id", "comp"]).select("image_id", "comp", "label", "area", F.col("lo").alias("around"))


def perimeter(labels: DataFrame, label: str = "m") -> DataFrame:
    """image_id, label, perimeter: pixel sides that face another label or the outside."""
    sides = [F.when(n.eqNullSafe(F.col(label)), 0).otherwise(1) for n in grid.four(label)]
    return grid.by_image(labels).select("image_id", F.col(label).alias("label"), (sides[0] + sides[1] + sides[2] + sides[3]).alias("p")).groupBy("image_id", "label").agg(F.sum("p").alias("perimeter"))


def _votes(df: DataFrame, prefix: str = "n") -> Column:
    return F.filter(F.array(*[F.col(f"{prefix}{i}") for i in range(8)]), lambda v: v.isNotNull() & (v >= 0))


def dissolve_bands(labels: DataFrame, label: str = "m") -> DataFrame:
    """One synchronous round: a pixel with at most 2 like neighbors moves to the label that at least 3 of its neighbors have; most votes, then smallest label."""
    near = grid.with_eight(grid.by_image(labels), label).withColumn("v", _votes(labels))
    own = F.size(F.filter("v", lambda x: x == F.col(label)))
    tally = F.transform(F.array_distinct("v"), lambda k: F.struct((-F.size(F.filter("v", lambda x: x == k))).alias("n"), k.alias("k")))
    best = F.array_min(F.filter(tally, lambda t: t["k"] != F.col(label)))
    moved = (F.col(label) >= 0) & (own <= 2) & (best["n"] <= -3)
    return near.select("image_id", "x", "y", F.when(moved, best["k"]).otherwise(F.col(label)).alias(label))


def potts_round(labels: DataFrame, cost: DataFrame, weight: float, label: str = "m") -> DataFrame:
    """One synchronous Potts round: least of data cost + weight * disagreeing labeled 8-neighbors; candidates are the own label, then neighbors in
    order, and only a cost smaller by 1e-9 moves. cost: image_id, x, y, costs (array by label)."""
    near = grid.with_eight(grid.by_image(labels), label).join(cost, ["image_id", "x", "y"]).withColumn("v", _votes(labels))
    choices = F.array_distinct(F.concat(F.array(label), "v"))
    total = F.transform(choices, lambda k, i: F.struct((F.round(F.element_at("costs", k + 1) + weight * F.size(F.filter("v", lambda x: x != k)), 9)).alias("c"), i.alias("i"), k.alias("k")))
    return near.select("image_id", "x", "y", F.when(F.col(label) < 0, F.col(label)).otherwise(F.array_min(total)["k"]).alias(label))


def region_area_histogram(components: DataFrame) -> DataFrame:
    """image_id, bucket, n: regions by the binary logarithm of their area."""
    return components.filter("comp >= 0").groupBy("image_id", "comp").agg(F.count(F.lit(1)).alias("area")).groupBy("image_id", F.floor(F.log2("area") + 1e-9).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_small(labels: DataFrame, min_area: int = 3, rounds: int = 8, label: str = "m") -> DataFrame:
    """Regions below min_area take the label that most of their outer pixel sides face, ties to the smallest; all small regions of a round move at once."""
    df = labels.select("image_id", "x", "y", label)
    if min_area <= 1:
        return df
    for _ in range(rounds):
        regions = connected_components(df, label)
        small = component_shape(regions, label).filter(F.col("area") < min_area).select("image_id", "comp")
        near = grid.by_image(regions)
        faces = None
        for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            part = near.select("image_id", "comp", F.col(label).alias("own"), grid.shifted(label, dx, dy).alias("o")).filter("o != own and o >= 0")
            faces = part if faces is None else faces.unionByName(part)
        votes = faces.join(small, ["image_id", "comp"], "left_semi").groupBy("image_id", "comp", "o").agg(F.count(F.lit(1)).alias("n"))
        target = votes.groupBy("image_id", "comp").agg(F.min(F.struct((-F.col("n")).alias("n"), "o")).alias("t")).select("image_id", "comp", F.col("t.o").alias("to"))
        target = materialize(target, "merge-targets")
        if not target.limit(1).count():
            break
        df = materialize(regions.join(target, ["image_id", "comp"], "left").select("image_id", "x", "y", F.coalesce("to", label).alias(label)), "merged")
    return df
