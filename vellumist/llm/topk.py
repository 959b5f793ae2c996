"""Exact top-k inner-product search by columnar branch and bound.

Vectors are integers, floor(256 * x). Candidates stay where they are read; queries go to them in blocks of
``QUERY_BLOCK`` rows, the proven bound of what is sent at once, one pass over the candidates each. A pass keeps
a batch of candidates in vertical layout (one contiguous row per dimension) and adds up, for each query, one
block of dimensions after another. After each block a candidate's score can still grow by at most
|query rest| * |candidate rest| (Cauchy-Schwarz on the remaining mass); candidates that cannot reach the query's
k-th best score so far are compacted away before the next block. Ties survive, as only a bound strictly below the
k-th score removes. Each task gives at most k rows a query; a window over those picks the k best. As each task cuts to k rows and the bounds
count rows, candidates are made distinct before the search.

Defined cases: null vectors and vectors with a null or non-finite component take no part, neither do rows
without an id; vectors of different lengths are compared as if the shorter went on with zeros; a query never meets rows of its own id,
and rows that repeat both id and vector count once; a repeated query id with other vectors keeps, as query, the largest vector
in array order; empty vectors score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.runtime import materialize

QUERY_BLOCK = 4096
DIM_BLOCK = 8
SCALE = 256


def quantize(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column, zero-padded to dims at least."""
    lengths = np.diff(lists.offsets.to_numpy())
    dims = max(dims, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[rows, np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def _rest(columns: np.ndarray, block: int) -> np.ndarray:
    """Norm of what is left of each vector from every block's start on: (blocks + 1, n), rounded up."""
    mass = np.add.reduceat(columns.astype(np.float64) ** 2, np.arange(0, max(1, len(columns)), block), axis=0) if len(columns) else np.zeros((0, columns.shape[1]))
    left = np.vstack([np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))])
    return np.sqrt(left) * (1 + 1e-9) + 1e-6


class Searcher:
    """The k best of all batches seen, for one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        dims = max(rows.shape[1], self.queries.shape[1])
        queries = np.pad(self.queries, ((0, 0), (0, dims - self.queries.shape[1])))
        rows = np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))
        order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")  # heavy dimensions first
        columns, wanted = np.ascontiguousarray(rows.T[order]), queries[:, order]
        rest, query_rest = _rest(columns, DIM_BLOCK), _rest(np.ascontiguousarray(wanted.T), DIM_BLOCK)
        for q, own in enumerate(self.ids):
            alive = np.flatnonzero(ids != own)
            if not len(alive):
                continue
            score, floor = np.zeros(len(alive), np.int64), self._floor(q)
            if floor is None and len(alive) > self.k:  # a first guess of the k-th score: any k candidates bound it from below
                some = alive[:: max(1, len(alive) // (8 * self.k))]
                floor = np.partition(wanted[q] @ columns[:, some], -self.k)[-self.k] if len(some) >= self.k else None
            for b, at in enumerate(range(0, dims, DIM_BLOCK)):
                part = columns[at : at + DIM_BLOCK]
                score = score + wanted[q, at : at + DIM_BLOCK] @ (part if len(alive) == columns.shape[1] else part[:, alive])
                bound = query_rest[b + 1, q] * rest[b + 1][alive]
                if len(alive) > self.k:
                    low = np.partition(score - bound, -self.k)[-self.k]
                    floor = low if floor is None else max(floor, low)
                if floor is not None:
                    stay = score + bound >= floor
                    if not stay.all():
                        alive, score = alive[stay], score[stay]
                if not len(alive):
                    break
            self._merge(q, ids[alive], score)

    def _floor(self, q: int):
        scores = self.best[q][1]
        return scores[-1] if len(scores) == self.k else None

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[q][0], ids]), np.concatenate([self.best[q][1], scores])
        top = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = (ids[top], scores[top])


def search_block(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k best of every task for each query of a block."""
    sent = candidates.sparkSession.sparkContext.broadcast((ids, queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*sent.value, k)
        for batch in batches:
            if batch.num_rows:
                searcher.add(batch.column(0).to_numpy(), _matrix(batch.column(1), 0))
        counts = [len(x) for x, _ in searcher.best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(sent.value[0], counts)),
                pa.array(np.concatenate([x for x, _ in searcher.best]) if counts else np.empty(0, np.int64)),
                pa.array(np.concatenate([s for _, s in searcher.best]) if counts else np.empty(0, np.int64)),
            ],
            names=["query_id", "id", "score"],
        )

    return candidates.mapInArrow(scan, "query_id long, id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of every query row, ties to the smaller id."""
    chosen = F.col(vector_col)
    ready = vectors.filter(usable(chosen) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantize(chosen).alias("v"), is_query.alias("q"))
    queries = materialize(ready.filter("q").groupBy("id").agg(F.max("v").alias("v")), "topk-queries")
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    # Copies of a row would fill the k places of a task and push other neighbours out.
    rows = ready.select("id", "v").distinct()
    if n > QUERY_BLOCK:
        rows = materialize(rows, "topk-rows")
    found = None
    block_of = F.pmod(F.xxhash64("id"), F.lit(2 * blocks))
    for b in range(2 * blocks if n > QUERY_BLOCK else 1):
        block = queries if n <= QUERY_BLOCK else queries.filter(block_of == b)
        table = block.orderBy("id").toArrow()
        if not table.num_rows:
            continue
        lists = table.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        part = search_block(rows, table.column("id").to_numpy(), _matrix(lists, 0), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = ready.select(F.col("id").alias("query_id"), F.col("id"), F.lit(0).cast("long").alias("score")).limit(0)
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
