"""Operator 8: nearest neighbours by low-dimensional stable projections and a kd-tree.

Largest inner product becomes nearest distance when every vector gets one more coordinate
that fills it up to the largest norm, and queries are scaled to that norm. A Gaussian
(2-stable) projection to few dimensions turns a squared distance d into d times a
chi-square variable.

One kd-tree divides the projected space into cells. Its cuts are medians of a bounded
sample (``SAMPLE`` rows of smallest hash); every row is then routed to its cell, and a
cell of too many rows is dealt to blocks by hash. A query first searches its own cell,
which gives it a k-th best score. With that bound it goes to just those cells whose box
lies within the reach of the chi-square test, and there again candidates come in order of
projected distance: the nearest ones are verified on the original vectors, the k-th score
rises, and a candidate is left out once its projected distance is so large that one
nearer than the k-th would lie that far out with a probability below ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cap_filters import usable
from .store import materialise

PROJECTED = 16
SAMPLE = 65_536
CELL = 8_192
CELL_SAMPLE = 8
CHUNK = 4_096
TURN = 256
FIRST = 96
PAIRS = 65_536
DENSE = 16
MISS = 0.04
TIE = 1e-9


def chi_square_tail(x: np.ndarray, dims: int) -> np.ndarray:
    """P(chi-square of even ``dims`` > x)."""
    term = total = np.ones_like(x)
    for k in range(1, dims // 2):
        term = term * (x / 2) / k
        total = total + term
    return np.exp(-x / 2) * total


def chi_square_point(miss: float, dims: int) -> float:
    """The value that a chi-square of even ``dims`` exceeds with probability ``miss``."""
    lo, hi = 0.0, 10.0 * dims + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_tail(np.array(mid), dims) > miss else (lo, mid)
    return hi


def projection(dims: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, PROJECTED))


class Space:
    """The largest norm of the candidates, and the projection of candidates and queries."""

    def __init__(self, dims: int, largest: float) -> None:
        self.largest, self.matrix = largest, projection(dims + 1)

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        fill = np.sqrt(np.maximum(0, self.largest**2 - (vectors * vectors).sum(1)))
        return np.column_stack([vectors, fill]) @ self.matrix

    def queries(self, queries: np.ndarray) -> np.ndarray:
        norm = np.sqrt((queries * queries).sum(1))
        return (queries * (self.largest / norm)[:, None]) @ self.matrix[:-1]

    def distance(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Squared distance at which the score of a query is ``kth``; infinite where there is no k-th yet."""
        norm = np.sqrt((queries * queries).sum(1))
        return np.maximum(0, 2 * self.largest**2 - 2 * self.largest * kth / norm)


class Tree:
    """Cuts of a complete kd-tree: at each node the axis of largest spread and the median there of the sample."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth, self.axis, self.cut = depth, np.zeros(2**depth, np.int64), np.zeros(2**depth)
        held = {1: points}
        for node in range(1, 2**depth):
            own = held.pop(node)
            if len(own):
                self.axis[node] = np.ptp(own, axis=0).argmax()
                self.cut[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] >= self.cut[node]
            held[2 * node], held[2 * node + 1] = own[~right], own[right]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[row, self.axis[node]] >= self.cut[node])
        return node - 2**self.depth


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _best(who: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's ``top`` hits, best first, then by id; an id counts once."""
    turn = np.lexsort((ids, -score, who))
    _, at = np.unique(np.stack([who[turn], ids[turn]]), axis=1, return_index=True)
    turn = turn[np.sort(at)]
    rank = np.arange(len(turn)) - np.searchsorted(who[turn], who[turn], "left")
    return turn[rank < top]


def _products(queries: np.ndarray, who: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in the same order wherever a pair is met."""
    parts = [(queries[who[p : p + PAIRS]] * vectors[row[p : p + PAIRS]]).sum(1) for p in range(0, len(who), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def search_block(
    space: Space, ids: np.ndarray, lead: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the hits of one block, and how many candidates each query verified.

    ``kth`` is what a hit of each query must reach at least. Of rows that share an id only the ``lead`` one raises it.
    """
    low, point = space.candidates(vectors), chi_square_point(MISS, PROJECTED)
    norm, verified, out = (low * low).sum(1), np.zeros(len(queries), np.int64), []
    for start in range(0, len(queries), TURN):
        own = queries[start : start + TURN]
        side = space.queries(own)
        far = np.maximum(0, norm[None, :] - 2 * (side @ low.T) + (side * side).sum(1)[:, None])
        far[query_ids[start : start + TURN, None] == ids[None, :]] = np.inf
        bound, best, hits, take = kth[start : start + TURN].copy(), np.full((len(own), top), -np.inf), [], FIRST
        dense = None
        while True:
            far[far > point * space.distance(own, bound)[:, None]] = np.inf  # the stopping test
            take = min(take, len(ids))
            near = np.argpartition(far, take - 1, axis=1)[:, :take]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(far, near, 1)))
            if not len(i):
                break
            row = near[i, j]
            if dense is None and len(i) * DENSE > far.size:  # one product of matrices is cheaper than so many of rows
                dense = own @ vectors.T
            score = dense[i, row] if dense is not None else _products(own, i, vectors, row)
            np.add.at(verified, start + i, 1)
            far[i, row] = np.inf
            hits.append(np.stack([i, row, score])[:, score >= bound[i] - TIE])
            led = np.full((len(own), take), -np.inf)
            led[i, j] = np.where(lead[row], score, -np.inf)
            best = -np.partition(-np.concatenate([best, led], 1), top - 1, axis=1)[:, :top]
            bound, take = np.maximum(bound, best.min(1)), 3 * take
        if hits:
            i, row, score = np.concatenate(hits, 1)
            i, row = i.astype(np.int64), row.astype(np.int64)
            good = np.flatnonzero(score >= bound[i] - TIE)
            score = _products(own, i[good], vectors, row[good])
            best_first = _best(i[good], ids[row[good]], score, top)
            good, score = good[best_first], score[best_first]
            out.append((start + i[good], row[good], score))
    who, row, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return who, row, score, verified


def _meet(base: DataFrame, asked: DataFrame, cells: DataFrame, space: Space, top: int) -> DataFrame:
    """Hits ``(query_id, vec_id, score, verified)`` of ``asked(id, v, kth, cell)`` in the cells named; a row without ``vec_id`` tells how many were verified."""
    chunks = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # both small tables hold a row for each cell, which are at most SAMPLE / CELL_SAMPLE
    left = base.join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    right = asked.join(F.broadcast(cells), "cell").join(F.broadcast(chunks), "cell")
    right = right.withColumn("chunk", F.expr("cast(pmod(xxhash64(id), chunks) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])

    def searched(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, asked_ids = candidates["id"].to_numpy(), queries["id"].to_numpy()
        who, row, score, verified = search_block(
            space, ids, candidates["lead"].to_numpy(), _matrix(candidates["v"]), asked_ids, _matrix(queries["v"]), queries["kth"].to_numpy(), top
        )
        hit = pa.table([asked_ids[who], ids[row], score, np.zeros(len(who), np.int64)], schema=schema)
        count = pa.table([pa.array(asked_ids), pa.nulls(len(asked_ids), pa.int64()), pa.nulls(len(asked_ids), pa.float64()), pa.array(verified)], schema=schema)
        return pa.concat_tables([hit, count])

    key = ["cell", "block", "chunk"]
    left, right = left.select(*key, "id", "lead", "v"), right.select(*key, "id", "v", "kth")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(searched, "query_id long, vec_id long, score double, verified long")


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    each = hits.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top)


def nearest(
    vectors: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank from 1, vec_id, score, verified)``: for each query its ``top`` by inner product, ties to the smaller id.

    A query's own id is no candidate of it. Null or zero vectors, ones with null or non-finite
    components, ones of another than the most frequent length, and null ids take no part. Of rows that
    repeat an id the candidate counts once, by its best score. Fewer candidates than ``top`` give fewer
    rows; empty tables none; vectors may be of any length. The answer is approximate: each neighbour is missed with a
    probability of at most ``MISS``. ``verified`` is the number of candidates that were scored for the query.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return own.where(F.col("id").isNotNull() & F.expr(usable("v")))

    base, asked = materialise(clean(vectors).distinct(), "candidates"), clean(queries)
    shape = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    dims, count = shape["d"], shape["n"]
    base, asked = base.where(F.size("v") == dims), asked.where(F.size("v") == dims).dropDuplicates(["id"])
    largest = base.agg(F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))).first()[0]
    space = Space(dims, max(largest, 1e-300))
    depth = max(0, min(math.ceil(math.log2(count / CELL)), int(math.log2(SAMPLE // CELL_SAMPLE)))) if count > CELL else 0
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow() if depth else None
    tree = Tree(space.candidates(_matrix(sample["v"])) if depth else np.zeros((0, PROJECTED)), depth)
    shared = spark.sparkContext.broadcast((space, tree))

    def routed(side: str):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, cut = shared.value
            for batch in batches:
                if batch.num_rows:
                    cell = cut.cells(getattr(own, side)(_matrix(batch.column("v"))))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        return route

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = shared.value
        lo, hi = np.full((2**cut.depth, PROJECTED), np.inf), np.full((2**cut.depth, PROJECTED), -np.inf)
        for batch in batches:
            if batch.num_rows:
                low = own.candidates(_matrix(batch.column("v")))
                cell = batch.column("cell").to_numpy()
                np.minimum.at(lo, cell, low)
                np.maximum.at(hi, cell, low)
        seen = np.flatnonzero(np.isfinite(lo[:, 0]))
        axis = np.tile(np.arange(PROJECTED, dtype=np.int32), len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seen, PROJECTED)), pa.array(axis), pa.array(lo[seen].reshape(-1)), pa.array(hi[seen].reshape(-1))], ["cell", "axis", "lo", "hi"])

    # of rows that share an id the one with the least vector leads
    first = base.groupBy("id").agg(F.min("v").alias("least"), F.count("*").alias("c")).where("c > 1").select("id", "least")
    base = base.join(first, "id", "left").select("id", F.expr("least is null or v = least").alias("lead"), "v")
    base = base.mapInArrow(routed("candidates"), "id long, lead boolean, v array<double>, cell long")
    base = materialise(base, "routed")
    cells = base.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("blocks"))
    cells = materialise(cells, "cells")
    base = base.join(F.broadcast(cells), "cell").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).drop("blocks")
    sides = base.select("v", "cell").mapInArrow(boxes, "cell long, axis int, lo double, hi double").groupBy("cell", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    corner = np.full((2, 2**depth, PROJECTED), np.nan)
    for batch in sides.toArrow().to_batches():
        at = batch.column("cell").to_numpy(), batch.column("axis").to_numpy()
        corner[0][at], corner[1][at] = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
    corners = spark.sparkContext.broadcast(corner)

    asked = asked.mapInArrow(routed("queries"), "id long, v array<double>, cell long").withColumn("kth", F.lit(float("-inf")))
    asked = materialise(asked, "queries")
    # where the own cell is empty there is nothing to search first
    home = materialise(_meet(base, asked, cells, space, top), "home")
    kth = _ranked(home, top).where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
    asked = asked.join(kth, "id", "left").select("id", "v", F.coalesce("reached", "kth").alias("kth"), F.col("cell").alias("home"))

    def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, _), (lo, hi), point = shared.value, corners.value, chi_square_point(MISS, PROJECTED)
        for batch in batches:
            for start in range(0, batch.num_rows, TURN):
                part = batch.slice(start, TURN)
                queries = _matrix(part.column("v"))
                side, go = own.queries(queries), np.zeros((len(queries), len(lo)), bool)
                reach = point * own.distance(queries, part.column("kth").to_numpy())
                for k, q in enumerate(side):
                    gap = np.maximum(0, np.maximum(lo - q, q - hi))
                    go[k] = (gap * gap).sum(1) <= reach[k]  # false for an empty cell
                go[np.arange(len(queries)), part.column("home").to_numpy()] = False
                i, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(i)) for c in ("id", "v", "kth")), pa.array(cell)], ["id", "v", "kth", "cell"])

    away = materialise(asked.mapInArrow(within_reach, "id long, v array<double>, kth double, cell long"), "away")
    hits = home.unionByName(_meet(base, away, cells, space, top))
    scored = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("own"))
    every = W.partitionBy("query_id")
    scored = scored.withColumn("verified", F.sum("own").over(every)).withColumn("rank", F.row_number().over(every.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("vec_id"))))
    return scored.where((F.col("rank") <= top) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids divisible by 20 ask all other rows for their 20 nearest."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
