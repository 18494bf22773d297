"""Operator 9: embedding near-copies by spherical-cap filters with a structured product code.

The space is cut into blocks of coordinates, each with a small Gaussian code. A filter is
one codeword per block; a unit vector belongs to it when the sum of the block products
reaches a height. Because the sum splits over the blocks, all filters of a vector are
listed from short sorted lists instead of from the whole product code. The height follows
the number of vectors, so that a filter holds a handful of unrelated ones at any size.
Several codes over turned coordinates make up for the correlation within one.

Vectors meet in their common filters, in blocks of bounded size, and are compared in double
precision there; a block emits a spanning forest of its links. Inside the components so
found, every pair of members is compared once, again block by block, to count links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialise, small_enough

CODES = 4
FILTERS_EACH = 6
FILTERS_LEAST = 6
FILTER_MEMBERS = 16
BLOCK = 1024
CODE_BLOCKS = 2
CODE_MOST = 2048
BROADCAST_ROWS = 200_000


def usable(vector: str) -> str:
    """SQL for a vector that is not null, not zero, and has only finite components."""
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"{vector} is not null and size({vector}) > 0 and coalesce({finite}, false) and exists({vector}, x -> x <> 0)"


class ProductCode:
    """Gaussian codes for each block of turned coordinates, and the height that a member's products reach.

    The sums of a product code are correlated, so some vectors reach few filters; such a
    vector gets its ``FILTERS_LEAST`` highest ones.
    """

    def __init__(self, dims: int, vectors: int, seed: int = 11) -> None:
        share = min(0.2, FILTER_MEMBERS / max(1, vectors))
        self.height = NormalDist().inv_cdf(1 - share)
        filters = FILTERS_EACH / share
        blocks = min(dims, CODE_BLOCKS)
        while filters ** (1 / blocks) > CODE_MOST and blocks < dims:
            blocks += 1
        self.size = max(2, math.ceil(filters ** (1 / blocks)))
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.cuts = np.linspace(0, dims, blocks + 1).astype(int)
        self.codes = [rng.standard_normal((hi - lo, self.size)) for lo, hi in zip(self.cuts, self.cuts[1:])]

    def _own_height(self, heads: list[np.ndarray]) -> np.ndarray:
        """The ``FILTERS_LEAST``-th largest sum of each row: its best sums come from the best products of each block."""
        best = np.zeros((len(heads[0]), 1))
        for head in heads:
            few = min(FILTERS_LEAST, head.shape[1])
            top = -np.partition(-head, few - 1, axis=1)[:, :few]
            best = (best[:, :, None] + top[:, None, :]).reshape(len(best), -1)
            few = min(FILTERS_LEAST, best.shape[1])
            best = -np.partition(-best, few - 1, axis=1)[:, :few]
        return best.min(1)

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filters of all memberships of the rows of ``unit``."""
        unit = unit @ self.turn
        heads = [unit[:, lo:hi] @ code for lo, hi, code in zip(self.cuts, self.cuts[1:], self.codes)]
        most = np.stack([h.max(1) for h in heads], 1)
        rest = np.concatenate([np.cumsum(most[:, ::-1], 1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))], 1)
        height = np.minimum(self.height, self._own_height(heads))
        row, sums, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for b, head in enumerate(heads):
            out = []
            for lo in range(0, len(row), 4096):
                own = row[lo : lo + 4096]
                total = sums[lo : lo + 4096, None] + head[own]
                at, word = np.nonzero(total + rest[own, b, None] >= height[own, None] - 1e-9)
                out.append((own[at], total[at, word], name[lo + at] * self.size + word))
            row, sums, name = (np.concatenate(x) for x in zip(*out)) if out else (row, sums, name)
        return row, name


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row of its component."""
    root, left = np.arange(len(near)), near.any(1)
    for start in range(len(near)):
        if not left[start]:
            continue
        inside = np.zeros(len(near), bool)
        inside[start] = True
        edge = inside
        while edge.any():
            edge = near[edge].any(0) & ~inside
            inside |= edge
        root[inside], left[inside] = start, False
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches; a run that spans batches is put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        if held and all(held[0].column(k)[0] == batch.column(k)[0] for k in keys):
            held.append(batch.slice(0, starts[1]))
            starts = starts[1:]
        if len(starts) > 1:
            if held:
                yield pa.Table.from_batches(held)
            for lo, hi in zip(starts[:-2], starts[1:-1]):
                if hi - lo > 1:
                    yield pa.Table.from_batches([batch.slice(lo, hi - lo)])
            held = [batch.slice(starts[-2], starts[-1] - starts[-2])]
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows(key, node)`` dealt to pairs of blocks (i <= j) of at most about ``BLOCK``; ``sizes(key, c)``: members of the large keys."""
    sizes = F.broadcast(sizes) if small_enough(sizes, BROADCAST_ROWS) else sizes
    cut = rows.join(sizes, key, "left").withColumn("k", F.expr(f"cast(ceil(coalesce(c, 1) / {BLOCK}.0) as int)"))
    cut = cut.withColumn("side", F.expr("cast(pmod(xxhash64(node), k) as int)")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return cut.select(key, "node", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))


def near_copies(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id_col, n_links long, component_id long, kept boolean)`` for every row.

    Rows link when their cosine in double precision is at least ``least``. Null or zero vectors
    and ones with null or non-finite components link with nothing, nor do vectors of another
    length than the longest common one. Equal vectors are compared once and all count. A null id
    has a null component and is not kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.expr(usable("v")), F.col("v")))
    dims = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = dims["d"] if dims else 1
    rows = rows.withColumn("v", F.when(F.size("v") == dims, F.col("v"))).withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    kinds = rows.where("v is not null").groupBy("node").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("times"))
    kinds = materialise(kinds, "vectors")
    count = kinds.count()
    codes = [ProductCode(dims, count, seed=11 + k) for k in range(CODES)]

    def members(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("v")))
                for k, code in enumerate(codes):
                    row, name = code.filters(unit)
                    yield pa.RecordBatch.from_arrays([pa.array(name * CODES + k), batch.column("node").take(pa.array(row))], ["filter", "node"])

    def linked(batches):
        for table in _groups(batches, ("filter", "i", "j")):
            unit = _unit(_matrix(table.column("v").combine_chunks()))
            near = unit @ unit.T >= least
            np.fill_diagonal(near, False)
            if near.any():
                root = _forest(near)
                at = np.flatnonzero(root != np.arange(len(root)))
                node = table.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], ["a", "b"])

    def counted(batches):
        for table in _groups(batches, ("comp", "i", "j")):
            unit, times = _unit(_matrix(table.column("v").combine_chunks())), table.column("times").to_numpy()
            node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
            near = unit @ unit.T >= least
            np.fill_diagonal(near, False)
            if table.column("i")[0] != table.column("j")[0]:
                near &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near.astype(np.int64) @ times)], ["node", "links"])

    held = materialise(kinds.mapInArrow(members, "filter long, node long"), "filters")
    alone = held.groupBy("filter").agg(F.count("*").alias("c"))
    met = _block_pairs(held, "filter", alone.where(F.col("c") > BLOCK)).join(kinds.select("node", "v"), "node")
    met = met.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "node")
    edges = materialise(met.mapInArrow(linked, "a long, b long").distinct(), "links")
    comp = components(edges)
    sizes = comp.groupBy("comp").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    met = _block_pairs(comp, "comp", sizes).join(kinds.select("node", "v", "times"), "node")
    met = met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    links = met.mapInArrow(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    named = kinds.select("node", "rep", "times").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").join(links, "node", "left")
    named = named.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select("id", "node").join(named, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: every vector, cosine at least 0.9."""
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
