"""Connected components of an edge table: forests within tasks, repeated hooking and pointer jumping across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

LOCAL_EDGES = 1 << 19


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; ``comp`` is the smallest node reachable.

    Tasks of about ``LOCAL_EDGES`` edges turn theirs into stars. Where there are several, a round then hooks
    every root to its smallest neighbour, follows two pointers, and rewrites the edges between roots, so paths
    shrink geometrically, until one task's edges are left. Each join costs the driver jobs, threads and memory,
    so edges that fit one task take none. The rounds' tables of roots are followed one after another at the end. Only the number of edges left reaches the driver.
    Self-loops are allowed, nulls are dropped; no edges give no rows.
    """
    live = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    live = every = materialise(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds, labels = [], None
    while (left := live.count()) > LOCAL_EDGES:
        if labels is None:
            labels = every.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
        stars = materialise(_stars(live, left), "stars").where("x <> p").select(F.col("p").alias("a"), F.col("x").alias("b")).distinct()
        live = materialise(stars, "edges")
        up = materialise(_hooked(live), "parents")
        rounds.append(up)
        ends = live.join(up.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a")
        ends = ends.join(up.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        live = materialise(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if len(rounds) >= 8:
            labels, rounds = materialise(_followed(labels, rounds), "labels"), []
    last = materialise(_stars(live, left), "stars")
    if labels is None:
        return last.select(F.col("x").alias("node"), F.col("p").alias("comp"))
    return materialise(_followed(labels, [*rounds, last]), "labels")


def _stars(live: DataFrame, count: int) -> DataFrame:
    """``(x, p)`` for every node of each task's edges: the smallest node that it reaches by them.

    ``count`` edges are dealt to as few tasks as hold about ``LOCAL_EDGES`` each; a task with more takes them part by part.
    """
    most = LOCAL_EDGES

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield _forest(held)
                held, rows = [], 0
        if rows:
            yield _forest(held)

    return live.coalesce(max(1, -(-count // most))).mapInArrow(contracted, "x long, p long")


def _forest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([x.column(k).to_numpy() for x in batches]) for k in (0, 1))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["x", "p"])


def _hooked(live: DataFrame) -> DataFrame:
    """``(x, p)``: for every end of an edge a smaller node, or itself, that it is joined with."""
    both = live.select(F.col("a").alias("x"), F.col("b").alias("y")).union(live.select("b", "a"))
    up = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p"))
    for _ in range(2):
        over = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
        up = up.join(over, "p").select("x", F.col("q").alias("p"))
    return up


def _followed(labels: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    for up in rounds:
        labels = labels.join(up, labels.comp == up.x, "left").select("node", F.coalesce("p", "comp").alias("comp"))
    return labels
