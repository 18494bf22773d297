"""Operator 1: best-fit packing by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence. The linear
program over the length histogram asks for the fewest configurations that cover all
pieces. Multiplicative weights solve it: a knapsack dynamic program prices, in one
table, the best configuration through every length, near-best ones are taken, and the
prices of covered lengths fall. The fractional plan is rounded: full configurations are used
as often as their running sum of amounts gains whole numbers, as long as their pieces last. What is left makes a
smaller program, which is solved and rounded again. The few pieces that no such round
places are packed longest first, each time by the fullest configuration they allow.

The plan works on at most ``limit`` counts, whatever the number of documents; only it
runs on the driver. Pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import wordhash
from .store import materialise, short_batches, small_enough
from .tokens import ByteBpe

OFFSET_ROWS = 500_000
SLICE = 1 << 20
ROUNDS = 60
SOLVED = 6
LEAST_GAIN = 0.02
RATE = 0.3
STEP = 0.2
NEAR = 0.5


def knapsack(lengths: np.ndarray, prices: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity up to ``limit`` and the item taken there (-1: none)."""
    best, taken = np.zeros(limit + 1), np.full(limit + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(limit + 1), "right")
    for c in range(1, limit + 1):
        best[c] = best[c - 1]
        if k := fitting[c]:
            value = prices[:k] + best[c - lengths[:k]]
            top = k - 1 - int(value[::-1].argmax())  # of equal ones the longest: short pieces are the ones that fill gaps
            if value[top] > best[c]:
                best[c], taken[c] = value[top], top
    return best, taken


def _follow(capacity: np.ndarray, taken: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Item counts of the knapsack solutions at each capacity (rows: capacities)."""
    left = capacity.copy()
    out = np.zeros((len(left), len(lengths)), np.int32)
    step = np.arange(len(taken))
    for c in range(1, len(taken)):  # the nearest capacity at or below with an item
        step[c] = c if taken[c] >= 0 else step[c - 1]
    while True:
        left = step[left]
        live = np.flatnonzero(taken[left] >= 0)
        if not len(live):
            return out
        item = taken[left[live]]
        np.add.at(out, (live, item), 1)
        left[live] -= lengths[item]


def solve_lp(lengths: np.ndarray, counts: np.ndarray, limit: int, above: int = 0, rounds: int = ROUNDS, rate: float = RATE):
    """Fractional configuration plan: (rows of item counts, amounts), covering no length more than ``counts``.

    A round prices lengths by their size, times a weight that falls exponentially with the share
    that is covered, and takes the best configuration through every length over ``above`` if it is a good one. It covers at most
    ``STEP`` of a length, so that no configuration runs away with the short pieces that many need.
    """
    amounts: dict[bytes, float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    need, idle = float(lengths @ counts) / limit, 0
    for _ in range(rounds):
        rest = counts - covered
        live = np.flatnonzero(rest > 1e-9)
        if not (lengths[live] > above).any():
            break
        prices = lengths[live] / limit * np.exp(-rate * covered[live] / counts[live])
        best, taken = knapsack(lengths[live], prices, limit)
        value = prices + best[limit - lengths[live]]
        near = np.flatnonzero((value >= NEAR * np.median(value)) & (lengths[live] > above))
        plans = _follow(limit - lengths[live][near], taken, lengths[live])
        plans[np.arange(len(near)), near] += 1
        budget, gained = np.minimum(rest, np.maximum(STEP * counts, 1)), 0.0
        full = plans @ lengths[live] == limit
        for k in np.lexsort((-near, ~full)):  # the longest pieces have the fewest configurations
            own = np.flatnonzero(plans[k])
            at, held = live[own], plans[k, own]
            x = float((budget[at] / held).min())
            if x > 1e-9:
                row = np.zeros(len(lengths), np.int32)
                row[at] = held
                amounts[row.tobytes()] += x
                budget[at] -= x * held
                covered[at] += x * held
                gained += x
        idle = idle + 1 if gained < 1e-3 * need else 0
        if idle == 3:
            break
    return np.array([np.frombuffer(k, np.int32) for k in amounts]), np.array(list(amounts.values()))


def _fullest(lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """A subset of the remaining pieces with the largest sum up to ``capacity``, longer ones preferred."""
    mask, sums, trail = (1 << (capacity + 1)) - 1, 1, []
    for n in lengths:
        k = min(left.get(n, 0), capacity // n)
        part = 1
        while k > 0:
            part = min(part, k)
            trail.append((n, part, sums))
            sums |= (sums << (n * part)) & mask
            k -= part
            part *= 2
        if sums >> capacity & 1:
            break
    at, out = sums.bit_length() - 1, defaultdict(int)
    for n, part, before in reversed(trail):
        if not before >> at & 1:
            out[n] += part
            at -= n * part
    return out


def rounded(lengths: np.ndarray, left: dict[int, int], plans: np.ndarray, amounts: np.ndarray, limit: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of the full configurations of a fractional plan; what they hold is taken off ``left``."""
    full = np.flatnonzero(plans @ lengths == limit) if len(plans) else np.zeros(0, np.int64)
    full = full[np.lexsort((full, -amounts[full]))]
    upto = np.floor(np.cumsum(amounts[full]) + 0.5)
    out = []
    for k, use in zip(full, np.diff(upto, prepend=0)):
        if use > 0:
            items = {int(lengths[i]): int(plans[k, i]) for i in np.flatnonzero(plans[k])}
            use = min(int(use), *(left[n] // a for n, a in items.items()))
            if use > 0:
                out.append((items, use))
                for n, a in items.items():
                    left[n] -= a * use
    return out


def plan(histogram: dict[int, int], limit: int) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """Configurations and how often each is used: those of the program, and those that fill the rest.

    Together they hold exactly ``histogram``. Pieces over half a sequence, no two of which go together, come first.
    """
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    solved, rest = [], []
    if limit in left:
        solved.append(({limit: 1}, left.pop(limit)))
    for above, times in ((limit // 2, 1), (0, SOLVED)):
        for _ in range(times):
            lengths = np.array([n for n, c in left.items() if c > 0])
            counts = np.array([c for c in left.values() if c > 0], float)
            if not (lengths > above).any():
                break
            found = rounded(lengths, left, *solve_lp(lengths, counts, limit, above), limit)
            solved += found
            if sum(use for _, use in found) * limit < LEAST_GAIN * float(lengths @ counts):
                break
        order = sorted(left, reverse=True)
        for n in order:
            while n > above and left[n] > 0:
                left[n] -= 1
                items = _fullest([m for m in order if left[m]], left, limit - n)
                left[n] += 1
                items[n] += 1
                use = min(left[m] // a for m, a in items.items())
                rest.append((dict(items), use))
                for m, a in items.items():
                    left[m] -= a * use
    return solved, rest


def slots(plans: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each slot, its first sequence, and its offset in the sequence."""
    rank, first, out = defaultdict(int), 0, defaultdict(list)
    for items, use in plans:
        offset = 0
        for n in sorted(items, reverse=True):
            for _ in range(items[n]):
                out[n].append((rank[n], first, offset))
                rank[n] += use
                offset += n
        first += use
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in out.items()}


def cut(docs: DataFrame, vocabulary: str, limit: int, end_id: int) -> DataFrame:
    """Pieces of every document with their checksum and rank by length within the task."""

    def pieces(batches):
        encoder, seen, part = ByteBpe.load(vocabulary), np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi in wordhash.slices(batch.column("text"), SLICE):
                sizes, sums = [], []
                for text in batch.column("text").slice(lo, hi - lo).to_pylist():
                    raw, size = bytearray(), 0
                    for ids in encoder.parts(text or "", end_id):
                        raw += ids.astype("<u4").tobytes()
                        size += len(ids)
                    sizes.append(size)
                    first = size % limit or limit
                    edges = [0, *range(4 * first, 4 * size + 1, 4 * limit)]
                    view = memoryview(raw)
                    sums += [zlib.crc32(view[a:b]) for a, b in zip(edges, edges[1:])]
                sizes = np.array(sizes, np.int64)
                count = -(-sizes // limit)
                at = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                first = np.where(sizes % limit, sizes % limit, limit)[at]
                size, start = np.where(piece, limit, first), np.where(piece, first + (piece - 1) * limit, 0)
                order = np.argsort(size, kind="stable")
                turn = np.arange(len(at)) - np.searchsorted(size[order], size[order], "left")
                rank = np.empty(len(at), np.int64)
                rank[order] = seen[size[order]] + turn
                seen += np.bincount(size, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo).take(pa.array(at)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(size),
                        pa.array(np.array(sums, np.int64)),
                        pa.array(np.full(len(at), part, np.int32)),
                        pa.array(rank),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return docs.mapInArrow(pieces, "id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(
    docs: DataFrame, vocabulary: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: ``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``.

    Documents longer than ``limit`` ids are cut so that only the first piece may be
    shorter. Null and empty texts are the end id alone. Repeated rows and null ids are
    packed like others; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(cut(docs, vocabulary, limit, end_id), "pieces")
    held = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("c")), "lengths")
    histogram = {r["length"]: r["c"] for r in held.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    places = spark.sparkContext.broadcast(slots(sum(plan(histogram, limit), [])))
    before = held.withColumn("before", F.sum("c").over(W.partitionBy("length").orderBy("part")) - F.col("c")).drop("c")
    before = F.broadcast(before) if small_enough(before, OFFSET_ROWS) else before

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                ranks, first, places_in = places.value[int(length[own[0]])]
                at = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own], offset[own] = first[at] + rank[own] - ranks[at], places_in[at]
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(
        placed,
        f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


@functools.cache
def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, sequences of at most 1024 ids, end id 2."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
