"""Operator 13: maximal periodic runs of words, by a suffix tree of each text.

Stoye and Gusfield's algorithm. The suffix tree is the tree of intervals of the sorted
suffixes with equal prefixes. For an inner node of depth ``d`` the leaves below all children
but the largest are traversed: a leaf ``i`` whose partner ``i + d`` (or ``i - d``) lies below
the same node is a tandem repeat of period ``d`` that branches, that is, ends where its run ends.
Rotating it to the left as far as words agree gives the whole run; repeats of one stretch merge
into its smallest period.

A run of at least ``LEAST`` words and three periods repeats each of its 16-word windows, one
period on or back. So a text's tree is built over the stretches that repeated windows cover, which hold
every such run with the words that end it, and not at all where no window repeats.
Rows stay where they are: no shuffle, no broadcast, and a lost executor costs its tasks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_column, short_batches

LEAST = 24
PERIODS = 3
WINDOW = 16
CHUNK = 1 << 20
STEP = 2
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of the words, equal for equal words alone."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ``[from, to)`` covered by windows of ``WINDOW`` words that occur twice (by hash: perhaps a few more)."""
    n = len(ids)
    if n < LEAST:
        return []
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < WINDOW:
        value = value[:-width] * np.uint64(0xD6E8FEB86659FD93) + value[width:]
        value ^= value >> np.uint64(29)
        width *= 2
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    if not same.any():
        return []
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cut = np.flatnonzero(np.diff(at) > WINDOW) + 1
    return [(int(part[0]), int(part[-1]) + WINDOW) for part in np.split(at, cut)]


class SuffixTree:
    """Sorted suffixes of ``ids`` with the ranks of their prefixes of 1, 4, 16, ... words."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = n = len(ids)
        _, rank = np.unique(ids, return_inverse=True)
        self.levels, self.widths, width, step = [rank.astype(np.int32)], [1], 1, 0
        while int(rank.max()) + 1 < n:
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            key = rank.astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            width, step = width * 2, step + 1
            if step % STEP == 0:
                self.levels.append(rank.astype(np.int32))
                self.widths.append(width)
        self.rank = rank.astype(np.int64)
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def agree(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Words on which the suffixes at ``a`` and ``b`` (``back``: the prefixes before them) agree."""
        out, n = np.zeros(len(a), np.int64), self.n
        for level in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[level], self.widths[level]
            live = np.arange(len(a))
            while len(live):
                if back:
                    x, y = a[live] - out[live] - width, b[live] - out[live] - width
                    inside = (x >= 0) & (y >= 0)
                else:
                    x, y = a[live] + out[live], b[live] + out[live]
                    inside = (x + width <= n) & (y + width <= n)
                live, x, y = live[inside], x[inside], y[inside]
                same = rank[x] == rank[y]
                live = live[same]
                out[live] += width
        return out

    def nodes(self) -> np.ndarray:
        """``(depth, first, last, first of the largest child, its last)`` per inner node, in ranks."""
        n, found = self.n, []
        common = self.agree(self.order[:-1], self.order[1:]).tolist() + [-1]
        depth, left, best = [0], [0], [(0, -1)]
        for i, low in enumerate(common):
            child, start = (i, i), i
            if low <= depth[-1]:
                if child[1] - child[0] > best[-1][1] - best[-1][0]:
                    best[-1] = child
                while depth and depth[-1] > low:
                    d, start, b = depth.pop(), left.pop(), best.pop()
                    child = (start, i)
                    found.append((d, start, i, *b))
                    if depth and depth[-1] >= low and i - start > best[-1][1] - best[-1][0]:
                        best[-1] = child
            if low >= 0 and (not depth or depth[-1] < low):
                depth.append(low)
                left.append(start)
                best.append(child)
        return np.array(found, np.int64).reshape(-1, 5)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the ranges and the range that each is of."""
    which = np.repeat(np.arange(len(count)), count)
    return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count), which


def tandem_repeats(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the branching tandem repeats that a period more precedes: the ends of runs of three."""
    nodes = tree.nodes()
    d, lo, hi, big_lo, big_hi = nodes[(nodes[:, 0] > 0) & (nodes[:, 0] * PERIODS <= tree.n) & (nodes[:, 2] - nodes[:, 1] + 1 >= PERIODS)].T
    depth, lo, hi = np.tile(d, 2), np.tile(lo, 2), np.tile(hi, 2)
    first, count = np.concatenate([lo[: len(d)], big_hi + 1]), np.concatenate([big_lo - lo[: len(d)], hi[: len(d)] - big_hi])
    starts, periods, at = [], [], 0
    total = np.cumsum(count)
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        member, which = _ranges(first[at:to], count[at:to])
        which += at
        leaf, step = tree.order[member], depth[which]
        for start in (leaf, leaf - step):
            ok = (start - step >= 0) & (start + step < tree.n)
            s, p, w = start[ok], step[ok], which[ok]
            for turn in (0, 1, -1):
                r = tree.rank[s + turn * p]
                below = (r >= lo[w]) & (r <= hi[w])
                s, p, w = s[below], p[below], w[below]
            starts.append(s)
            periods.append(p)
        at = to
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``(start, length, period)`` of all maximal runs of at least ``least`` words and ``PERIODS`` periods, by start and period."""
    found = []
    for lo, hi in repeated_stretches(ids):
        tree = SuffixTree(ids[lo:hi])
        start, period = tandem_repeats(tree)
        left = tree.agree(start, start + period, back=True)
        right = tree.agree(start, start + period)
        begin, length = start - left, left + right + period
        keep = (length >= least) & (length >= PERIODS * period)
        found.append(np.stack([begin[keep] + lo, length[keep], period[keep]], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[fresh]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by single spaces: of each run its first period stays."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def _found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for column in texts:
        n_words, runs, kept = [], [], []
        for text in column:
            words = text.encode("utf-8", "surrogatepass").split() if text is not None else []
            own = runs_of(word_ids(words))
            n_words.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
            kept.append(collapse(words, own).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"n_words": n_words, "runs": runs, "collapsed": kept})


def periodic_runs(docs: DataFrame, text: str = "text", out_col: str = "periodic") -> DataFrame:
    """``docs`` with ``out_col``: ``n_words``, ``runs`` (start, length, smallest period; by start, then period) and ``collapsed``.

    Words are runs of bytes other than the six ASCII blanks. A run is a maximal stretch of at
    least 24 words and three periods. ``collapsed`` is the text without the words that lie in a
    run after its first period. Null, empty and blank texts have no words, no run and an
    empty ``collapsed``; repeated rows each get their own; an empty table gives no rows. A text is held
    whole by its task, with some tens of bytes per word, however long. A column called ``out_col`` is an error.
    """
    new_column(out_col, docs.columns)
    short_batches(docs.sparkSession)
    return docs.withColumn(out_col, F.pandas_udf(_found, _SCHEMA)(F.col(f"`{text}`")))


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` with periodic text put into those whose number's checksum ends in 0, as the query's contract says."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    word = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = docs.select("doc_id", "text", h.alias("h"), word.alias("w")).withColumn("n", F.size("w").cast("long"))
    df = df.withColumn("a", F.when(F.col("n") > 0, F.floor(F.col("h") / 10) % F.col("n")))
    df = df.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.floor(F.col("h") / 10) % 8)))
    made = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return df.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the runs of every whole document. A null ``doc_id`` has no checksum, so nothing is planted in its text."""
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs(docs).select("doc_id", "periodic.*")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.expr(
        "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> "
        "if(b is null or r.length * b.period > b.length * r.period, r, b))"
    )
    found = found.withColumn("best", best).withColumn("lines", line)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.when(F.size("lines") == 0, F.lit("")).otherwise(F.concat(F.array_join("lines", "\n"), F.lit("\n"))), "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
