"""Sessions of shots in list order, and culling within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import BURST_GAP_MS


def bursts(shots: DataFrame, by: list[str], max_gap_ms: int = BURST_GAP_MS, pos: str = "pos", taken: str = "taken_ms") -> DataFrame:
    """``shots`` with ``burst``, numbered from 0 along ``pos`` within ``by``.

    A gap from 0 to ``max_gap_ms``, both included, goes on; an unknown time on either side or a
    step back begins a new burst.
    """
    order = W.partitionBy(*by).orderBy(pos)
    gap = F.col(taken) - F.lag(taken).over(order)
    goes_on = F.coalesce(gap.between(0, max_gap_ms), F.lit(False))
    flagged = shots.withColumn("burst", F.when(goes_on, 0).otherwise(1))
    return flagged.withColumn("burst", (F.sum("burst").over(order) - 1).cast("long"))


def burst_ranges(marked: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Half-open ranges of positions of each burst."""
    return marked.groupBy(*by, "burst").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.count("*").alias("size"))


def burst_stats(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Number of bursts, of single ones, and the upper median and the largest size."""
    order = W.partitionBy(*by)
    ranked = ranges.withColumn("at", F.row_number().over(order.orderBy("size", "burst"))).withColumn("n", F.count("*").over(order))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("bursts"),
        F.count_if(F.col("size") == 1).alias("singles"),
        F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("size"))).alias("median_size"),
        F.max("size").alias("largest"),
    )


def sharpest(marked: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """The sharpest measured shot of each burst with two or more measured ones.

    Banded shots count only where all are banded; of equals the last wins.
    """
    measured = marked.where(F.col("sharpness").isNotNull())
    best = F.max_by(pos, F.struct(~F.col("banded"), F.col("sharpness"), F.col(pos)))
    found = measured.groupBy(*by, "burst").agg(F.count("*").alias("measured"), best.alias("best"))
    return found.where("measured >= 2").select(*by, "burst", "best")


def is_kept(rank: Column, color: Column, in_trash: Column) -> Column:
    return ~in_trash & ((rank > 0) | (color != 0))


def keep(marked: DataFrame, best: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Marks after keeping the best shot of its burst: it gets a rank of at least 1, the others are trashed.

    A burst with an unreadable mark (null rank) stays as it is and is left out.
    """
    burst = W.partitionBy(*by, "burst")
    met = marked.join(best, [*by, "burst"]).withColumn("broken", F.max(F.col("rank").isNull()).over(burst)).where("not broken")
    chosen = F.col(pos) == F.col("best")
    return met.select(
        *by, "burst", pos,
        F.when(chosen, F.greatest("rank", F.lit(1))).otherwise(F.col("rank")).alias("rank"),
        "color",
        (~chosen).alias("in_trash"),
    )


def reject(marked: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Marks after trashing whole bursts; a burst with an unreadable mark is left out."""
    burst = W.partitionBy(*by, "burst")
    met = marked.withColumn("broken", F.max(F.col("rank").isNull()).over(burst)).where("not broken")
    return met.select(*by, "burst", pos, "rank", "color", F.lit(True).alias("in_trash"))


def progress(marks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of kept, rejected, unsorted, unread and unreadable shots."""
    ok = (F.col("state") == "read")
    kept = is_kept(F.col("rank"), F.col("color"), F.col("in_trash"))
    return marks.groupBy(*by).agg(
        F.count_if(ok & kept).alias("kept"),
        F.count_if(ok & F.col("in_trash")).alias("rejected"),
        F.count_if(ok & ~kept & ~F.col("in_trash")).alias("unsorted"),
        F.count_if(F.col("state") == "unread").alias("unread"),
        F.count_if(F.col("state") == "unreadable").alias("unreadable"),
    )


def is_shown(which: str) -> Column:
    """Whether a filter shows a row, see ``shown``."""
    if which == "all":
        return F.lit(True)
    kept = is_kept(F.col("rank"), F.col("color"), F.col("in_trash"))
    own = {"unsorted": ~kept & ~F.col("in_trash"), "kept": kept, "rejected": F.col("in_trash")}[which]
    return F.coalesce((F.col("state") == "read") & own, F.lit(False))


def shown(marks: DataFrame, which: str) -> DataFrame:
    """Rows that a filter shows: all, unsorted, kept or rejected. Unread marks show under ``all`` alone."""
    return marks if which == "all" else marks.where(is_shown(which))


def next_shown(marks: DataFrame, which: str, by: list[str], pos: str = "pos") -> DataFrame:
    """Each row with the nearest shown position after and before it."""
    at = F.when(is_shown(which), F.col(pos))
    before, after = (W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1) for order in (F.asc(pos), F.desc(pos)))
    return marks.select(*by, pos, F.min(at).over(after).alias("next_pos"), F.max(at).over(before).alias("previous_pos"))


def growing(times: DataFrame, by: list[str], max_gap_ms: int = BURST_GAP_MS, pos: str = "pos") -> DataFrame:
    """Bursts where some times are not read yet: ``times(by, pos, state, taken_ms)``, state ``unknown`` or ``read``.

    A burst is complete unless an unknown time stands at one of its ends, where it may still grow.
    """
    order = W.partitionBy(*by).orderBy(pos)
    known = times.withColumn("taken_ms", F.when(F.col("state") == "read", F.col("taken_ms")))
    marked = bursts(known, by, max_gap_ms, pos)
    marked = marked.withColumn("before", F.lag("state").over(order)).withColumn("after", F.lead("state").over(order))
    own = W.partitionBy(*by, "burst")
    first, last = F.col(pos) == F.min(pos).over(own), F.col(pos) == F.max(pos).over(own)
    doubt = (F.col("state") == "unknown") | (first & (F.col("before") == "unknown")) | (last & (F.col("after") == "unknown"))
    return marked.withColumn("doubt", F.coalesce(doubt, F.lit(False))).groupBy(*by, "burst").agg(
        F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), (~F.max("doubt")).alias("complete")
    )
