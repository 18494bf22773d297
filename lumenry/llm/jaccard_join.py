"""Operator 4: n-gram Jaccard join by grouped prefixes.

Documents become sets of distinct word shingles (64-bit hashes). In one global order,
corpus-wide frequent shingles last, two sets of similarity ``t`` share a shingle among
the first ``n - ceil(t n) + 1`` of each. Documents with the same prefix and size form one
group; only groups enter the inverted lists. Group pairs pass a length, a position and
a parity-bitmap test, all of which never reject a true link, are expanded to their
members, and are verified on the full sets. A parity bitmap has at least as many places
as its set has elements, so that it stays sharp for long texts.

At first a short list pairs its groups with one of them only, and a group enters only its
few longest lists of many groups. Such a list is cut into blocks, and a block gives the
least spanning forest of its passing pairs. Candidates are verified nearest
first and only where they join two components; afterwards every passing pair of any list
that still crosses two components is verified too, so components are those of all links. A set is made again from its text for verification and sent once to each
block that needs it.

Which shingles count as frequent decides speed only: any choice is exact as long as all
documents use the same one. It is taken over all documents, and its number is bounded
by the mean set size times ``FREQUENT_SHARE``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import wordhash
from .graph import components
from .store import materialise, short_batches, small_enough

FREQUENT_LEAST = 12
FREQUENT_SHARE = 4000
FREQUENT_MOST = 1_000_000
BITS = 1024
SMALL_LIST = 24
BLOCK = 1024
FIRST_LISTS = 2
BROADCAST_IDS = 1_000_000
VERIFY_SETS = 1024


def _need(n, percent: int):
    """Least overlap, ceil(percent n / 100), of a set of n with any set linked to it."""
    return -(-n * percent // 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _set_keys(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, equal for equal sets."""
    one = _segment_sums(wordhash.mix(flat), offsets)
    two = _segment_sums(wordhash.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), offsets)
    return wordhash.mix(one ^ wordhash.mix(two + np.diff(offsets).astype(np.uint64)))


def _slices(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        text = batch.column("text")
        for start, end in wordhash.slices(text):
            yield batch.column("id").slice(start, end - start), *wordhash.shingles(text.slice(start, end - start), width)


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and frequency classes of shingles that many documents hold."""

    def repeated(batches):
        for batch in batches:
            parts = [flat for _, flat, _ in _slices([batch], width)]
            value, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            keep = count > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(value[keep])), pa.array(count[keep].astype(np.int64))], ["h", "c"]
            )

    counts = docs.mapInArrow(repeated, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    least = max(FREQUENT_LEAST, docs.count() // FREQUENT_SHARE)
    found = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(FREQUENT_MOST).toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], np.log2(c[order]).astype(np.int8)


def _describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: set size, set key, group key, prefix in the global order, parity bitmap."""
    known, level = frequent_shingles(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast((known, level))

    def levels(flat):
        hashes, classes = shared.value
        out = np.zeros(len(flat), np.int8)
        if len(hashes):
            table = np.zeros(1 << 20, bool)
            table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(table[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, flat[maybe]), len(hashes) - 1)
            hit = hashes[at] == flat[maybe]
            out[maybe[hit]] = classes[at[hit]]
        return out

    def described(batches):
        for ids, flat, offsets in _slices(batches, width):
            rows, n = len(ids), np.diff(offsets)
            level = levels(flat)
            marked = np.add.reduceat(np.append(level, 0) > 0, np.minimum(offsets[:-1], len(flat))) * (n > 0)
            take = np.where(n > 0, n - _need(n, percent) + 1, 0)
            prefix = []
            for r in range(rows):
                own = flat[offsets[r] : offsets[r + 1]]
                if marked[r]:
                    own = own[np.argsort(level[offsets[r] : offsets[r + 1]], kind="stable")[: take[r]]]
                prefix.append(own[: take[r]])
            bounds = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
            first = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            size = np.maximum(BITS, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            places = np.concatenate([[0], np.cumsum(size)])
            row = np.repeat(np.arange(rows), n)
            odd = np.bincount(places[row] + (flat & (size[row] - 1).astype(np.uint64)).astype(np.int64), minlength=places[-1]) & 1
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n.astype(np.int32)),
                    pa.array(_signed(_set_keys(flat, offsets))),
                    pa.array(_signed(_set_keys(first, bounds.astype(np.int64)) ^ n.astype(np.uint64))),
                    pa.ListArray.from_arrays(bounds, pa.array(_signed(first))),
                    pa.ListArray.from_arrays((places // 64).astype(np.int32), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64))),
                ],
                ["id", "n", "cid", "gid", "prefix", "bits"],
            )

    return docs.mapInArrow(described, "id long, n int, cid long, gid long, prefix array<long>, bits array<long>")


def _fits(percent: int, na: str, nb: str) -> str:
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})"


def _least_overlap(percent: int, na: str, nb: str) -> str:
    return f"(({na} + {nb}) * {percent} + {99 + percent}) div {100 + percent}"


def _bitmap_test(percent: int) -> str:
    """The parity bitmaps of two sets differ in no more places than the sets have single elements."""
    return f"apart <= na + nb - 2 * ({_least_overlap(percent, 'na', 'nb')})"


def _folded(bits: str) -> str:
    """A bitmap at the smaller length of a pair; the parities of twice the length fold by exclusive or."""
    least = "least(size(bits_a), size(bits_b))"
    return f"if(size({bits}) = {least}, {bits}, zip_with(slice({bits}, 1, {least}), slice({bits}, {least} + 1, {least}), (p, q) -> p ^ q))"


_APART = f"aggregate(zip_with({_folded('bits_a')}, {_folded('bits_b')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"


def _pairs_within(pdf: pd.DataFrame, percent: int, forest: bool) -> pd.DataFrame:
    """Passing pairs of one block; with ``forest`` a least spanning forest of them, else those across components."""
    pdf = pdf.drop_duplicates("cid")
    cid, n, side = pdf["cid"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["side"].to_numpy()
    pos, comp = pdf["pos"].to_numpy(np.int64), pdf["comp"].to_numpy()
    bits = [b.view(np.uint64) for b in pdf["bits"].to_numpy()]
    length = np.array([len(b) for b in bits])
    row_at, table = np.zeros((len(cid), 2), np.int64), {}
    for words in np.unique(np.concatenate([length, length[length > BITS // 64] // 2])):
        own, twice = np.flatnonzero(length == words), np.flatnonzero(length == 2 * words)
        row_at[own, 0], row_at[twice, 1] = np.arange(len(own)), len(own) + np.arange(len(twice))
        table[words] = np.stack([*(bits[k] for k in own), *(bits[k][:words] ^ bits[k][words:] for k in twice)])
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    label, size = np.unique(comp, return_counts=True)
    probes = np.arange(len(cid)) if forest else np.flatnonzero(comp != label[np.argmax(size)])
    probing = np.zeros(len(cid), bool)
    probing[probes] = True
    found = []
    for p in probes:
        other = np.flatnonzero(
            (100 * np.minimum(n, n[p]) >= percent * np.maximum(n, n[p]))
            & (one | (side != side[p]))
            & (~probing | (cid > cid[p]))
            & (comp != comp[p])
        )
        need = -(-(n[other] + n[p]) * percent // (100 + percent))
        ok = 1 + np.minimum(n[other] - pos[other] - 1, n[p] - pos[p] - 1) >= need
        other, need = other[ok], need[ok]
        apart = np.zeros(len(other), np.int64)
        for words in (length[p], length[p] // 2):
            same = np.flatnonzero(np.minimum(length[other], length[p]) == words)
            if len(same):
                mine, theirs = row_at[p, int(length[p] > words)], row_at[other[same], (length[other[same]] > words).astype(int)]
                apart[same] = np.bitwise_count(table[words][theirs] ^ table[words][mine]).sum(1, dtype=np.int64)
        ok = apart <= n[other] + n[p] - 2 * need
        found.append(np.stack([np.full(ok.sum(), p), other[ok], apart[ok]], 1))
    edges = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if forest and len(edges):
        root = list(range(len(cid)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for k in np.lexsort((cid[edges[:, 1]], cid[edges[:, 0]], edges[:, 2])):
            a, b = find(edges[k, 0]), find(edges[k, 1])
            if a != b:
                root[a] = b
                kept.append(k)
        edges = edges[kept]
    a, b = cid[edges[:, 0]], cid[edges[:, 1]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": edges[:, 2].astype(np.int32)})


def _in_blocks(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Passing pairs of long lists ``rows(key, cid, n, pos, bits, cnt, comp, ...)``, block pair by block pair."""
    cut = rows.withColumn("k", F.expr(f"cast(ceil(cnt / {BLOCK}.0) as int)")).withColumn("side", F.expr("cast(pmod(xxhash64(cid), k) as int)"))
    met = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o")).drop("o", "k", "cnt")
    return met.groupBy("key", "i", "j").applyInPandas(
        lambda pdf: _pairs_within(pdf, percent, forest), "a long, b long, apart int"
    )


def _near_strangers(rows: DataFrame, percent: int) -> DataFrame:
    """Groups ``rows(key, gid, n, comp, apart, ...)`` that may have a link across components left in their long list.

    That is a group whose members are ``apart``, or with a group of another component and about its size in the list.
    Sizes fall into classes a little wider than the length test allows, so partners are at most one class apart.
    """
    step = max(math.log(100 / percent), 0.01) * 1.001
    rows = rows.withColumn("size_class", F.floor(F.log("n") / step).cast("int"))
    held = rows.groupBy("key", "size_class").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("apart").alias("apart"))
    about = held.select("key", F.explode(F.expr("sequence(size_class - 1, size_class + 1)")).alias("size_class"), "lo", "hi", "apart")
    torn = about.groupBy("key", "size_class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("apart").alias("apart"))
    torn = torn.where("lo <> hi or apart").select("key", "size_class")
    return rows.join(torn, ["key", "size_class"], "left_semi")


def _labelled(df: DataFrame, comp: DataFrame, col: str, name: str) -> DataFrame:
    return df.join(comp.select(F.col("node").alias(col), F.col("comp").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))


def _sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``(cid, items)``: the shingle sets of the documents ``reps(id, cid)``, made again from their texts."""

    def made(batches):
        for _, flat, offsets in _slices(batches, width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(_set_keys(flat, offsets))), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(_signed(flat)))],
                ["cid", "items"],
            )

    schema = "cid long, items array<long>"
    ids = reps.select("id").dropna().distinct()
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    held = docs.join(ids, "id", "left_semi").mapInArrow(made, schema)
    unnamed = reps.where("id is null").select("cid")
    if unnamed.isEmpty():
        return held
    # sets that no row with an id holds: found by their key among the rows without one, each once
    own = docs.where("id is null").mapInArrow(made, schema).join(unnamed, "cid", "left_semi")
    return held.unionByName(own.groupBy("cid").agg(F.any_value("items").alias("items")))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges ``(a, b)`` among candidates ``pairs(a, b, apart)`` that span all their links.

    Pairs are dealt to blocks by the component of their candidate graph, large components
    to block pairs, and each set goes once to a block that names it. A block verifies the
    nearest pairs first and leaves out pairs whose ends its links already join.
    """
    comp = components(pairs)
    sizes = comp.groupBy("comp").agg(F.count("*").alias("c"))
    small = max(1, comp.count() // VERIFY_SETS)
    placed = pairs.join(comp.withColumnRenamed("node", "a"), "a").join(sizes, "comp").withColumn("k", F.expr(f"cast(ceil(c / {VERIFY_SETS}.0) as int)"))
    sides = [F.pmod(F.xxhash64(x), F.col("k")) for x in "ab"]
    lone = F.col("k") == 1
    placed = placed.select(
        "a", "b", "apart",
        F.when(lone, F.pmod(F.xxhash64("comp"), F.lit(small))).otherwise(F.col("comp")).alias("block"),
        F.when(lone, F.lit(-1)).otherwise(F.least(*sides)).cast("int").alias("i"),
        F.when(lone, F.lit(-1)).otherwise(F.greatest(*sides)).cast("int").alias("j"),
    )
    key = ["block", "i", "j"]
    placed = materialise(placed, "placed")
    named = placed.select(*[F.col(k).alias(k) for k in key], F.explode(F.array("a", "b")).alias("cid")).distinct()
    reps = named.select("cid").distinct().join(classes.select("cid", F.col("rep").alias("id")), "cid")
    held = _sets(docs, reps, width).join(F.broadcast(named) if small_enough(named, BROADCAST_IDS) else named, "cid")

    def verify(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        items, root = dict(zip(sets["cid"], sets["items"])), {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for a, b in pairs.sort_values(["apart", "a", "b"])[["a", "b"]].itertuples(index=False):
            p, q = find(a), find(b)
            if p != q and a in items and b in items:
                one, two = items[a], items[b]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    root[p] = q
                    kept.append((a, b))
        return pd.DataFrame(kept, columns=["a", "b"])

    met = placed.groupBy(*key).cogroup(held.groupBy(*key))
    return materialise(met.applyInPandas(verify, "a long, b long"), "verified")


def set_keys(column: str, width: int = 5) -> Column:
    """The key of a text's shingle set, equal for equal sets; null for a text without words."""

    def keys(texts: pd.Series) -> pd.Series:
        column, found = pa.array(texts, pa.string()), []
        for start, end in wordhash.slices(column):
            flat, offsets = wordhash.shingles(column.slice(start, end - start), width)
            found += [k if n else None for k, n in zip(_signed(_set_keys(flat, offsets)).tolist(), np.diff(offsets).tolist())]
        return pd.Series(found, dtype="Int64")

    return F.pandas_udf(keys, "long")(F.col(f"`{column}`").cast("string"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, with_keys: bool = False) -> DataFrame:
    """``(id_col, n_shingles long, component_id long)`` for every row of ``docs``; ``with_keys`` adds ``set_key`` as ``set_keys`` gives it.

    Rows link when the Jaccard similarity of their shingle sets is at least
    ``percent`` / 100. ``component_id`` is the smallest id reachable by links.
    Null or empty texts have no shingles and stay alone; texts with fewer words than
    ``width`` are one shingle. Rows that repeat an id are each kept. A null id
    gives a null component and lends its component no name, but its links count. An empty table gives
    no rows. Other columns are neither read nor returned.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = materialise(_describe(docs, width, percent), "described")
    full = every.where("n > 0")
    classes = materialise(
        full.groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits").alias("bits")),
        "classes",
    )
    groups = full.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "h"))
    list_of = W.partitionBy("h")
    lists = postings.withColumn("cnt", F.count("*").over(list_of)).withColumn("hub", F.min(F.struct("gid", "n", "pos")).over(list_of)).where("cnt > 1")
    lists = materialise(lists, "lists")
    short = lists.where(F.col("cnt") <= SMALL_LIST)

    def group_pairs(met: DataFrame) -> DataFrame:
        """Distinct group pairs of ``met(ga, na, pa, gb, nb, pb)`` that pass the length and position tests."""
        met = met.where(_fits(percent, "na", "nb")).where(f"1 + least(na - pa - 1, nb - pb - 1) >= {_least_overlap(percent, 'na', 'nb')}")
        return met.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct()

    def expanded(pairs: DataFrame) -> DataFrame:
        """Group pairs as pairs of their members that pass the bitmap test."""
        left, right = (classes.select(F.col("gid").alias(f"g{s}"), F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
        met = pairs.join(left, "ga").join(right, "gb").where("a <> b").withColumn("apart", F.expr(_APART)).where(_bitmap_test(percent))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart")

    hubs = short.selectExpr("hub.gid ga", "hub.n na", "hub.pos pa", "gid gb", "n nb", "pos pb").where("ga <> gb")
    crowd = classes.groupBy("gid").agg(F.count("*").alias("cnt")).where("cnt > 1")
    same = crowd.where(F.col("cnt") <= SMALL_LIST).select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    few = expanded(group_pairs(hubs).union(same))

    long_rows = lists.where(F.col("cnt") > SMALL_LIST).select(F.col("h").alias("key"), "gid", "pos", "cnt")
    long_rows = long_rows.union(crowd.where(F.col("cnt") > SMALL_LIST).select(F.col("gid").alias("key"), "gid", F.lit(0).alias("pos"), "cnt"))
    longest = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("cnt"), "key"))
    long_rows = materialise(long_rows.withColumn("turn", longest), "long-lists")
    members = classes.select("gid", "cid", "n", "bits", F.col("cid").alias("comp"))
    first = long_rows.where(F.col("turn") <= FIRST_LISTS).join(members, "gid")
    many = _in_blocks(first, percent, True)
    candidates = materialise(few.union(many).distinct(), "candidates")

    edges = _verified(candidates, classes, docs, width, percent)
    comp = components(edges)

    def split_lists(rows: DataFrame, key: str) -> DataFrame:
        """Rows of the lists that hold more than one component; the rest is within one already."""
        torn = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(key)
        return rows.join(torn, key, "left_semi")

    named = materialise(_labelled(classes, comp, "cid", "comp"), "named")
    # a group whose members are apart counts as a component of its own
    of_group = named.groupBy("gid").agg(F.first("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    one = F.col("lo") == F.col("hi")
    of_group = of_group.select("gid", "n", F.when(one, F.col("lo")).otherwise(F.col("gid")).alias("comp"), (~one).alias("apart"))
    # every pair with the hub was a candidate before, so the hub and lists of two have nothing left
    others = short.where("cnt > 2 and gid <> hub.gid").select("h", "gid", "n", "pos")
    torn = split_lists(others.join(of_group.select("gid", "comp"), "gid"), "h")
    x, y = (torn.select("h", F.col("gid").alias(f"g{s}"), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("comp").alias(f"c{s}")) for s in "ab")
    few = expanded(group_pairs(x.join(y, "h").where("ga < gb and ca <> cb")))
    left = _near_strangers(long_rows.join(of_group, "gid"), percent).select("key", "gid", "pos", "cnt")
    many = _in_blocks(left.join(named.select("gid", "cid", "n", "bits", "comp"), "gid"), percent, False)
    crossing = few.union(many).distinct().join(candidates.select("a", "b"), ["a", "b"], "left_anti")
    crossing = materialise(crossing, "crossing")
    if not crossing.isEmpty():
        comp = components(edges.union(_verified(crossing, classes, docs, width, percent)))

    named = _labelled(classes.select("cid", "rep"), comp, "cid", "comp")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").select("cid", "component_id")
    return (
        every.select("id", "n", "cid")
        .join(named, "cid", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
            *([F.when(F.col("n") > 0, F.col("cid")).alias("set_key")] if with_keys else []),
        )
    )


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles, similarity at least 85 in 100, all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)
