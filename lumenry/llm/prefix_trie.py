"""Operator 11: the trie of conversation prefixes, from sorted conversations.

Every conversation is a sequence of turns. The different sequences are sorted over the cluster; next to
each stands how many turns it shares with the one before (its LCP). The trie is the Cartesian tree of that
array: an LCP ``v`` with the nearest smaller ones on both sides spans the conversations that share ``v``
turns. Nearest smaller values are found in each block of the sorted order by a stack; those outside the block
lie in the next block whose minimum is smaller, at one of its running minima (``stair``). Equal LCPs of one
interval are one node, and the depths that have the same members as the node below them are expanded at the
end. What a node needs is a difference of running sums at its interval's ends, or a minimum over it.

Texts are read once, for a digest and a length. Copies of a sequence are one row from then on; a block is
a bounded share of all rows, so the driver gets one row of numbers a block and at most ``BLOCKS``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import materialise

BLOCKS = 16_384
BLOCK_ROWS = 4_096
CHUNK_IDS = 4_096
DIGEST = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_ITEM = "block int, idx long, lcp long, size long, cum array<long>, weight long, least long, ends string, first binary, last binary"
_NODE = "rep:long,top:long,depth:long,n_convs:long,n_children:long,n_leaves:long,saved:long,least:long,ends:string,cum:array<long>,up_block:int,up_rep:long,up_least:long"
_OPEN = "rep:long,depth:long,count:long,cum:array<long>,left_here:boolean,right_here:boolean"
_STAIR = "suffix:boolean,idx:long,rep:long,value:long,weight:long,leaves:long,saved:long,least:long,size:long,shared:long,ends:string"
_SUMMARY = "low:long,weight:long,leaves:long,saved:long,least:long"
#: What a block knows, one field filled a row: a node within it, one that reaches beyond, a running minimum, its sums.
_FACT = f"block int, node struct<{_NODE}>, open struct<{_OPEN}>, stair struct<{_STAIR}>, summary struct<{_SUMMARY}>"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the digests and byte lengths of each conversation's turns, in order of turn (null first).

    Turns of one number are ordered by digest; null roles and texts are empty; rows without a ``conv_id`` are of no conversation.
    A conversation is one row of 24 bytes and a few more a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256)
    one = F.struct("turn", F.substring(whole, 1, 2 * DIGEST).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("q")).select("conv_id", F.transform("q", lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))


def rebuilt(own: DataFrame, stride: int = 5, most: int = 9) -> DataFrame:
    """Each conversation ``c`` with its first ``crc32(c) % most`` turns taken from ``c - c % stride`` (none if that is absent)."""
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % most).cast("int")
    base = own.where(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    df = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % stride).join(base, "base", "left")
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.expr("array()").cast(own.schema["turns"].dataType))
    rest = F.filter("turns", lambda t, i: i >= F.col("h"))
    return df.select("conv_id", F.concat(head, rest).alias("turns"))


def _keyed(seqs: DataFrame) -> DataFrame:
    """``conv_id, key, seq, cum``: the sequence's digest, its turns' digests in one binary, and running sums of their bytes."""
    joined = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    sums = F.aggregate("turns", F.array(F.lit(0).cast("long")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["bytes"])))
    return seqs.select("conv_id", F.unhex(F.substring(F.sha2(F.encode(joined, "utf-8"), 256), 1, 2 * DIGEST)).alias("key"), F.unhex(joined).alias("seq"), sums.alias("cum"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``key, conv_id`` rows to comma-joined stretches of at most ``CHUNK_IDS`` ids of one key."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.int64()), ("text", pa.string())])
    key, held = None, []
    made: list[tuple] = []

    def close():
        if held:
            made.append((key, held[0], len(held), ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or len(held) == CHUNK_IDS:
                close()
                key = k
            held.append(c)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches to one row a key: the ids' hash, count and least, the hash fed stretch by stretch."""
    schema = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("weight", pa.int64()), ("ends", pa.string())])
    state, made = None, []

    def close():
        if state:
            made.append((state[0], state[1], state[2], state[3].hexdigest()))

    for batch in batches:
        for key, first, ids, text in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "ids", "text")), strict=True):
            if state and state[0] == key:
                state[3].update(b",")
            else:
                close()
                state = [key, first, 0, hashlib.sha256()]
            state[2] += ids
            state[3].update(text.encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def different(convs: DataFrame, parts: int) -> DataFrame:
    """``seq, cum, weight, least, ends`` of each different sequence; a common one is gathered as stretches of ids, by parts."""
    ids = convs.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    stretches = ids.mapInArrow(_chunks, "key binary, first long, ids long, text string")
    ends = stretches.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, least long, weight long, ends string")
    return convs.groupBy("key").agg(F.any_value("seq").alias("seq"), F.any_value("cum").alias("cum")).join(ends, "key").drop("key")


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    return bisect_left(range(n), True, key=lambda k: a[: (k + 1) * DIGEST] != b[: (k + 1) * DIGEST])


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted block with their place and LCP; the first has -1 and its sequence, and a closing row has the last sequence."""
    schema = pa.schema([("block", pa.int32()), ("idx", pa.int64()), ("lcp", pa.int64()), ("size", pa.int64()), ("cum", pa.list_(pa.int64())), ("weight", pa.int64()), ("least", pa.int64()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary())])
    idx, last, block = 0, None, None
    for batch in batches:
        seqs, lcps = batch.column("seq").to_pylist(), []
        block = batch.column("block")[0].as_py() if batch.num_rows else block
        start = idx
        for s in seqs:
            lcps.append(-1 if last is None else shared_turns(last, s))
            last = s
        idx += len(seqs)
        firsts = [s if start + k == 0 else None for k, s in enumerate(seqs)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("block").cast(pa.int32()), pa.array(range(start, idx), pa.int64()), pa.array(lcps, pa.int64()), pa.array([len(s) // DIGEST for s in seqs], pa.int64()), batch.column("cum").cast(pa.list_(pa.int64())), batch.column("weight"), batch.column("least"), batch.column("ends"), pa.array(firsts, pa.binary()), pa.nulls(len(seqs), pa.binary())],
            schema=schema,
        )
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((block, idx, None, None, None, None, None, None, None, last), schema, strict=True)], schema=schema)


def _boundaries(items: DataFrame) -> dict[int, int]:
    """LCP of each block's first row with the row before it; -1 for the first block. One row a block comes here."""
    edges = materialise(items.where("first is not null or last is not null").groupBy("block").agg(F.max("first").alias("first"), F.max("last").alias("last")), "edges")
    blocks = sorted(r["block"] for r in edges.select("block").collect())
    if not blocks:
        return {}
    before = edges.sparkSession.createDataFrame([(b, a) for a, b in zip(blocks, blocks[1:])] or [(-1, -1)], "block int, prev int")
    pairs = before.join(edges.select("block", "first"), "block").join(edges.select(F.col("block").alias("prev"), F.col("last").alias("end")), "prev")
    shared = F.udf(lambda end, first: shared_turns(bytes(end), bytes(first)), "long")
    return {blocks[0]: -1} | {r["block"]: r["lcp"] for r in pairs.select("block", shared("end", "first").alias("lcp")).collect()}


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo:hi]`` for every pair, none empty, by a table of minima over powers of two."""
    table = [values]
    while 2 * (1 << (len(table) - 1)) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k))])
    return out


def smaller_values(lcp: list[int]) -> tuple[list[list], list[int]]:
    """Nodes ``[value, left, right, first, count, parent]`` of the Cartesian tree and each place's node.

    ``left`` and ``right`` are the places of the nearest smaller values, or None beyond the block's
    ends; equal values of one interval are one node, ``first`` its first place. ``parent`` is a node, or -1.
    """
    nodes: list[list] = []
    of, stack = [], []
    for i, v in enumerate(lcp):
        popped, left = [], i - 1 if i else None
        while stack and nodes[stack[-1]][0] > v:
            k = stack.pop()
            nodes[k][2], left = i, nodes[k][1]
            popped.append(k)
        if stack and nodes[stack[-1]][0] == v:
            nodes[stack[-1]][4] += 1
        else:
            nodes.append([v, left if stack else None, None, i, 1, -1])
            stack.append(len(nodes) - 1)
        for k, above in zip(popped, [*popped, stack[-1]][1:], strict=True):
            nodes[k][5] = above
        of.append(stack[-1])
    return nodes, of


def _facts(first_lcp: dict[int, int]):
    """The function that turns a block's rows into its facts (see ``_FACT``)."""
    blocks = sorted(first_lcp)
    following = dict(zip(blocks, blocks[1:], strict=False))
    schema = to_arrow_schema(StructType.fromDDL(_FACT))

    def facts(table: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.is_valid(table["lcp"])).sort_by("idx")
        block, m = table["block"][0].as_py(), table.num_rows
        lcp = table["lcp"].to_numpy().astype(np.int64)
        lcp[0] = first_lcp[block]
        after = np.append(lcp[1:], first_lcp[following[block]] if block in following else -1)
        size, weight, least = (table[c].to_numpy() for c in ("size", "weight", "least"))
        cum, ends = table["cum"].to_pylist(), table["ends"].to_pylist()
        shared = np.array([c[max(0, v)] for c, v in zip(cum, lcp.tolist(), strict=True)], np.int64)
        extra = np.array([(w - 1) * c[-1] for w, c in zip(weight.tolist(), cum, strict=True)], np.int64)
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in (weight, after < size, extra + shared)]
        nodes, of = smaller_values(lcp.tolist())
        whole = [left is not None and right is not None for _, left, right, *_ in nodes]
        lo, hi = (np.array([n[k] if w else (0, m)[k - 1] for n, w in zip(nodes, whole, strict=True)], np.int64) for k in (1, 2))
        low = _least(least, lo, hi)
        rows: list[dict] = [{"summary": {"low": int(lcp.min()), **_sums(upto, m), "least": int(least.min())}}]

        def up(k: int) -> dict:
            """The way to node ``k`` for those right below it: its least member, or the place of an open node."""
            if nodes[k][0] < 0:
                return {}
            return {"up_least": int(low[k])} if whole[k] else {"up_block": block, "up_rep": nodes[k][3]}

        for k, (v, left, right, rep, count, above) in enumerate(nodes):
            if v < 0:
                continue
            if not whole[k]:
                rows.append({"open": {"rep": rep, "depth": v, "count": count, "cum": cum[rep][: v + 1], "left_here": left is not None, "right_here": right is not None}})
                continue
            n, leaves, saved = (int(x[right] - x[left]) for x in upto)
            node = {"rep": rep, "top": int(max(lcp[left], lcp[right])), "depth": v, "n_convs": n, "n_children": count + int(size[left] > v), "n_leaves": leaves, "saved": saved - int(shared[left])}
            rows.append({"node": node | {"least": int(low[k]), "ends": ends[left] if size[left] == v else None, "cum": cum[left][: v + 1]} | up(above)})
        for i in range(m):
            top = int(max(lcp[i], after[i]))
            if size[i] <= top:
                continue
            if lcp[i] >= after[i]:
                above = up(of[i])
            else:
                above = up(of[i + 1]) if i + 1 < m else {"up_block": following[block], "up_rep": 0}
            node = {"top": top, "depth": int(size[i]), "n_convs": int(weight[i]), "n_children": 0, "n_leaves": 1, "saved": int(extra[i]), "least": int(least[i]), "ends": ends[i], "cum": cum[i]}
            rows.append({"node": node | above})
        for suffix, places in ((False, range(m)), (True, range(m - 1, -1, -1))):
            run, best = None, None
            for i in places:
                here = int(least[i]) if best is None else min(best, int(least[i]))
                if run is None or lcp[i] < run:
                    run = int(lcp[i])
                    stair = {"suffix": suffix, "idx": i, "rep": nodes[of[i]][3], "value": run, **_sums(upto, i), "least": here if suffix else best}
                    rows.append({"stair": stair | {"size": int(size[i]), "shared": int(shared[i]), "ends": ends[i]}})
                best = here
        return pa.Table.from_pylist([{"block": block} | r for r in rows], schema)

    return facts


def _sums(upto: list[np.ndarray], at: int) -> dict[str, int]:
    return {name: int(x[at]) for name, x in zip(("weight", "leaves", "saved"), upto, strict=True)}


def _spanning(opened: DataFrame, stairs: DataFrame, summary: list) -> DataFrame:
    """Nodes over several blocks, from each block's part of them: their ends are found at the stairs of the blocks that end them.

    ``summary`` is one row a block. Of the blocks before and behind, the nearest with a smaller minimum ends a node.
    """
    summary = sorted(summary, key=lambda r: r["block"])
    ids = np.array([r["block"] for r in summary])
    minima, least = (np.array([r[c] for r in summary], np.int64) for c in ("low", "least"))
    before = {c: np.concatenate([[0], np.cumsum([r[c] for r in summary], dtype=np.int64)]) for c in ("weight", "leaves", "saved")}
    nearest = {side: _block_pointers(minima, side) for side in (-1, 1)}

    def targets(batches):
        for pdf in batches:
            ends = []
            for block, depth, left, right in zip(pdf["block"], pdf["depth"], pdf["left_here"], pdf["right_here"], strict=True):
                at = int(np.searchsorted(ids, block))
                both = []
                for side, here in ((-1, left), (1, right)):
                    to = at if here else at + side
                    while not here and 0 <= to < len(ids) and minima[to] >= depth:
                        to = nearest[side][to]
                    both.append(to)
                ends.append(both)
            left, right = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
            between = [int(least[a + 1 : b].min()) if b > a + 1 else None for a, b in zip(left, right, strict=True)]
            inside = right < len(ids)
            pdf = pdf.assign(left_block=ids[left], right_block=np.where(inside, ids[np.minimum(right, len(ids) - 1)], -1), between=pd.array(between, "Int64"))
            for c, x in before.items():
                pdf[f"{c}_left"], pdf[f"{c}_right"] = x[left], x[right]
            yield pdf.drop(columns=["left_here", "right_here"])

    sums = "weight_left long, weight_right long, leaves_left long, leaves_right long, saved_left long, saved_right long"
    sent = opened.mapInPandas(targets, f"block int, rep long, depth long, count long, cum array<long>, left_block int, right_block int, between long, {sums}")
    sent = materialise(sent, "sent")
    for side, suffix in (("left", True), ("right", False)):
        at = stairs.where(F.col("suffix") == F.lit(suffix)).select(F.col("block").alias(f"{side}_block"), "value", F.struct("value", "block", *[c for c in stairs.columns if c not in ("block", "value", "suffix")]).alias("stair"))
        met = sent.select("block", "rep", "depth", f"{side}_block").join(at, f"{side}_block").where("value < depth")
        met = met.groupBy("block", "rep").agg(F.max_by("stair", "value").alias(side))
        sent = sent.join(met, ["block", "rep"], "left")
    value = F.coalesce(F.col("right.value"), F.lit(-1))
    inside = lambda c: F.col(f"{c}_right") + F.coalesce(F.col(f"right.{c}"), F.lit(0)) - F.col(f"{c}_left") - F.col(f"left.{c}")
    anchor = F.when(F.col("left.value") >= value, F.col("left")).otherwise(F.col("right"))
    top = F.greatest(F.col("left.value"), value)
    return sent.select(
        "block", "rep", "depth", "count", "cum", top.alias("top"), inside("weight").alias("n_convs"), inside("leaves").alias("n_leaves"),
        (inside("saved") - F.col("left.shared")).alias("saved"), F.least("left.least", "between", "right.least").alias("least"),
        F.when(F.col("left.size") == F.col("depth"), F.col("left.ends")).alias("ends"), (F.col("left.size") > F.col("depth")).cast("long").alias("longer"),
        F.when(top >= 0, anchor["block"]).alias("up_block"), F.when(top >= 0, anchor["rep"]).alias("up_rep"), F.col("left.block").alias("l_block"), F.col("left.idx").alias("l_idx"),
    )


def _block_pointers(minima: np.ndarray, side: int) -> list[int]:
    """For each block the nearest on one side (-1 before, 1 behind) with a smaller minimum; -1 or the number of blocks if none."""
    n, out, stack = len(minima), [0] * len(minima), []
    for b in range(n) if side < 0 else range(n - 1, -1, -1):
        while stack and minima[stack[-1]] >= minima[b]:
            stack.pop()
        out[b] = stack[-1] if stack else (-1 if side < 0 else n)
        stack.append(b)
    return out


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``seqs(conv_id, turns array<struct<digest, bytes>>)``, ids different: see ``op11`` for the columns.

    Without a sequence there is no node. A node's row is made where its sorted members lie; a common sequence is one row.
    """
    spark = seqs.sparkSession
    convs = materialise(_keyed(seqs), "convs")
    count = convs.count()
    parts = max(1, min(BLOCKS, -(-count // BLOCK_ROWS)))
    items = different(convs, parts).repartitionByRange(parts, "seq").sortWithinPartitions("seq").withColumn("block", F.spark_partition_id())
    items = materialise(items.mapInArrow(_with_lcp, _ITEM), "items")
    first_lcp = _boundaries(items)
    facts = items.drop("first", "last").where("lcp is not null").groupBy("block").applyInArrow(_facts(first_lcp), _FACT)
    facts = materialise(facts, "facts")
    take = lambda c: facts.where(f"{c} is not null").select("block", f"{c}.*")
    own = ["top", "depth", "n_convs", "n_children", "n_leaves", "saved", "least", "ends", "cum", "up_block", "up_rep"]
    opened = materialise(_spanning(take("open"), take("stair"), take("summary").collect()), "opened")
    merged = opened.groupBy("l_block", "l_idx", "depth").agg(
        (F.sum("count") + F.max("longer")).alias("n_children"), *[F.any_value(c).alias(c) for c in own if c not in ("depth", "n_children")]
    )
    nodes = take("node").select(*own, "up_least").unionByName(merged.select(*own, F.lit(None).cast("long").alias("up_least")))
    above = opened.select(F.col("block").alias("up_block"), F.col("rep").alias("up_rep"), F.col("least").alias("open_least"))
    nodes = nodes.join(above, ["up_block", "up_rep"], "left").withColumn("d", F.explode(F.sequence(F.col("top") + 1, F.col("depth"))))
    last = F.col("d") == F.col("depth")
    return nodes.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top") + 1, F.col("least")).otherwise(F.coalesce("up_least", "open_least")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.get("cum", F.greatest(F.col("d") - 1, F.lit(0)).cast("int"))).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(_EMPTY)).alias("ends_sha256"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the prefix trie of all rebuilt ``conversations``.

    Turns of one number come in the order of their digests, repeated rows are repeated turns, rows with a null
    ``conv_id`` belong to none; an empty table gives no node. Texts of any length are read once.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(materialise(turns(rows), "turns")))
