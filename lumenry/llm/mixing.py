"""Operator 7: mixing sources to target weights, in DataFrame and SQL functions only.

Every source is cut into hash-permuted blocks of about ``BLOCK_WORDS`` words. A source's
target becomes an exact quota of blocks, whole passes first, the last block in part. A
splitting tree deals the quotas to output shards of about ``SHARD_WORDS``: each node halves
its blocks, and the numbers that go left are drawn source by source from hypergeometric
distributions, that is, from the multivariate one. A shard then owns disjoint runs of each
source's blocks and is shuffled locally, by a hash of the row and the shard. The block that is
taken in part gives its rows in that order, so the shard that the tree deals it to decides which.

Only counts of (source, block) are shuffled by ``mix``; the texts stay where they are read unless
the draws are too large for a broadcast. Numbers of blocks, shards and sources have no
bound: running sums go over stretches of blocks first, and a node keeps its sources in
groups, between which it draws before it draws within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import fits, materialise, new_column, unused

BLOCK_WORDS = 20_000
BLOCKS_LEAST = 64
STRETCH = 4_096
SHARD_WORDS = 4_000_000
GROUP = 256
BROADCAST_BYTES = 64 << 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _in_order(totals: DataFrame) -> DataFrame:
    """``totals`` with ``turn``, from 1: the place of each source by code point, null last.

    Ranges of sources are numbered each by itself and put behind one another, so no task sees all sources.
    """
    last = F.col("source").asc_nulls_last()
    ranged = totals.repartitionByRange(last).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(last))), "sources")
    # a row for each range, which the session's partitions bound
    sizes = sorted(ranged.groupBy("part").count().collect())
    before = {r["part"]: sum(x["count"] for x in sizes[:k]) for k, r in enumerate(sizes)}
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    return ranged.withColumn("turn", F.col("own") + offset).drop("part", "own")


def source_targets(totals: DataFrame, most: int = 3, share: float = 1.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until no
    target is above. Each round stops all sources that the level of the last one puts above.
    """
    table = F.array(*map(F.lit, weights))
    weighed = _in_order(totals).withColumn("weight", F.element_at(table, (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int")))
    level = 0.0
    while True:
        stops = F.col("weight") * F.lit(level) > most * F.col("source_size") * (1 + 1e-12)
        row = weighed.agg(
            F.sum("source_size").alias("size"), F.sum(F.when(stops, F.col("source_size"))).alias("stopped"), F.sum(F.when(~stops, F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break
        found = (row["size"] * share - most * (row["stopped"] or 0)) / row["weight"]
        if found <= level:
            break
        level = found
    cap = (F.col("source_size") * most).cast("double")
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def _log_factorial(n: str) -> str:
    return f"(case when {n} < 2 then 0D else {n} * ln({n}) - {n} + 0.5D * ln(2 * pi() * {n}) + 1 / (12D * {n}) - 1 / (360D * pow({n}, 3)) end)"


def _choose(n: str, k: str) -> str:
    return f"({_log_factorial(f'({n})')} - {_log_factorial(f'({k})')} - {_log_factorial(f'({n} - {k})')})"


def _drawn(own: str, rest: str, take: str, chance: str) -> str:
    """A hypergeometric draw: of ``take`` from ``own + rest``, how many are ``own``.

    The density is walked outwards from its mode, alternating sides, until its sum
    passes ``chance``; beyond thirteen deviations nothing is left to find.
    """
    mode = f"cast(greatest(greatest(0, {take} - {rest}), least(least({own}, {take}), floor(({take} + 1D) * ({own} + 1D) / ({own} + {rest} + 2D)))) as bigint)"
    width = f"cast(10 + 13 * sqrt({take} * 1D * {own} / ({own} + {rest}) * greatest(0D, {rest} * 1D / ({own} + {rest}))) as bigint)"
    density = f"exp({_choose(own, 'm.x')} + {_choose(rest, f'({take} - m.x)')} - {_choose(f'({own} + {rest})', take)})"
    up = f"if(s.hi < least({own}, {take}), s.ph * ({own} - s.hi) * ({take} - s.hi) / ((s.hi + 1D) * ({rest} - {take} + s.hi + 1D)), 0D)"
    down = f"if(s.lo > greatest(0, {take} - {rest}), s.pl * s.lo * ({rest} - {take} + s.lo) / (({own} - s.lo + 1D) * ({take} - s.lo + 1D)), 0D)"
    walk = (
        "aggregate(sequence(1L, 2 * m.w), "
        f"named_struct('sum', m.p, 'hi', m.x, 'ph', m.p, 'lo', m.x, 'pl', m.p, 'out', if({chance} <= m.p, m.x, cast(null as bigint))), "
        "(s, i) -> if(s.out is not null, s, if(i % 2 = 1, "
        f"named_struct('sum', s.sum + {up}, 'hi', s.hi + 1, 'ph', {up}, 'lo', s.lo, 'pl', s.pl, "
        f"'out', if({chance} <= s.sum + {up} and {up} > 0, s.hi + 1, cast(null as bigint))), "
        f"named_struct('sum', s.sum + {down}, 'hi', s.hi, 'ph', s.ph, 'lo', s.lo - 1, 'pl', {down}, "
        f"'out', if({chance} <= s.sum + {down} and {down} > 0, s.lo - 1, cast(null as bigint))))), "
        "s -> coalesce(s.out, m.x))"
    )
    outer = f"element_at(transform(array(named_struct('x', {mode}, 'w', {width})), m0 -> named_struct('x', m0.x, 'w', m0.w, 'p', {density.replace('m.x', 'm0.x')})), 1)"
    return f"if({take} <= 0 or {own} <= 0, 0L, if({rest} <= 0, {take}, element_at(transform(array({outer}), m -> {walk}), 1)))"


def _split(seed: int, level: int, counts: str, total: str, take: str, salt: str) -> str:
    """How many of each of ``counts``, which sum to ``total``, are among ``take`` that go left: draws along the array."""
    chance = f"(pmod(xxhash64({seed}, {level}, node, {salt}, size(z.out)), 9007199254740991) + 0.5D) / 9007199254740992D"
    draw = _drawn("c", "(z.have - c)", "z.take", chance)
    return (
        f"aggregate({counts}, named_struct('have', {total}, 'take', {take}, 'out', cast(array() as array<bigint>)), "
        f"(z, c) -> element_at(transform(array({draw}), d -> named_struct('have', z.have - c, 'take', z.take - d, 'out', concat(z.out, array(d)))), 1), "
        "z -> z.out)"
    )


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``(source, shard, lo, hi)``: the run of each source's drawn blocks that a shard owns, from ``(source, units)``.

    A row of the tree is a node and a group of at most about ``GROUP`` sources.
    """
    quotas = quotas.where("units > 0")
    groups = quotas.count() // GROUP + 1
    order = "array_sort(collect_list(named_struct('nul', source is null, 'source', source, 'units', units)))"
    own = quotas.groupBy(F.pmod(F.xxhash64("source"), F.lit(groups)).alias("grp")).agg(F.expr(order).alias("own"))
    nodes = own.selectExpr("transform(own, o -> o.source) sources", "transform(own, o -> o.units) counts", "grp", "0L node")
    for level in range(levels):
        nodes = nodes.withColumn("total", F.expr("aggregate(counts, 0L, (a, c) -> a + c)"))
        if groups == 1:
            nodes = nodes.withColumn("take", F.expr("total div 2"))
        else:
            sums = nodes.groupBy("node").agg(F.expr("array_sort(collect_list(named_struct('grp', grp, 'total', total)))").alias("g"))
            sums = sums.withColumn("have", F.expr("aggregate(g, 0L, (a, x) -> a + x.total)"))
            sums = sums.withColumn("takes", F.expr(_split(seed, level, "transform(g, x -> x.total)", "have", "have div 2", "-1L")))
            sums = sums.selectExpr("node", "inline(transform(g, (x, i) -> named_struct('grp', x.grp, 'take', takes[i])))")
            nodes = nodes.join(sums, ["node", "grp"])
        nodes = nodes.withColumn("left", F.expr(_split(seed, level, "counts", "total", "take", "grp")))
        sides = "explode(array(named_struct('node', 2 * node, 'counts', left), named_struct('node', 2 * node + 1, 'counts', zip_with(counts, left, (c, d) -> c - d))))"
        nodes = nodes.selectExpr("sources", "grp", f"{sides} side").selectExpr("sources", "grp", "side.counts counts", "side.node node")
        if level % 4 == 3:
            nodes = materialise(nodes.repartition("node", "grp"), "split-nodes")
    shards = nodes.selectExpr("node shard", "inline(arrays_zip(sources, counts))").withColumnRenamed("sources", "source").where("counts > 0")
    return running(shards, "shard", {"hi": "counts"}).selectExpr("source", "shard", "hi - counts lo", "hi")


def running(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """``rows(source, ...)`` with running sums per source along the long ``order``, stretch by stretch and then over stretches."""
    inner = rows.withColumn("stretch", F.expr(f"{order} div {STRETCH}"))
    totals = inner.groupBy("source", "stretch").agg(*[F.sum(c).alias(f"{name}_own") for name, c in sums.items()])
    before = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("stretch").alias("t"), *[F.coalesce(F.sum(f"{name}_own").over(before), F.lit(0)).alias(f"{name}_before") for name in sums])
    within = W.partitionBy("source", "stretch").orderBy(order)
    inner = inner.select("*", *[F.sum(c).over(within).alias(name) for name, c in sums.items()])
    met = inner.join(totals, inner.source.eqNullSafe(totals.s) & (inner.stretch == totals.t))
    return met.select(*rows.columns, *[(F.col(name) + F.col(f"{name}_before")).alias(name) for name in sums])


def blocks_of(size: str) -> Column:
    return F.greatest(F.lit(BLOCKS_LEAST), F.expr(f"{size} div {BLOCK_WORDS}")).cast("long")


def draws(sized: DataFrame, seed: int = 7, most: int = 3, share: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``sized(source, key, size)``: targets; per (source, block) the copies drawn; per (source, key) the words of the copy that is drawn in part."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, most, share).withColumn("blocks", blocks_of("source_size"))
    targets = materialise(targets, "targets")
    few = fits(targets, BROADCAST_BYTES)
    small = F.broadcast(targets) if few else targets
    in_source = sized.join(small, sized.source.eqNullSafe(small.source)).select(sized.source, "key", "size", F.pmod("key", "blocks").alias("block"))
    held = in_source.groupBy("source", "block").agg(F.sum("size").alias("words")).where("words > 0").withColumn("one", F.lit(1))
    held = running(held, "block", {"upto": "words", "place": "one"})
    used = held.groupBy("source").agg(F.count("*").alias("used")).withColumnRenamed("source", "s")
    goals = targets.join(used, targets.source.eqNullSafe(F.col("s"))).select(
        "s", "used", F.floor(F.col("target") / F.col("source_size")).alias("passes"),
        F.round(F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).cast("long").alias("rest"),
    )
    goals = F.broadcast(goals) if few else goals
    # the words that the last pass takes of a block; only one block of a source gives some of its words
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - (F.col("upto") - F.col("words"))))
    held = held.join(goals, held.source.eqNullSafe(F.col("s"))).select("source", "block", "words", (F.col("place") - 1).alias("place"), "used", "passes", part.alias("part"))
    held = materialise(held, "blocks")
    units = held.groupBy("source").agg((F.max("used") * F.max("passes") + F.sum((F.col("part") > 0).cast("long"))).alias("units"))
    total = held.agg(F.sum(F.col("words") * F.col("passes") + F.col("part"))).first()[0] or 0
    runs = split_quotas(units, int(total / SHARD_WORDS).bit_length(), seed)
    copies = held.withColumn("copy", F.expr("explode(filter(sequence(0L, passes), p -> p < passes or part > 0))")).selectExpr(
        "source s", "block", "copy", "copy * used + place unit", "if(copy < passes or part = words, cast(null as bigint), part) quota"
    )
    # runs lie end to end: a stretch of units meets the few runs that reach into it
    runs = runs.withColumn("stretch", F.explode(F.expr(f"sequence(lo div {STRETCH}, (hi - 1) div {STRETCH})")))
    copies = copies.withColumn("at", F.expr(f"unit div {STRETCH}"))
    dealt = copies.join(runs, copies.s.eqNullSafe(runs.source) & (F.col("at") == F.col("stretch")) & (F.col("unit") >= F.col("lo")) & (F.col("unit") < F.col("hi")))
    dealt = materialise(dealt.select(F.col("s").alias("source"), "block", "copy", "shard", "quota"), "dealt")
    torn = dealt.where("quota is not null").withColumnsRenamed({"source": "s", "block": "b"})
    torn = F.broadcast(torn) if fits(torn, BROADCAST_BYTES) else torn
    rows = in_source.where("size > 0").join(torn, in_source.source.eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    rows = rows.groupBy("source", "block", "key", "copy", "shard", "quota").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    turn = W.partitionBy("source", "block").orderBy(F.xxhash64("key", "shard"), "key").rowsBetween(W.unboundedPreceding, -1)
    given = F.greatest(F.lit(0), F.least(F.expr("n * size"), F.col("quota") - F.coalesce(F.sum(F.expr("n * size")).over(turn), F.lit(0))))
    rows = rows.withColumn("words", F.floor(given / F.col("n"))).where("words > 0").select("source", "key", "copy", "shard", "words")
    whole = dealt.where("quota is null").groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("copies"))
    return targets, materialise(whole, "draws"), materialise(rows, "parts")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
    most: int = 3,
    share: float = 1.0,
    out_col: str = "mix",
) -> DataFrame:
    """``docs`` with ``out_col`` added: struct of size, source_size, target, taken and copies.

    A copy holds its pass, output shard, words, and place, a random number below 1 that orders
    it in its shard. Rows are told apart by a hash of id and text, so rows that repeat share their
    block and fate; of n such rows in the block that is taken in part each gives the same number of
    words. Null sources are a source, null texts have no words, long ones count whole; an empty
    table stays empty. Own columns are kept; one that is called ``out_col`` is an error.
    """
    own = docs.columns
    new_column(out_col, own)
    m, goal, draw, part, took = (unused(n, own) for n in ("mixed", "goal", "draw", "part", "took"))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    keyed = docs.withColumn(m, F.struct(words_in(F.col(text_col)).alias("size"), key.alias("key")))
    sized = materialise(keyed.select(F.col(source_col).alias("source"), f"{m}.size", f"{m}.key"), "sizes")
    targets, drawn, parts = draws(sized, seed, most, share)
    targets = targets.select(F.struct("source", "source_size", "target", "blocks").alias(goal))
    drawn = drawn.select(F.struct("source", "block", "copies").alias(draw))
    parts = parts.select(F.struct("source", "key", "copy", "shard", "words").alias(part))
    targets, drawn, parts = (F.broadcast(t) if fits(t, BROADCAST_BYTES) else t for t in (targets, drawn, parts))
    met = keyed.join(targets, F.col(source_col).eqNullSafe(F.col(f"{goal}.source")), "left")
    met = met.join(
        drawn, F.col(source_col).eqNullSafe(F.col(f"{draw}.source")) & (F.pmod(f"{m}.key", f"{goal}.blocks") == F.col(f"{draw}.block")), "left"
    )
    met = met.join(parts, F.col(source_col).eqNullSafe(F.col(f"{part}.source")) & (F.col(f"{m}.key") == F.col(f"{part}.key")), "left")
    place = f"(pmod(xxhash64({m}.key, c.shard, c.copy), 9007199254740992) / 9007199254740992D)"
    last = f"if({part} is null, array(), array(named_struct('copy', {part}.copy, 'shard', {part}.shard, 'words', {part}.words)))"
    every = f"concat(transform(coalesce({draw}.copies, array()), c -> named_struct('copy', c.copy, 'shard', c.shard, 'words', {m}.size)), {last})"
    copies = f"transform({every}, c -> named_struct('pass', c.copy, 'shard', c.shard, 'words', c.words, 'place', {place}))"
    return met.withColumn(took, F.expr(copies)).select(
        *[F.col(f"`{c}`") for c in own],
        F.struct(
            F.col(f"{m}.size"),
            F.col(f"{goal}.source_size"),
            F.col(f"{goal}.target"),
            F.expr(f"aggregate({took}, 0L, (a, c) -> a + c.words)").alias("taken"),
            F.col(took).alias("copies"),
        ).alias(out_col),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole rows of ``docs``, one for each copy, shard by shard in the order of their places.

    The row that crosses its block's quota is taken if half of its words are.
    """
    out, copy = unused("mix", docs.columns), unused("copy", docs.columns)
    mixed = mix(docs, out_col=out, **options)
    dealt = mixed.withColumn(copy, F.explode(f"{out}.copies")).where(2 * F.col(f"{copy}.words") >= F.col(f"{out}.size"))
    dealt = dealt.repartition(f"{copy}.shard").sortWithinPartitions(f"{copy}.shard", f"{copy}.place")
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, weights 1, 2, 3 in turn, no source above three times its size."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies")
