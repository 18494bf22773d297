"""Operator 12: documents whose statistics are outliers among those of their language and source.

Each text gives a vector of transformed statistics. Per language and source, the minimum covariance
determinant estimates where its vectors lie and how they scatter: of several starts, concentration
steps keep the half nearest to the last estimate until the determinant falls no further; after three
steps the start with the smallest determinant goes on alone. A document goes if its robust Mahalanobis distance is
beyond a chi-square quantile. Equal vectors of a group count once, so many copies of one text don't
pull the estimate. A scatter never falls below a floor per statistic, as most clean texts have no symbols or
repeats at all. A group with few different vectors is judged by its language's estimate, a small language by that of all.

DataFrame functions alone. Medians and halves come from counts per bin, covariances from sums of
whole numbers, so no row order matters and what is shuffled are counts. Estimates are one row per
group; they are broadcast after a count, and joined by a salted shuffle beyond it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise, new_column, small_enough

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1024
#: Least standard deviation of each statistic.
FLOORS = {"word_length": 0.04, "symbols": 0.5, "lines": 0.05, "repeats": 0.1, "words": 0.5}
#: A clean vector lies beyond the cutoff with this probability.
TAIL = 1e-7
LEAST_VECTORS = 50
STEPS = 25
#: A step counts if the logarithm of the determinant falls by more.
FALL = 1e-3
BINS = 64
BROADCAST_GROUPS = 200_000
SALTS = 16
_P = len(FLOORS)
_X = [f"x{i}" for i in range(_P)]
_KEY = ["level", "g_lang", "g_source"]


def chi_square(tail: float) -> float:
    """Value that a chi-square variable of five degrees exceeds with probability ``tail``."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        x = (lo + hi) / 2
        above = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        lo, hi = (x, hi) if above > tail else (lo, x)
    return lo


def statistics(docs: DataFrame, text: str = "text", out_col: str = "stats") -> DataFrame:
    """``docs`` with ``out_col``: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole text.

    Null texts have no words. Windows of three words are compared by 64-bit hashes; those of a text
    with repeats are sorted within it, so time is in proportion to its length but for a logarithm.
    Columns called ``q_w``, ``q_h``, ``q_g``, ``q_s``, ``q_r`` or ``out_col`` are an error.
    """
    for name in (out_col, "q_w", "q_h", "q_g", "q_s", "q_r"):
        new_column(name, docs.columns)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    df = docs.withColumn("q_w", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    df = df.withColumn("q_h", F.transform("q_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("q_g", F.expr("if(size(q_h) < 3, array(), transform(sequence(0, size(q_h) - 3), i -> xxhash64(q_h[i], q_h[i + 1], q_h[i + 2])))"))
    df = df.withColumn("q_s", F.expr("if(size(array_distinct(q_g)) = size(q_g), null, array_sort(transform(q_g, (g, i) -> struct(g, i))))"))
    twice = "filter(sequence(0, size(q_s) - 1), k -> q_s[k].g = get(q_s, k - 1).g or q_s[k].g = get(q_s, k + 1).g)"
    df = df.withColumn("q_r", F.expr(f"array_sort(transform({twice}, k -> q_s[k].i))"))
    covered = "aggregate(q_r, struct(-3 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)"
    found = F.struct(
        F.size("q_w").cast("long").alias("n_words"),
        F.length(F.array_join("q_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return df.withColumn(out_col, found).drop("q_w", "q_h", "q_g", "q_s", "q_r")


def _vector(stats: str) -> list[Column]:
    """The transformed statistics in units of ``1 / UNIT``, as whole numbers."""
    s = {n: F.col(f"`{stats}`.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    n = F.greatest(s["n_words"], F.lit(1))
    parts = [
        F.log(F.greatest(s["word_chars"], F.lit(1)) / n),
        F.log1p(100 * s["n_symbols"] / n),
        F.sqrt(s["n_dup_lines"] / n),
        F.sqrt(s["n_repeat_words"] / n),
        F.log(n),
    ]
    return [F.round(part * UNIT).cast("long").alias(x) for part, x in zip(parts, _X, strict=True)]


def _failed(stats: str) -> Column:
    n = F.col(f"`{stats}`.n_words")
    return (n < 50) | (100 * F.col(f"`{stats}`.n_repeat_words") > 50 * n)


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with those of ``small`` that have equal keys, nulls equal to nulls; ``small`` is broadcast if its groups are ``few``, else both are salted."""
    names = [c for c in small.columns if c not in keys]
    own = small.select(*[F.col(k).alias(f"q_{k}") for k in keys], *names)
    if few:
        on = [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys]
        return rows.join(F.broadcast(own), on, how).drop(*[f"q_{k}" for k in keys])
    rows = rows.withColumn("q_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    own = own.withColumn("q_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys] + [F.col("q_salt") == F.col("q_salt_")]
    return rows.join(own, on, how).drop("q_salt", "q_salt_", *[f"q_{k}" for k in keys])


def _distance(df: DataFrame) -> DataFrame:
    """``df`` with ``d``, the squared Mahalanobis distance of ``x*`` by centre ``m`` and Cholesky rows ``l``."""
    for i, x in enumerate(_X):
        value = F.col(x) - F.col("m")[i]
        for k in range(i):
            value = value - F.col("l")[i * _P + k] * F.col(f"q_y{k}")
        df = df.withColumn(f"q_y{i}", value / F.col("l")[i * _P + i])
    return df.withColumn("d", sum((F.col(f"q_y{i}") * F.col(f"q_y{i}") for i in range(1, _P)), F.col("q_y0") * F.col("q_y0"))).drop(*[f"q_y{i}" for i in range(_P)])


def _bin(d: Column) -> Column:
    """Bins of 1.6 % of a squared distance."""
    return F.floor(F.log(d + 1e-6) * BINS).cast("long")


def _at_rank(counts: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """``keys`` with the smallest ``value`` up to which at least ``rank`` rows lie, of rows ``keys, value, rank, rows``."""
    upto = F.sum("rows").over(Window.partitionBy(*keys).orderBy(value))
    return counts.withColumn("q_upto", upto).where(F.col("q_upto") >= F.col(rank)).groupBy(*keys).agg(F.min(value).alias(value))


def _estimates(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, m, l, det`` of the vectors in ``chosen``: mean, Cholesky factor of the floored covariance, logarithm of its determinant."""
    sums = [F.count("*").cast("double").alias("q_n"), *[F.sum(F.col(x).cast("double")).alias(f"q_s{i}") for i, x in enumerate(_X)]]
    pairs = [(i, k) for i in range(_P) for k in range(i + 1)]
    sums += [F.sum((F.col(_X[i]) * F.col(_X[k])).cast("double")).alias(f"q_c{i}{k}") for i, k in pairs]
    df = chosen.groupBy(*keys).agg(*sums)
    floors = [(UNIT * f) ** 2 for f in FLOORS.values()]
    for i, k in pairs:
        cov = (F.col(f"q_c{i}{k}") - F.col(f"q_s{i}") * F.col(f"q_s{k}") / F.col("q_n")) / F.greatest(F.col("q_n") - 1, F.lit(1.0))
        rest = cov + (floors[i] if i == k else 0.0)
        for j in range(k):
            rest = rest - F.col(f"q_l{i}{j}") * F.col(f"q_l{k}{j}")
        df = df.withColumn(f"q_l{i}{k}", F.sqrt(F.greatest(rest, F.lit(floors[i] / 4))) if i == k else rest / F.col(f"q_l{k}{k}"))
    zero = F.lit(0.0)
    return df.select(
        *keys,
        F.array(*[F.col(f"q_s{i}") / F.col("q_n") for i in range(_P)]).alias("m"),
        F.array(*[F.col(f"q_l{i}{k}") if k <= i else zero for i in range(_P) for k in range(_P)]).alias("l"),
        sum((2 * F.log(F.col(f"q_l{i}{i}")) for i in range(_P)), zero).alias("det"),
    )


def _medians(vectors: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """Per group the coordinates' medians and, as a diagonal factor, their median deviations."""
    each = vectors.select(*_KEY, F.posexplode(F.array(*_X)).alias("i", "x"))
    counts = _joined(each.groupBy(*_KEY, "i", "x").agg(F.count("*").alias("rows")), sizes, _KEY, few).withColumn("rank", F.ceil(F.col("n") / 2))
    middle = materialise(_at_rank(counts, [*_KEY, "i"], "x", "rank").withColumnRenamed("x", "mid"), "medians")
    away = _joined(counts, middle, [*_KEY, "i"], few).withColumn("x", F.abs(F.col("x") - F.col("mid")))
    away = away.groupBy(*_KEY, "i", "x", "rank").agg(F.sum("rows").alias("rows"))
    spread = _joined(_at_rank(away, [*_KEY, "i"], "x", "rank"), middle, [*_KEY, "i"], few)
    floors = F.array(*[F.lit(UNIT * f) for f in FLOORS.values()])
    spread = spread.withColumn("l", F.greatest(1.4826 * F.col("x"), floors[F.col("i")]))
    by_i = spread.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("i", F.col("mid").cast("double").alias("mid"), "l"))).alias("q"))
    diagonal = F.array(*[F.col("q")[i]["l"] if i == k else F.lit(0.0) for i in range(_P) for k in range(_P)])
    return by_i.select(*_KEY, F.transform("q", lambda q: q["mid"]).alias("m"), diagonal.alias("l"), F.lit(math.inf).alias("det"))


def estimate(vectors: DataFrame) -> DataFrame:
    """Robust centre ``m``, factor ``l`` and distance ``scale`` of each group in ``vectors(level, g_lang, g_source, x*)`` of at least ``LEAST_VECTORS`` rows."""
    sizes = materialise(vectors.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_VECTORS), "sizes")
    few = small_enough(sizes, BROADCAST_GROUPS)
    vectors = materialise(_joined(vectors, sizes, _KEY, few), "vectors")
    half = F.floor((F.col("n") + _P + 1) / 2)
    classical = _estimates(vectors, _KEY).withColumns({"start": F.lit(1), "det": F.lit(math.inf)})
    fit = materialise(_medians(vectors, sizes, few).withColumn("start", F.lit(0)).unionByName(classical), "fit")
    for step in range(STEPS):
        new = materialise(_concentrated(vectors, fit, half, few), "fit")
        done, fit = new.where("falls").isEmpty(), new.drop("falls")
        if step == 2:
            fit = materialise(_best(fit), "fit")
        if done:
            break
    best = materialise(_best(fit), "best")
    near = _distance(_joined(vectors, best, _KEY, few)).withColumn("bin", _bin(F.col("d")))
    counts = near.groupBy(*_KEY, "bin", F.ceil(F.col("n") / 2).alias("rank")).agg(F.count("*").alias("rows"))
    scale = F.greatest(F.lit(1.0), F.exp(F.col("bin") / BINS) / chi_square(0.5))
    return materialise(_joined(best, _at_rank(counts, _KEY, "bin", "rank").select(*_KEY, scale.alias("scale")), _KEY, few), "estimates")


def _best(fit: DataFrame) -> DataFrame:
    """Of each group the start with the smallest determinant."""
    best = fit.groupBy(*_KEY).agg(F.min_by(F.struct("start", "m", "l", "det"), F.struct("det", "start")).alias("f"))
    return best.select(*_KEY, "f.*")


def _concentrated(vectors: DataFrame, fit: DataFrame, half: Column, few: bool) -> DataFrame:
    """One concentration step of every start: the estimates of the nearest half, where the determinant ``falls`` by that."""
    keys = [*_KEY, "start"]
    side = fit.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "m", "l")).alias("q_starts"))
    near = _joined(vectors, side, _KEY, few).withColumn("q_one", F.explode("q_starts"))
    near = _distance(near.select(*vectors.columns, "q_one.*")).withColumn("bin", _bin(F.col("d")))
    counts = near.groupBy(*keys, "bin", half.alias("h")).agg(F.count("*").alias("rows"))
    cut = _at_rank(counts, keys, "bin", "h").withColumnRenamed("bin", "cut")
    inside = _joined(near, cut, keys, few).where(F.col("bin") <= F.col("cut"))
    last = fit.select(*keys, *[F.col(c).alias(f"{c}_") for c in ("m", "l", "det")])
    new = _joined(_estimates(inside, keys), last, keys, few)
    falls = F.col("det") < F.col("det_") - FALL
    return new.select(*keys, *[F.when(falls, F.col(c)).otherwise(F.col(f"{c}_")).alias(c) for c in ("m", "l", "det")], falls.alias("falls"))


def judge(rows: DataFrame, stats: str = "stats", lang: str = "lang", source: str = "source", out_col: str = "quality") -> DataFrame:
    """``rows`` with ``out_col``: ``base_failed``, ``distance`` (squared, scaled; null where no estimate holds), ``level`` and ``kept``.

    ``rows`` has the struct of ``statistics`` and is read twice, so give a written table. A text
    fails at once with fewer than 50 words or over half of them in repeated windows; such texts
    take no part in the estimates and have no distance. ``level`` is 2 where language and source have
    ``LEAST_VECTORS`` different vectors, 1 where the language has, 0 where all have; else nothing is rejected.
    Null languages and sources are groups like any other, repeated rows are each judged, and an empty table gives no rows.
    """
    new_column(out_col, rows.columns)
    by = [F.col(f"`{c}`").cast("string").alias(g) for c, g in ((lang, "g_lang"), (source, "g_source"))]
    own = rows.where(~_failed(stats)).select(*by, *_vector(stats)).distinct()
    none, lang_, source_ = F.lit(None).cast("string"), F.col("g_lang"), F.col("g_source")
    level = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.alias("g_lang"), b.alias("g_source"))
    levels = F.array(level(2, lang_, source_), level(1, lang_, none), level(0, none, none))
    vectors = own.select(F.explode(levels).alias("k"), *_X).select("k.*", *_X).distinct()
    found = estimate(materialise(vectors, "vectors"))
    groups = materialise(rows.select(*by).distinct(), "groups")
    few = small_enough(groups, BROADCAST_GROUPS)
    f = F.struct("level", "m", "l", "scale")
    for n in (2, 1, 0):
        at = found.where(F.col("level") == n).select("g_lang", "g_source", f.alias(f"f{n}"))
        keys = [["g_lang", "g_source"], ["g_lang"], []][2 - n]
        at = at.select(*keys, f"f{n}")
        groups = _joined(groups, at, keys, few, "left") if keys else groups.join(F.broadcast(at), how="left")
    groups = groups.select("g_lang", "g_source", F.coalesce("f2", "f1", "f0").alias("q_f"))
    wide = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("q_row"), *by, _failed(stats).alias("base_failed"), *_vector(stats))
    wide = _joined(wide, materialise(groups, "groups"), ["g_lang", "g_source"], few, "left")
    wide = _distance(wide.withColumns({"m": F.col("q_f.m"), "l": F.col("q_f.l")}))
    distance = F.when(~F.col("base_failed"), F.col("d") / F.col("q_f.scale"))
    wide = wide.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(TAIL), F.lit(True))
    return wide.select("q_row.*", F.struct("base_failed", "distance", F.col("q_f.level").alias("level"), kept.alias("kept")).alias(out_col))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    rows = materialise(statistics(docs).drop("text"), "statistics")
    return judge(rows).select("doc_id", "stats.*", "quality.base_failed", "quality.kept", "quality.distance", "quality.level")
