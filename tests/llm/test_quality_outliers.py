"""Operator 12 against a plain NumPy version, and what it keeps and rejects."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.llm import quality_outliers as Q
from lumenry.llm.store import materialise

BLANK = r"[\x20\x09-\x0D]+"


def plain_statistics(text):
    words = [w for w in re.split(BLANK, text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice, seen = Counter(windows), set()
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    dup = 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def plain_vector(s):
    n = max(1, s[0])
    parts = np.log(max(1, s[1]) / n), np.log1p(100 * s[2] / n), np.sqrt(s[3] / n), np.sqrt(s[4] / n), np.log(n)
    return tuple(int(np.floor(p * Q.UNIT + 0.5)) for p in parts)


def bins(d):
    return np.floor(np.log(d + 1e-6) * Q.BINS).astype(int)


def plain_estimate(vectors):
    """Centre, inverse covariance and scale of the vectors by minimum covariance determinant."""
    x = np.array(sorted(vectors), float)
    n = len(x)
    floors = np.array(list(Q.FLOORS.values())) * Q.UNIT
    mid = np.sort(x, 0)[(n + 1) // 2 - 1]
    spread = np.maximum(1.4826 * np.sort(abs(x - mid), 0)[(n + 1) // 2 - 1], floors)
    cov = lambda y: np.cov(y.T) + np.diag(floors**2)
    away = lambda fit: np.einsum("ij,jk,ik->i", x - fit[0], np.linalg.inv(fit[1]), x - fit[0])
    fits = [(mid, np.diag(spread**2), np.inf), (x.mean(0), cov(x), np.inf)]
    for step in range(Q.STEPS):
        new = []
        for fit in fits:
            b = bins(away(fit))
            near = x[b <= np.sort(b)[(n + 6) // 2 - 1]]
            det = np.linalg.slogdet(cov(near))[1]
            new.append((near.mean(0), cov(near), det) if det < fit[2] - Q.FALL else fit)
        done, fits = all(a is b for a, b in zip(new, fits, strict=True)), new
        if step == 2:
            fits = [min(fits, key=lambda f: f[2])]
        if done:
            break
    best = min(fits, key=lambda f: f[2])
    middle = np.sort(bins(away(best)))[(n + 1) // 2 - 1]
    return best[0], np.linalg.inv(best[1]), max(1.0, np.exp(middle / Q.BINS) / Q.chi_square(0.5))


def plain_judge(rows):
    stats = [plain_statistics(r[3]) for r in rows]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    groups = defaultdict(set)
    for r, s, bad in zip(rows, stats, failed, strict=True):
        if not bad:
            for key in ((2, r[1], r[2]), (1, r[1], None), (0, None, None)):
                groups[key].add(plain_vector(s))
    fits = {k: plain_estimate(v) for k, v in groups.items() if len(v) >= Q.LEAST_VECTORS}
    out = []
    for r, s, bad in zip(rows, stats, failed, strict=True):
        key = next((k for k in ((2, r[1], r[2]), (1, r[1], None), (0, None, None)) if k in fits), None)
        d = None
        if key and not bad:
            m, inverse, scale = fits[key]
            y = np.array(plain_vector(s)) - m
            d = y @ inverse @ y / scale
        out.append((r[0], *s, bad, not bad and (d is None or d <= Q.chi_square(Q.TAIL)), key and key[0], d))
    return out


def text(rng, n, kind="clean"):
    words = ["".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(2, 8))) for _ in range(n)]
    if kind == "junk":
        words = [w + rng.choice(["#", "$$", "<>", "|"]) for w in words]
    if kind == "long words":
        words = [w * 4 for w in words]
    return "".join(w + rng.choice([" ", " ", " ", "\n", "\t "]) for w in words)


def made(rng):
    rows = []
    for k in range(420):
        lang, source = rng.choice(["a", "a", "b", None]), rng.choice(["s", "s", "s", "t", None])
        kind = "junk" if k % 17 == 0 else "long words" if k % 23 == 0 else "clean"
        rows.append((k, lang, source, text(rng, rng.randint(52, 160), kind)))
    copy = text(rng, 80)
    rows += [(1000 + k, "a", "s", copy) for k in range(150)]
    rows += [(2000, "a", "s", None), (2001, "a", "s", ""), (2002, None, None, " \n\t\x0b\f\r "), (2003, "a", "s", "x " * 49), (2004, "a", "s", "x y z " * 40), (2005, "zz", "s", text(rng, 90))]
    rows += [(None, "a", "s", text(rng, 70)), (3, "b", "t", "é ü\nsame line here\nsame line here\n\n" + text(rng, 60)), (5, None, "s", text(rng, 9000))] + [rows[7]] * 2
    return rows


def test_statistics_of_odd_texts(spark):
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x\nx\n x\n\nx \nx", "é#ü $$ | <&> %*", "\x0ba\fb\rc\x1fd e", "one two\n" * 500, "p q r s p q r t p q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    out = {r["doc_id"]: r for r in Q.statistics(df).collect()}
    for k, t in enumerate(texts):
        assert tuple(out[k]["stats"]) == plain_statistics(t) and out[k]["n_words"] == "mine"
    with pytest.raises(ValueError):
        Q.statistics(df, out_col="n_words")


def test_judging_equals_the_plain_version(spark):
    rows = made(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("m", F.lit(1)).withColumn("g_lang", F.lit(2))
    got = Q.judge(materialise(Q.statistics(df).drop("text"), "statistics"))
    assert got.columns == ["doc_id", "lang", "source", "m", "g_lang", "stats", "quality"]
    got = sorted(((r["doc_id"], *r["stats"], r["quality"]["base_failed"], r["quality"]["kept"], r["quality"]["level"], r["quality"]["distance"]) for r in got.collect()), key=lambda r: str(r[:6]))
    want = sorted(plain_judge(rows), key=lambda r: str(r[:6]))
    assert len(got) == len(rows)
    for g, w in zip(got, want, strict=True):
        assert g[:9] == w[:9]
        assert (g[9] is None) == (w[9] is None) and (g[9] is None or g[9] == pytest.approx(w[9], rel=1e-6))
    kept = {r[0]: r[7] for r in got if not r[6]}
    assert not any(kept[k] for k in range(0, 420, 17)) and sum(kept.values()) > 350


def test_few_texts_and_none(spark):
    df = spark.createDataFrame([(1, "a", "s", text(random.Random(1), 60, "junk"))], "doc_id long, lang string, source string, text string")
    stats = materialise(Q.statistics(df), "statistics")
    row = Q.judge(stats).first()["quality"]
    assert row["kept"] and row["distance"] is None and row["level"] is None
    assert Q.judge(stats.limit(0)).isEmpty()


def test_shuffled_estimates_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame(made(random.Random(4)), "doc_id long, lang string, source string, text string")
    stats = materialise(Q.statistics(df).drop("text"), "statistics")
    verdicts = lambda: sorted((str(r["doc_id"]), r["quality"]["kept"], round(r["quality"]["distance"] or 0, 6)) for r in Q.judge(stats).collect())
    sent = verdicts()
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert verdicts() == sent
