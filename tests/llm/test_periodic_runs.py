"""Operator 13 against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lumenry.llm import periodic_runs


def scanned(words, least=24):
    """Runs by looking at every period and place; a stretch counts with its smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = scanned(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(kept))


def planted_ids(count):
    return [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0][:count]


def test_runs_equal_a_scan():
    rng = random.Random(3)
    for _ in range(200):
        n, letters = rng.randint(0, 160), rng.choice([1, 2, 3, 60])
        ids = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n > 5:
                a = rng.randrange(n)
                p, b = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
                for i in range(a, b):
                    ids[i] = ids[a + (i - a) % p]
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(ids, np.int64)).tolist()] == scanned(ids)


def test_query_over_odd_texts(spark, tmp_path):
    rng = random.Random(5)
    word = lambda k: " ".join(f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 300)))
    data = [(None, "a " * 30), (None, None), (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "x " * 23), (5, "x " * 24), (6, "A a " * 30), (7, "é b c d " * 9), (8, "one"), (8, "one")]
    data += [(k, word(400)) for k in planted_ids(40)] + [(k, word(400)) for k in planted_ids(3)] + [(-k, word(3)) for k in range(1, 30)]
    data += [(5000, word(9) + " " + "long text of seven words here now " * 4000 + word(9)), (planted_ids(1)[0], word(50) * 4)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_runs", df_lit(1)).withColumn("periodic_", df_lit(2))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in periodic_runs.op13(spark, str(tmp_path)).collect()]
    small = [d for d in data if d[0] not in (5000,) and len(d[1] or "") < 20_000]
    key = lambda r: str(r)
    assert len(out) == len(data)
    assert sorted((r for r in out if r[0] != 5000 and r[:1] + r[7:] in {e[:1] + e[7:] for e in (expected(*d) for d in small)}), key=key) == sorted((expected(*d) for d in small), key=key)
    long = next(r for r in out if r[0] == 5000)
    assert long[1] >= 1 and long[4] == 7 and long[3] >= 28_000
    assert periodic_runs.periodic_runs(df.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, out_col="n_runs")


def test_operator_keeps_rows_and_texts(spark):
    df = spark.createDataFrame([(1, "p q r " * 10 + "end", "runs")], "doc_id long, text string, n_words string")
    row = periodic_runs.periodic_runs(df).first()
    assert row["n_words"] == "runs" and row["periodic"]["collapsed"] == "p q r end"
    assert [tuple(r) for r in row["periodic"]["runs"]] == [(0, 30, 3)]


def df_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
