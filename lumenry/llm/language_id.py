"""Operator 6: language identification by error-correcting output codes.

Every language gets a codeword. For each bit, a linear classifier over hashed byte
trigrams of the whole normalised text separates the languages with a 1 from those with a 0:
its weights are log-odds of trigram counts, each language counting alike, gathered from
all training rows by one pass. A second pass over the training rows measures, per language
and bit, the spread and the rate of right answers. Decoding adds the logistic losses of all
bits, weighted by those rates, and takes the nearest codeword; a small gap to the second
nearest marks the answer as ambiguous.

What reaches the driver is one count table per language and one row of sums per language
and bit, neither of which grows with the number of documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .store import new_column, short_batches

BUCKETS = 1 << 16
CHUNKS = 16
SLICE = 256 << 10
SMOOTHING = 1.0
AMBIGUOUS = 0.6
UNKNOWN = "und"

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram at each place (-1: across rows or all blank), and row offsets.

    ASCII letters are lower-cased, accented Latin capitals too, other ASCII is blank.
    """
    raw, off = wordhash.buffers(column)
    plain = _PLAIN[raw]
    if len(plain) > 1:
        capital = np.flatnonzero((plain[:-1] == 0xC3) & (plain[1:] >= 0x80) & (plain[1:] <= 0x9E)) + 1
        plain[capital] += 32
    code = np.full(len(plain), -1, np.int32)
    for lo in range(0, max(0, len(plain) - 2), SLICE):
        own = plain[lo : lo + SLICE + 2].astype(np.uint32)
        three = (own[:-2] << 16) | (own[1:-1] << 8) | own[2:]
        hashed = ((three * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
        hashed[three == 0x202020] = -1
        code[lo : lo + len(hashed)] = hashed
    ends = off[1:]
    for back in (1, 2):
        at = ends - back
        code[at[at >= off[:-1]]] = -1
    return code, off


def codewords(count: int, seed: int = 1) -> np.ndarray:
    """Codewords of ``count`` languages (rows), -1 and 1: all splits up to seven languages, random ones beyond."""
    if count <= 7:
        splits = np.arange(1, max(2, 2 ** (count - 1)))
        return np.array([[1 if row == 0 or s >> (row - 1) & 1 == 0 else -1 for s in splits] for row in range(count)], np.int8)
    length = int(np.ceil(15 * np.log2(count)))
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (count, length))
        gap = min((code[i] != code[:i]).sum(1).min() for i in range(1, count))
        if best is None or gap > best[0]:
            best = gap, code
    code = best[1]
    code[0, np.abs(code.sum(0)) == count] *= -1
    return code


def _counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts of each language over all rows of ``rows(lang, text)``."""

    def per_task(batches):
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            for k, name in enumerate(names):
                texts = batch.column("text").take(pa.array(np.flatnonzero(which == k)))
                for lo, hi in wordhash.slices(texts, SLICE):
                    code, _ = trigrams(texts.slice(lo, hi - lo))
                    for at in range(0, len(code), SLICE):
                        own = code[at : at + SLICE]
                        held[name] += np.bincount(own[own >= 0], minlength=BUCKETS)
        if held:
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name for name in held for _ in range(CHUNKS)],
                    "chunk": list(range(CHUNKS)) * len(held),
                    "counts": [part for own in held.values() for part in own.reshape(CHUNKS, -1)],
                },
                pa.schema([("lang", pa.string()), ("chunk", pa.int32()), ("counts", pa.list_(pa.int64()))]),
            )

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "counts": [np.sum(np.stack(pdf["counts"]), 0)]})

    schema = "lang string, chunk int, counts array<long>"
    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(per_task, schema).groupBy("lang", "chunk").applyInPandas(summed, schema).collect():
        out.setdefault(r["lang"], np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64))[r["chunk"]] = r["counts"]
    return {name: out[name].reshape(-1) for name in sorted(out)}


def _margins(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean weight of each text's trigrams, per bit (``weights``: bit, bucket).

    One bit at a time and, within a text longer than a slice, one stretch at a time, so
    that a worker holds a few bytes per byte of a slice however many bits there are.
    """
    code, off = trigrams(column)
    rows, bits = len(off) - 1, len(weights)
    total, count = np.zeros((rows, bits)), np.zeros(rows, np.int64)
    for lo in range(0, len(code), SLICE):
        hi = min(len(code), lo + SLICE)
        a, b = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
        keep = code[lo:hi] >= 0
        own = code[lo:hi][keep]
        upto = np.concatenate([[0], np.cumsum(keep)])[np.clip(off[a : b + 1] - lo, 0, hi - lo)]
        count[a:b] += np.diff(upto)
        for bit in range(bits):
            run = np.concatenate([[0.0], np.cumsum(weights[bit][own], dtype=np.float64)])
            total[a:b, bit] += np.diff(run[upto])
    return total / np.maximum(1, count)[:, None]


class Model:
    """Languages, their codewords, bit weights (bit, bucket), and the decoding table."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray) -> None:
        self.languages, self.code, self.weights = languages, code, weights
        self.scale = np.ones(len(weights))
        self.trust = np.full(code.shape, 1 / max(1, code.shape[1]))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its share of belief, and whether the answer is ambiguous."""
        z = margins * self.scale
        loss = np.stack([(np.logaddexp(0, -z * self.code[k]) * self.trust[k]).sum(1) for k in range(len(self.languages))], 1)
        belief = np.exp((loss.min(1, keepdims=True) - loss) * self.code.shape[1])
        belief /= belief.sum(1, keepdims=True)
        top = loss.argmin(1) if len(loss) else np.zeros(0, np.int64)
        score = belief[np.arange(len(top)), top]
        return top, score, (score < AMBIGUOUS) | (np.abs(margins).max(1, initial=0) == 0)


def train(rows: DataFrame) -> Model:
    """Fit to all rows of ``rows(lang, text)`` with a language and a text."""
    short_batches(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null")
    counts = _counts(rows)
    languages = list(counts)
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((1, BUCKETS), np.float32))
    code = codewords(len(languages))
    share = np.stack([(c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in counts.values()])
    weights = np.zeros((code.shape[1], BUCKETS), np.float32)
    for bit in range(code.shape[1]):
        ones, zeros = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(ones) and len(zeros):
            weights[bit] = np.log(ones.mean(0)) - np.log(zeros.mean(0))
    model = Model(languages, code, weights)
    shared, bits = rows.sparkSession.sparkContext.broadcast(model), code.shape[1]

    def measured(batches):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(2 * bits + 1))
        known = {name: k for k, name in enumerate(shared.value.languages)}
        for batch in batches:
            for lo, hi in wordhash.slices(batch.column("text"), SLICE):
                margins = _margins(shared.value.weights, batch.column("text").slice(lo, hi - lo))
                names = np.array(batch.column("lang").slice(lo, hi - lo).to_pylist(), object)
                for name in set(names):
                    own = margins[names == name] * shared.value.code[known[name]]
                    sums[name] += np.concatenate([(own > 0).sum(0), np.abs(own).sum(0), [len(own)]])
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"lang": [n for n in sums for _ in range(2 * bits + 1)], "k": list(range(2 * bits + 1)) * len(sums), "v": np.concatenate(list(sums.values()))},
                pa.schema([("lang", pa.string()), ("k", pa.int32()), ("v", pa.float64())]),
            )

    found = np.zeros((len(languages), 2 * bits + 1))
    for r in rows.mapInArrow(measured, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():
        found[languages.index(r["lang"]), r["k"]] = r["v"]
    right = found[:, :bits] / np.maximum(1, found[:, -1:])
    spread = (found[:, bits : 2 * bits] / np.maximum(1, found[:, -1:])).mean(0)
    model.scale = 3 / np.maximum(spread, 1e-9)
    model.trust = np.maximum(right, 1e-3) / np.maximum(right, 1e-3).sum(1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with ``out_col`` added: struct of ``lang_pred``, ``score`` and ``ambiguous``.

    Only the text is looked at. A text that is null or has no letter gets ``und`` and
    score 0, as does every text where the model knows no language. Own columns stay;
    one that is called ``out_col`` is an error. A text of any length is read whole, a
    stretch of ``SLICE`` bytes at a time.
    """
    new_column(out_col, docs.columns)
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        known, parts = shared.value, []
        column = pa.Array.from_pandas(texts, type=pa.large_string())
        for lo, hi in wordhash.slices(column, SLICE):
            parts.append(known.decode(_margins(known.weights, column.slice(lo, hi - lo))))
        top, score, unsure = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        names = np.array(known.languages, object)[top] if len(top) else []
        return pd.DataFrame({"lang_pred": names, "score": score, "ambiguous": unsure})

    lettered: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if not model.languages:
        return docs.withColumn(out_col, nothing)
    return docs.withColumn(out_col, F.when(lettered, predicted(F.col(text_col))).otherwise(nothing))


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn outside the held-out fold, predict every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~is_held_out()).select("lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", is_held_out().alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous"
    )
