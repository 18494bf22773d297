"""Operator 10: language-model scores by cross-entropy difference.

A target model is learned from chosen documents, a background model from all documents.
Both are bigram models over one vocabulary, every word of any document: the probability of
a word after another is that of the pair, smoothed towards that of the word alone. A
document's score is its mean loss per word under the target model less that under the
background model: low scores are like the target.

The models are matched. Background counts are scaled to the size of the target, which makes
them the counts that a background sample of like size has in the mean, so that smoothing
weighs alike in both. A document's own counts are left out of both models when it is scored,
so that a score does not tell what a model was learned from.

Every word and every pair of all documents has counts of its own, none is left out. Documents
are dealt to chunks of bounded size. A chunk names its distinct words and pairs once, with
its own counts; these meet in buckets by hash, where counts are summed, and the sums go back
to the chunk in the same order, without the keys. However frequent a word is, it is named once
for a chunk. The texts are shuffled once, for both uses.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .store import short_batches, small_enough

SMOOTHING = 0.5
BACKOFF = 5.0
CHUNK_WORDS = 1 << 21
BUCKET_KEYS = 1 << 20
CHUNKS_EACH = 4
HELD = 1 << 20
KEY_BITS = 48
BROADCAST_IDS = 1_000_000
SLICE = 512 << 10
START, END = np.uint64(0xA5C3F10E96D2B487), np.uint64(0x5E1B7D942CF60A3B)
PAIR = np.uint64(0x9FB21C651E98DF25)

SCHEMA = "`{id}` long, n_tokens long, target_loss double, background_loss double, score double"


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of every text that has any, between ``START`` and ``END``; the text of each; words per text."""
    hashed, first = wordhash.words(column)
    count = np.diff(first)
    size = np.where(count > 0, count + 2, 0)
    row = np.repeat(np.arange(len(count)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(len(row), START)
    out[place == count[row] + 1] = END
    out[(place > 0) & (place <= count[row])] = hashed
    return out, row, count


def _keys(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words (``START`` too), keys of the pairs, and the places at which pairs end."""
    ends = np.flatnonzero(sequence != START)
    return wordhash.mix(sequence), wordhash.mix(wordhash.mix(sequence[ends - 1]) * PAIR + sequence[ends]), ends


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi in wordhash.slices(texts, SLICE):
        yield lo, hi, *_sequences(texts.slice(lo, hi - lo))


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    value.sort()
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])[: len(value)])
    return value[start], np.diff(np.append(start, len(value)))


def _chunk_keys(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a chunk, ascending, and how often each occurs in it and in its target documents."""
    texts, chosen = docs["text"].combine_chunks(), docs["chosen"].to_numpy(zero_copy_only=False).astype(bool)
    every, target = [], []
    for lo, hi, sequence, row, _ in _slices(texts):
        word, pair, ends = _keys(sequence)
        every += [word, pair]
        own = chosen[lo:hi][row]
        target += [word[own], pair[own[ends]]]
    value, count = _counted(every)
    of_target, t = _counted(target)
    out = np.zeros(len(value), np.int64)
    out[np.searchsorted(value, of_target)] = t
    return value, count, out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold the largest, low bytes of all first; the first byte tells how many each takes."""
    size = next(n for n in range(1, 9) if n == 8 or numbers.max(initial=0) < 1 << 8 * n)
    planes = np.ascontiguousarray(numbers.astype("<u8")[:, None].view(np.uint8)[:, :size].T)
    return bytes([size]) + planes.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8")[:, 0]


def _small(counts: np.ndarray) -> bytes:
    return zlib.compress(_packed(counts), 1)


def _large(raw: bytes) -> np.ndarray:
    return _unpacked(zlib.decompress(raw))


def _places(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each of ascending keys, and its place in the bucket as ``KEY_BITS`` bits.

    A bucket holds about ``BUCKET_KEYS`` keys at any size of the corpus, so two keys share a place with a probability of about 4e-9.
    """
    high, low = value >> np.uint64(32), value & np.uint64(0xFFFFFFFF)
    share = high * np.uint64(buckets) + (low * np.uint64(buckets) >> np.uint64(32))
    bucket = share >> np.uint64(32)
    # the 32 bits below the bucket and, of the key's lowest bits, those that the product has not used
    rest = (share & np.uint64(0xFFFFFFFF)) << np.uint64(KEY_BITS - 32)
    return bucket.astype(np.int64), (rest | (low * np.uint64(buckets) & np.uint64(0xFFFFFFFF)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _requests(buckets: int):
    def named(docs: pa.Table) -> pa.Table:
        value, count, target = _chunk_keys(docs)
        bucket, place = _places(value, buckets)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(value)]]) if len(value) else np.zeros(1, np.int64)
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        return pa.table(
            {
                "chunk": pa.array(np.full(len(parts), docs["chunk"][0].as_py(), np.int64)),
                "bucket": pa.array(bucket[cuts[:-1]]),
                "keys": pa.array([_packed(np.diff(place[p], prepend=0)) for p in parts], pa.binary()),
                "every": pa.array([_small(count[p]) for p in parts], pa.binary()),
                "target": pa.array([_small(target[p]) for p in parts], pa.binary()),
            }
        )

    return named


def _replies(asked: pa.Table) -> pa.Table:
    """For each chunk that asks a bucket, the sums over all chunks in the order of its keys."""
    keys = [np.cumsum(_unpacked(x)) for x in asked["keys"].to_pylist()]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    out = {}
    for name in ("every", "target"):
        # sums below 2^53 are exact
        total = np.bincount(at, np.concatenate([_large(x) for x in asked[name].to_pylist()])).astype(np.int64)
        out[name] = pa.array([_small(x) for x in np.split(total[at], cuts)], pa.binary())
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], **out})


class Model:
    """Sizes of both models: events in the target and everywhere, and kinds of words."""

    def __init__(self, target: int, every: int, kinds: int) -> None:
        self.sizes, self.kinds = (target, every), kinds
        self.scale = (1.0, target / every if target and every else 1.0)

    def loss(self, which: int, pair: np.ndarray, before: np.ndarray, word: np.ndarray, own_size: np.ndarray) -> np.ndarray:
        """Losses of words, from the counts of pair, word before and word that are left; ``own_size`` events are left out."""
        scale = self.scale[which]
        alone = (scale * word + SMOOTHING) / (scale * (self.sizes[which] - own_size) + SMOOTHING * self.kinds)
        return -np.log((scale * pair + BACKOFF * alone) / (scale * before + BACKOFF))


def _own_counts(row: np.ndarray, at: np.ndarray, kinds: int) -> np.ndarray:
    """How often each key occurs in its own text."""
    _, where, count = np.unique(row * kinds + at, return_inverse=True, return_counts=True)
    return count[where]


def _scorer(model: Model, id_col: str):
    def scored(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({id_col: pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("target_loss", "background_loss", "score")}})
        value, _, _ = _chunk_keys(docs)
        replies = replies.sort_by("bucket")
        counts = [np.concatenate([np.zeros(0, np.int64), *map(_large, replies[name].to_pylist())]) for name in ("target", "every")]
        if len(counts[0]) != len(value):
            raise ValueError(f"{len(value)} keys asked, {len(counts[0])} answered")
        texts, chosen = docs["text"].combine_chunks(), docs["chosen"].to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, losses = [], [[], []]
        for lo, hi, sequence, row, count in _slices(texts):
            word, pair, ends = _keys(sequence)
            word, pair = np.searchsorted(value, word), np.searchsorted(value, pair)
            own_word, own_pair = _own_counts(row, word, len(value)), _own_counts(row[ends], pair, len(value))
            read = np.flatnonzero(sequence[ends] != END)
            at, before, of = ends[read], ends[read] - 1, row[ends[read]]
            for k, known in enumerate(counts):
                share = chosen[lo:hi][of] if k == 0 else 1
                left = model.loss(
                    k,
                    known[pair[read]] - share * own_pair[read],
                    known[word[before]] - share * own_word[before],
                    known[word[at]] - share * own_word[at],
                    share * (count[of] + 1),
                )
                losses[k].append(np.bincount(of, left, hi - lo) / np.maximum(1, count))
            sizes.append(count)
        size = np.concatenate(sizes)
        target, background = (np.concatenate(x) for x in losses)
        nothing = size == 0
        columns = [pa.array(x, mask=nothing) for x in (target, background, target - background)]
        return pa.table([docs["id"].combine_chunks(), pa.array(size.astype(np.int64)), *columns], names=[id_col, "n_tokens", "target_loss", "background_loss", "score"])

    return scored


def model_sizes(docs: DataFrame) -> Model:
    """Sizes from all of ``docs(text, chosen)``; an event is a word or a text's end."""

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts, 1)
        value, at = np.unique(rows[0], return_inverse=True)
        return np.stack([value, *(np.bincount(at, x, len(value)).astype(np.uint64) for x in rows[1:])])

    def counted(batches):
        parts, size = [], 0
        for batch in batches:
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, sequence, row, _ in _slices(batch.column("text")):
                event = sequence != START
                value, where, count = np.unique(sequence[event], return_inverse=True, return_counts=True)
                target = np.bincount(where[chosen[lo:hi][row[event]]], minlength=len(value))
                parts.append(np.stack([value, count.astype(np.uint64), target.astype(np.uint64)]))
                size += len(value)
                if size > HELD:
                    parts = [merged(parts)]
                    size = 0
                    if len(parts[0][0]) > HELD:
                        yield batch_of(parts.pop())
        if parts:
            yield batch_of(merged(parts))

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in rows], ["h", "every", "target"])

    kinds = docs.mapInArrow(counted, "h long, every long, target long").groupBy("h").agg(F.sum("every").alias("every"), F.sum("target").alias("target"))
    total = kinds.agg(F.sum("target").alias("target"), F.sum("every").alias("every"), F.count("*").alias("kinds")).first()
    return Model(total["target"] or 0, total["every"] or 0, total["kinds"])


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, target_loss, background_loss, score)`` for every row of ``docs``.

    ``target_ids`` holds, under ``id_col``, the ids of documents to learn the target from; nulls
    and repeats in it do nothing. Texts without words, null or empty, have null losses and score.
    Without any target document the target model is that of smoothing alone. Repeated rows
    count, as copies do, and are scored each, with one row's counts left out; an empty table gives no rows; other
    columns are not read. A long text is read whole: a worker holds the words of one text, or of a chunk.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = target_ids.select(F.col(id_col).cast("long").alias("id")).dropna().distinct().withColumn("chosen", F.lit(True))
    chosen = F.broadcast(chosen) if small_enough(chosen, BROADCAST_IDS) else chosen
    learned = rows.join(chosen, "id", "left").select("id", "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    model = model_sizes(learned.select("text", "chosen"))
    events = model.sizes[1]
    chunks, buckets = events // CHUNK_WORDS + 1, 2 * events // BUCKET_KEYS + 1
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = learned.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))).repartition(max(least, chunks // CHUNKS_EACH), "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_requests(buckets), "chunk long, bucket long, keys binary, every binary, target binary")
    answered = asked.repartition(max(least, buckets // CHUNKS_EACH), "bucket").groupBy("bucket").applyInArrow(_replies, "chunk long, bucket long, every binary, target binary")
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_scorer(model, id_col), SCHEMA.format(id=id_col))


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document, scored against the documents that are labelled as of good quality and not toxic."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0")
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good.select("doc_id"))
