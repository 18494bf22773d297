"""Light bands: stripes that flickering lamps leave along the rows of a sensor.

``light_bands`` looks for them in upright pictures: overlapping blocks each name the period that stands out
of their profile, and a picture is banded if enough blocks agree. ``row_bands`` works on raw mosaics: per
colour the rows' brightness against its surroundings is searched at all periods, the bands' gains are folded per block of
a grid, and ``removed`` divides them out. Pictures and mosaics are rows of arrays (see ``plates``); the
waves of a batch's pictures are matrix products, over bounded stretches of periods.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plates import arrays

BLOCK = 256
#: A block's peak counts if it stands so far above the median power.
BLOCK_PEAK = 10.0
#: Periods agree if they differ by less than this share.
AGREEMENT = 0.04
#: A picture is banded if so many of its blocks agree, and the strongest of them stands out so far.
COVERAGE, PEAK = 0.25, 200.0
#: Sensor rows searched, in tenths, and half the window of rows that is the surroundings of a row.
ROW_PERIODS = np.round(np.arange(200, 4010) / 10, 1)
SMOOTHING = 200
#: Rows of a colour that a search needs.
LEAST_ROWS = 1200
ROW_PEAK = 20.0
STRIPS, BINS, HARMONICS, BLOCK_PERIODS = 32, 32, 4, 8
MOST_GAIN = 1.25
#: Shares of a fold that harmonics explain: of noise, and of bands.
COHERENCE = (0.4, 0.8)
#: Light counts up to this share of white; gains fade over the last share below white.
MEASURED, FADE = 0.95, 0.2
CHUNK = 256
#: Neighbouring periods whose medians are bounded together.
STRETCH = 16


def block_periods() -> np.ndarray:
    """Periods of 6 to 64 pixels in tenths, without those of the grids that compression leaves (4, 8 and 16 pixels)."""
    periods = np.arange(60, 641) / 10
    apart = [np.abs(BLOCK / periods - BLOCK / grid) > 2.5 for grid in (4, 8)]
    return periods[apart[0] & apart[1] & (np.abs(periods - 16) > 0.3)]


def moving_mean(values: np.ndarray, half: int) -> np.ndarray:
    """Means along the last axis of ``half`` values on either side, fewer at the edges."""
    n = values.shape[-1]
    upto = np.concatenate([np.zeros((*values.shape[:-1], 1)), np.cumsum(values, -1)], -1)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (upto[..., hi] - upto[..., lo]) / (hi - lo)


def wave_powers(signals: np.ndarray, places: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Power of each signal (row) at each period, its values standing at ``places``."""
    out = np.empty((len(signals), len(periods)))
    for at in range(0, len(periods), CHUNK):
        turn = 2 * np.pi * places[:, None] / periods[None, at : at + CHUNK]
        out[:, at : at + CHUNK] = (signals @ np.cos(turn)) ** 2 + (signals @ np.sin(turn)) ** 2
    return out


def blocks_of(light: np.ndarray) -> np.ndarray:
    """Windowed profiles (block, place) of a picture's overlapping blocks; no block if it is too small."""
    across = light if light.shape[0] <= light.shape[1] else light.T
    steps = [range(0, side - BLOCK + 1, BLOCK // 2) for side in (across.shape[1], across.shape[0])]
    sums = np.concatenate([np.zeros((across.shape[0], 1)), np.cumsum(across, 1)], 1)
    profiles = [np.log((sums[u : u + BLOCK, v + BLOCK] - sums[u : u + BLOCK, v]) / BLOCK + 4) for v in steps[0] for u in steps[1]]
    if not profiles:
        return np.zeros((0, BLOCK))
    profile = np.array(profiles)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(BLOCK) / BLOCK)
    return (profile - moving_mean(profile, 8)) * hann


def agreed(periods: np.ndarray, ratios: np.ndarray, blocks: int) -> tuple[float, float, float]:
    """The period that most of the blocks with a peak agree on, their share of all, and the strongest of them."""
    near = np.abs(periods[None, :] - periods[:, None]) / periods[:, None] < AGREEMENT
    votes = near.sum(1)
    if not len(votes):
        return 0.0, 0.0, 0.0
    best = int(votes.argmax())
    return float(periods[best]), float(votes[best] / blocks), float(ratios[near[best]].max())


def light_bands(plates: DataFrame) -> DataFrame:
    """``(pic, period, coverage, peak, banded)``: stripes along the long side of upright pictures.

    ``plates`` has ``rgb``, or ``light`` with one number a pixel. All fields are null for a picture without room for a block.
    """
    grey = "light" in plates.columns
    schema = pa.schema([("pic", pa.int64()), ("period", pa.float64()), ("coverage", pa.float64()), ("peak", pa.float64())])
    periods = block_periods()

    def found(batches):
        for batch in batches:
            rows = []
            for picture in arrays(batch, "light", 1) if grey else arrays(batch):
                light = picture if grey else (2126 * picture[..., 0].astype(int) + 7152 * picture[..., 1] + 722 * picture[..., 2]) // 10_000
                blocks = blocks_of(light.astype(float))
                if not len(blocks):
                    rows.append((None, None, None))
                    continue
                power = wave_powers(blocks, np.arange(BLOCK), periods)
                median = np.partition(power, len(periods) // 2, axis=1)[:, len(periods) // 2]
                best = len(periods) - 1 - power[:, ::-1].argmax(1)
                ratio = np.where(median > 0, power[np.arange(len(power)), best] / np.where(median > 0, median, 1), 0)
                clear = ratio > BLOCK_PEAK
                rows.append(agreed(periods[best[clear]], ratio[clear], len(blocks)))
            yield pa.RecordBatch.from_arrays([batch.column("pic").cast(pa.int64()), *(pa.array(list(c), pa.float64()) for c in zip(*rows, strict=True))], schema=schema)

    out = plates.select("pic", "width", "height", "light" if grey else "rgb").mapInArrow(found, "pic long, period double, coverage double, peak double")
    return out.withColumn("banded", (F.col("coverage") >= COVERAGE) & (F.col("peak") >= PEAK))


class Mosaic:
    """A raw picture: values, the colour (0 to 3) of each place of its repeating pattern, black and white per colour."""

    def __init__(self, raw: np.ndarray, pattern, black, white) -> None:
        self.raw, self.black, self.white = raw.astype(np.float64), black, white
        h, w = raw.shape
        self.colour = np.tile(np.array(pattern), (h // 2 + 1, w // 2 + 1))[:h, :w]

    def strips(self, colour: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold the colour, and their mean light in each of the strips (strip, row); clipped pixels count only where there are no others."""
        h, w = self.raw.shape
        wide = w // STRIPS
        cut = lambda a: a[:, : wide * STRIPS].reshape(h, STRIPS, wide)
        if not wide:
            return np.zeros(0, int), np.zeros((STRIPS, 0))
        own = cut(self.colour == colour)
        light, clip = np.maximum(cut(self.raw) - self.black[colour], 1.0), self.black[colour] + MEASURED * (self.white[colour] - self.black[colour])
        good = own & (cut(self.raw) < clip)
        good = np.where(good.any(2, keepdims=True), good, own)
        count = good.sum(2)
        rows = np.flatnonzero((count > 0).any(1))
        if not len(rows) or (count[rows] == 0).any():
            return np.zeros(0, int), np.zeros((STRIPS, 0))
        return rows, ((light * good).sum(2)[rows] / count[rows]).T

    def signal(self, colour: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the colour and their brightness against the rows around, the upper median of the strips'."""
        rows, light = self.strips(colour)
        if not len(rows):
            return rows, np.zeros(0)
        high = np.log(light) - moving_mean(np.log(light), SMOOTHING)
        return rows, np.sort(high, 0)[STRIPS // 2]


def place_of(period: float) -> int:
    return int(np.clip(np.floor((period - ROW_PERIODS[0]) * 10 + 0.5), 0, len(ROW_PERIODS) - 1))


def ratio_at(powers: np.ndarray, k: int) -> np.ndarray:
    """Power at the ``k``-th period over the upper median of its neighbours, from 3/4 to 4/3 of it without the nearest 3 %."""
    period = ROW_PERIODS[k]
    lo, hi = place_of(period * 0.75), place_of(period * 4 / 3)
    around = powers[..., lo : hi + 1][..., np.abs(ROW_PERIODS[lo : hi + 1] - period) > 0.03 * period]
    middle = around.shape[-1] // 2
    return powers[..., k] / np.maximum(np.partition(around, middle, axis=-1)[..., middle], np.finfo(float).tiny)


def ratio_near(powers: np.ndarray, period: float) -> float:
    """The ratio at a period, or at its half if that stands out more."""
    at = [float(ratio_at(powers, place_of(p))) for p in (period, period / 2) if p >= ROW_PERIODS[0]]
    return max(at, default=0.0)


def all_ratios(powers: np.ndarray) -> np.ndarray:
    return np.stack([ratio_at(powers, k) for k in range(len(ROW_PERIODS))], -1)


@lru_cache(1)
def _stretches() -> list[tuple[int, int, int, int, np.ndarray, int]]:
    """For stretches of neighbouring periods all places that the medians of any of them are taken over, and the least rank of these medians."""
    out = []
    for at in range(0, len(ROW_PERIODS), STRETCH):
        own = ROW_PERIODS[at : at + STRETCH]
        ends = [(place_of(p * 0.75), place_of(p * 4 / 3)) for p in own]
        around = np.arange(ends[0][0], ends[-1][1] + 1)
        used = np.stack([(around >= a) & (around <= b) & (np.abs(ROW_PERIODS[around] - p) > 0.03 * p) for p, (a, b) in zip(own, ends, strict=True)])
        out.append((at, at + len(own), around[0], around[-1] + 1, used.any(0), int(used.sum(1).min()) // 2))
    return out


def strongest(powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of powers the place of the largest ratio, the last of equal ones, and that ratio; the same as from ``all_ratios``.

    Over more places a value of the same rank is no larger, so a stretch of periods has one lower bound of its medians. Medians
    themselves are taken only where the bound leaves room for the largest ratio.
    """
    most = np.empty_like(powers)
    for at, end, lo, hi, used, rank in _stretches():
        least = np.partition(powers[:, lo:hi][:, used], rank, axis=1)[:, rank]
        most[:, at:end] = powers[:, at:end] / np.maximum(least, np.finfo(float).tiny)[:, None]
    places, ratios = np.empty(len(powers), int), np.empty(len(powers))
    for row, (own, bound) in enumerate(zip(powers, most, strict=True)):
        if not np.isfinite(own).all():
            all_ = all_ratios(own[None, :])[0]
            places[row] = len(all_) - 1 - all_[::-1].argmax()
            ratios[row] = all_[places[row]]
            continue
        best = (-np.inf, -1)
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < best[0]:
                break
            best = max(best, (float(ratio_at(own, k)), int(k)))
        ratios[row], places[row] = best
    return places, ratios


def spectra(signals: dict) -> dict:
    """Powers at all periods of signals ``{key: (rows, values)}`` that are long enough; signals with the same rows share their waves."""
    by_rows = defaultdict(list)
    for key, (rows, values) in signals.items():
        if len(rows) >= LEAST_ROWS:
            by_rows[rows.tobytes()].append(key)
    out = {}
    for keys in by_rows.values():
        powers = wave_powers(np.stack([signals[k][1] for k in keys]), signals[keys[0]][0], ROW_PERIODS)
        out.update(zip(keys, powers, strict=True))
    return out


def best_period(powers: dict[int, np.ndarray], ratios: dict[int, np.ndarray], signals: dict[int, tuple]) -> tuple[float | None, float]:
    """The bands' period in hundredths of a row and how far it stands out; no period below ``ROW_PEAK``.

    The colour that stands out most gives it; twice of it is taken if that stands out in any colour, as the first may be a harmonic.
    """
    if not powers:
        return None, 0.0
    peaks = {c: r.max() for c, r in ratios.items()}
    first = max(peaks, key=lambda c: (peaks[c], c))
    top = float(peaks[first])
    if top < ROW_PEAK:
        return None, top
    period = float(ROW_PERIODS[len(ROW_PERIODS) - 1 - ratios[first][::-1].argmax()])
    if 2 * period <= 400 and any(r[place_of(2 * period)] >= ROW_PEAK for r in ratios.values()):
        period *= 2
    near = {c: ratio_near(p, period) for c, p in powers.items()}
    rows, values = signals[max(near, key=lambda c: (near[c], c))]
    fine = period + np.arange(-50, 51) / 100
    power = wave_powers(values[None, :], rows, fine)[0]
    return float(fine[len(fine) - 1 - power[::-1].argmax()]), top


def smoothed(folds: np.ndarray) -> np.ndarray:
    """Folds (block, bin) as 1 and their first harmonics, faded by how much of the fold those explain."""
    n = folds.shape[1]
    off = folds - folds.mean(1, keepdims=True)
    turn = 2 * np.pi * np.arange(1, HARMONICS + 1)[:, None] * np.arange(n)[None, :] / n
    re, im = off @ np.cos(turn).T, off @ np.sin(turn).T
    total, explained = (off**2).sum(1), 2 / n * (re**2 + im**2).sum(1)
    weight = np.clip((explained / np.where(total > 0, total, 1) - COHERENCE[0]) / (COHERENCE[1] - COHERENCE[0]), 0, 1)
    fit = 2 / n * (re @ np.cos(turn) + im @ np.sin(turn))
    return 1 + np.where(total > 0, weight, 0)[:, None] * fit


def bins_of(rows: np.ndarray, period: float) -> np.ndarray:
    phase = rows / period
    return ((phase - np.floor(phase)) * BINS).astype(int) % BINS


def gains_of(mosaic: Mosaic, colour: int, period: float) -> np.ndarray:
    """Gains (block row, strip, bin) of a colour: light over that of two periods around it, folded in each block of the grid."""
    rows, light = mosaic.strips(colour)
    local = moving_mean(light, int(np.floor(period + 0.5)) // 2)
    tall = max(1, int(np.ceil(BLOCK_PERIODS * period)))
    count = max(1, len(mosaic.raw) // tall)
    cell = np.minimum(rows // tall, count - 1) * BINS + bins_of(rows, period)
    sums = [np.stack([np.bincount(cell, s, count * BINS) for s in of]).reshape(STRIPS, count, BINS) for of in (light, local)]
    folds = np.where(sums[1] > 0, np.clip(sums[0] / np.where(sums[1] > 0, sums[1], 1), 1 / MOST_GAIN, MOST_GAIN), 1.0)
    return smoothed(folds.transpose(1, 0, 2).reshape(-1, BINS)).reshape(count, STRIPS, BINS)


def _between(size: int, block: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(size) + 0.5) / block - 0.5, 0, count - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, count - 1), at - low


def divided(mosaic: Mosaic, period: float, gains: dict[int, np.ndarray]) -> np.ndarray:
    """The raw values with the gains, read between block centres, divided out; near white the division fades."""
    h, w = mosaic.raw.shape
    bins, out = bins_of(np.arange(h), period), mosaic.raw.copy()
    for colour, grid in gains.items():
        x0, x1, fx = _between(w, max(1, w // STRIPS), STRIPS)
        y0, y1, fy = _between(h, max(1, int(np.ceil(BLOCK_PERIODS * period))), len(grid))
        line = [grid[y][np.arange(h)[:, None], x0[None, :], bins[:, None]] * (1 - fx) + grid[y][np.arange(h)[:, None], x1[None, :], bins[:, None]] * fx for y in (y0, y1)]
        gain = line[0] * (1 - fy)[:, None] + line[1] * fy[:, None]
        black, white = mosaic.black[colour], mosaic.white[colour]
        light = mosaic.raw - black
        fade = np.clip((white - black - light) / (FADE * (white - black)), 0, 1)
        value = np.clip(np.floor(light / (1 + (gain - 1) * fade) + black + 0.5), 0, white)
        out = np.where(mosaic.colour == colour, value, out)
    return out


def amplitude(grid: np.ndarray) -> float:
    """The largest gain of a block, of the upper median of the blocks that have any."""
    most = np.sort(np.abs(grid - 1).max(-1).ravel())
    most = most[most > 0]
    return float(most[len(most) // 2]) if len(most) else 0.0


_BANDS = "pic long, period double, peak double, peaks array<double>, amplitudes array<double>, residual array<double>, raw array<int>"


def row_bands(mosaics: DataFrame, pattern, black, white) -> DataFrame:
    """``(pic, period, peak, peaks, amplitudes, residual, raw)`` of ``mosaics(pic, width, height, raw array<int>)``.

    ``pattern`` is the 2 x 2 colours (0 to 3), ``black`` and ``white`` levels per colour. ``period`` is null where no band stands out
    by ``ROW_PEAK``; ``peaks`` and ``residual`` tell per colour how far it does before and after, ``amplitudes`` the gains' strength (0: left alone), and
    ``raw`` is the picture without its bands. Mosaics of one batch are searched together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Mosaic(raw, pattern, black, white) for raw in arrays(batch, "raw", 1)]
            signals = {(k, c): m.signal(c) for k, m in enumerate(held) for c in range(4)}
            powers = spectra(signals)
            ratios = dict(zip(powers, all_ratios(np.stack(list(powers.values()))), strict=True)) if powers else {}
            found, after = [], {}
            for k, m in enumerate(held):
                own = lambda d: {c: d[k, c] for c in range(4) if (k, c) in d}  # noqa: B023, E731
                period, top = best_period(own(powers), own(ratios), own(signals))
                peaks = [ratio_near(powers[k, c], period) if period and (k, c) in powers else 0.0 for c in range(4)]
                gains = {c: gains_of(m, c, period) for c in range(4) if period and peaks[c] >= ROW_PEAK}
                out = divided(m, period, gains) if gains else m.raw
                if gains:
                    cleaned = Mosaic(out, pattern, black, white)
                    after.update({(k, c): cleaned.signal(c) for c in range(4)})
                found.append([period, top, peaks, [amplitude(gains[c]) if c in gains else 0.0 for c in range(4)], None, out.astype(np.int32).ravel()])
            left = spectra(after)
            for k, row in enumerate(found):
                row[4] = [ratio_near(left[k, c], row[0]) if (k, c) in left else row[2][c] for c in range(4)]
                cells = pa.ListArray.from_arrays(pa.array([0, len(row[5])], pa.int32()), pa.array(row[5]))
                lists = [pa.array([x], pa.list_(pa.float64())) for x in row[2:5]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("pic").slice(k, 1).cast(pa.int64()), pa.array([row[0]], pa.float64()), pa.array([row[1]], pa.float64()), *lists, cells],
                    names=["pic", "period", "peak", "peaks", "amplitudes", "residual", "raw"],
                )

    return mosaics.select("pic", "width", "height", "raw").mapInArrow(run, _BANDS)


def signal_powers(signals: DataFrame, periods) -> DataFrame:
    """``(id, period, power)`` of ``signals(id, values array<double>)``, places counted from 0; a batch of signals is one product."""
    periods = np.asarray(periods, float)

    def run(batches):
        for batch in batches:
            by_length = defaultdict(list)
            for key, values in zip(batch.column("id").to_pylist(), batch.column("values"), strict=True):
                by_length[len(values)].append((key, values.values.to_numpy(zero_copy_only=False)))
            for length, own in by_length.items():
                powers = wave_powers(np.stack([v for _, v in own]), np.arange(length), periods)
                for (key, _), power in zip(own, powers, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(periods), pa.int64()), pa.array(periods), pa.array(power)], names=["id", "period", "power"])

    return signals.select(F.col("id").cast("long").alias("id"), "values").mapInArrow(run, "id long, period double, power double")


def signal_periods(signals: DataFrame) -> DataFrame:
    """``(id, period, ratio)``: of all row periods the one that stands out most of ``signals(id, values)``."""
    schema = pa.schema([("id", pa.int64()), ("period", pa.float64()), ("ratio", pa.float64())])

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            powers = spectra({k: (np.arange(len(v)), v.values.to_numpy(zero_copy_only=False)) for k, v in enumerate(batch.column("values"))})
            rows = []
            if powers:
                places, ratios = strongest(np.stack(list(powers.values())))
                rows = [(ids[k], ROW_PERIODS[b], r) for k, b, r in zip(powers, places, ratios, strict=True)]
            rows += [(key, None, None) for k, key in enumerate(ids) if k not in powers]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return signals.select(F.col("id").cast("long").alias("id"), "values").mapInArrow(run, "id long, period double, ratio double")
