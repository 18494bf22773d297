"""Effects that are simplest on a whole picture: automatic spins, dots of any size, leaks from a drawn point, slices of single channels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame

from ..functions.draws import Draws, split_mix
from .plates import BAYER, Colour, blurring, from_hsv, luma, repainted, repainted_together, resized, scaled, to_hsv

#: Pixels between two of the pictures that an automatic spin blends, and how many it blends at most.
SPACING, MOST_STEPS = 4.0, 96
#: Pixels of a patch in which a leak's reach and strength, or its hue, hardly change; and what is added to the seed of each.
PATCH, TINT_PATCH = 200, 350
PATCH_SEEDS = (0x1EA4, 0x5CA1, 0x7147)


def bilinear(picture: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Channels at places between pixels, edges repeated; of one picture (height, width, 3) or several (height, width, n, 3)."""
    h, w = picture.shape[:2]
    u0, v0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fu, fv = ((t.reshape(*t.shape, *[1] * (picture.ndim - 2))) for t in (u - u0, v - v0))
    flat = picture.reshape(h * w, *picture.shape[2:])
    at = lambda i, j: flat[np.clip(v0 + j, 0, h - 1) * w + np.clip(u0 + i, 0, w - 1)]
    return (at(0, 0) * (1 - fu) + at(1, 0) * fu) * (1 - fv) + (at(0, 1) * (1 - fu) + at(1, 1) * fu) * fv


def spun(picture: np.ndarray, angle: float, center=(50, 50), steps: int = 0, mix: float = 100) -> np.ndarray:
    sweep = angle * (math.pi / 180)
    h, w = picture.shape[:2]
    cx, cy = center[0] / 100 * (w - 1), center[1] / 100 * (h - 1)
    dy, dx = np.mgrid[:h, :w] - np.array([cy, cx])[:, None, None]
    count = np.full((h, w), steps) if steps else np.clip(np.ceil(np.hypot(dx, dy) * sweep / SPACING), 2, MOST_STEPS).astype(int)
    smeared = np.empty_like(picture)
    for n in np.unique(count):
        own = count == n
        x, y, total = dx[own], dy[own], 0.0
        for k in range(n):
            turn = -sweep / 2 + sweep * k / (n - 1)
            total = total + bilinear(picture, cx + x * math.cos(turn) - y * math.sin(turn), cy + x * math.sin(turn) + y * math.cos(turn))
        smeared[own] = total / n
    return np.round(picture + (smeared - picture) * (mix / 100), 9)


def spin(plates: DataFrame, angle: float = 10, center=(50, 50), steps: int = 0, mix: int = 100) -> DataFrame:
    """The mean over rotations about a centre; with 0 steps a pixel gets as many as its arc is long."""
    varies = isinstance(angle, Column) or isinstance(mix, Column)
    if steps == 1 or not varies and not (angle and mix):
        return plates
    return repainted_together(plates, spun, angle=angle, center=center, steps=steps, mix=mix)


def aberrated(picture: np.ndarray, amount: float) -> np.ndarray:
    h, w = picture.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    seen = [bilinear(picture[..., c : c + 1], w / 2 + (x - w / 2) / s, h / 2 + (y - h / 2) / s) for c, s in enumerate((1 + amount, 1.0, 1 - amount))]
    return np.round(np.concatenate(seen, -1), 9)


def aberration(plates: DataFrame, amount: float = 0.006) -> DataFrame:
    """Red larger, blue smaller about the centre."""
    return repainted_together(plates, aberrated, amount=amount)


def pushed(picture: np.ndarray, amplitude: float, scale: int, octaves: int, drift: int, seed: int) -> np.ndarray:
    h, w = picture.shape[:2]
    side = max(h, w)
    y, x = np.mgrid[:h, :w].astype(float)
    reach, wave, moved, octaves = amplitude * side / 1000, scale * side / 1000, drift * side / 1000, max(1, min(6, octaves))
    cells, lines = (math.ceil((w + moved) / wave) + 2) << octaves, (math.ceil(h / wave) + 2) << octaves

    def push(seed: int) -> np.ndarray:
        parts = [(lattice_noise(seed, cells, lines, (x + moved) / wave * 2**k, y / wave * 2**k) - 0.5) * 2 / 2**k for k in range(octaves)]
        return sum(parts[1:], parts[0]) / sum(0.5**k for k in range(octaves)) * reach

    return np.round(bilinear(picture, x + push(seed), y + push(seed + 0x5EED)), 9)


def liquid(plates: DataFrame, amplitude: int = 40, scale: int = 150, octaves: int = 2, drift: int = 0, seed: int = 0) -> DataFrame:
    """Pixels pushed by two fields of noise."""
    return repainted_together(plates, pushed, amplitude=amplitude, scale=scale, octaves=octaves, drift=drift, seed=seed) if scale else plates


def dragged(picture: np.ndarray, kind: str, length: int, angle: float, center, mix: float, blend: str) -> np.ndarray:
    h, w = picture.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    reach = length * max(w, h) / 1000
    steps = max(1, min(32, math.ceil(reach)))
    cx, cy = center[0] / 100 * (w - 1), center[1] / 100 * (h - 1)
    dx, dy, turn, total = x - cx, y - cy, reach / (w / 2), 0.0
    for t in (k / steps for k in range(steps)):
        if kind == "motion":
            u, v = x + math.cos(math.radians(angle)) * reach * t, y + math.sin(math.radians(angle)) * reach * t
        elif kind == "zoom":
            u, v = x - dx * turn * t, y - dy * turn * t
        else:
            u, v = cx + dx * math.cos(turn * t) - dy * math.sin(turn * t), cy + dx * math.sin(turn * t) + dy * math.cos(turn * t)
        total = total + bilinear(picture, u, v)
    smear = np.floor(np.round(total / steps, 9) + 0.5)
    blended = {"lighten": lambda c, o: np.maximum(c, o), "screen": lambda c, o: 255 - (255 - c) * (255 - o) / 255, "normal": lambda c, o: o}[blend]
    return picture + (blended(picture, smear) - picture) * (mix / 100)


def drag(plates: DataFrame, kind: str = "motion", length: int = 60, angle: float = 0, center=(50, 50), mix: int = 70, blend: str = "lighten") -> DataFrame:
    """A smear: the mean of up to 32 samples along a line, towards a centre, or round it."""
    return repainted_together(plates, dragged, kind=kind, length=length, angle=angle, center=center, mix=mix, blend=blend)


def bloomed(picture: np.ndarray, threshold: float, radius: int, strength: float) -> np.ndarray:
    h, w = picture.shape[:2]
    light, sigma = luma(picture), max(0.5, radius * max(w, h) / 2000)
    keep = np.where(light >= threshold, np.minimum(1.0, (light - threshold) / max(255.0 - threshold, 1.0)), 0.0)
    lights = np.floor(picture * keep[..., None] + 0.5).reshape(h, w, -1)
    across = blurring(w, sigma) @ lights
    glow = np.floor(np.round((blurring(h, sigma) @ across.reshape(h, -1)).reshape(picture.shape), 9) + 0.5)
    return picture + (255 - (255 - picture) * (255 - glow) / 255.0 - picture) * (strength / 100)


def bloom(plates: DataFrame, threshold: int = 200, radius: int = 30, strength: int = 60) -> DataFrame:
    """Lights blurred and screened back."""
    return repainted_together(plates, bloomed, threshold=threshold, radius=radius, strength=strength)


def diffused(light: np.ndarray) -> np.ndarray:
    """White (True) by error diffusion, along slanted lines: the pixels of one line need only those of earlier lines."""
    h, w = light.shape[:2]
    held = np.zeros((h + 1, w + 2, *light.shape[2:]))
    held[:h, 1:-1] = light
    white = np.zeros(light.shape, bool)
    for line in range(w + 2 * h - 2):
        y = np.arange(max(0, (line - w + 2) // 2), min(h - 1, line // 2) + 1)
        x = line - 2 * y + 1
        old = held[y, x]
        on = old >= 128
        white[y, x - 1] = on
        error = old - np.where(on, 255.0, 0.0)
        for down, aside, share in ((1, -1, 3), (0, 1, 7), (1, 0, 5), (1, 1, 1)):
            held[y + down, x + aside] += error * share / 16
    return white


def dithered(picture: np.ndarray, method: str, size: int, mid: int) -> np.ndarray:
    h, w = picture.shape[:2]
    dot = max(1, scaled(size, max(h, w)))
    sh, sw = max(1, h // dot), max(1, w // dot)
    small = picture
    if dot > 1:
        small = np.floor(np.round(resized(picture.reshape(h, w, -1), sh, sw), 9) + 0.5).reshape(sh, sw, *picture.shape[2:])
    light = np.clip(luma(small) + 128.0 - mid, 0, 255)
    if method == "bayer":
        limit = (np.array(BAYER)[np.arange(sh)[:, None] % 8, np.arange(sw)[None, :] % 8] + 0.5) * 4
        white = light >= limit.reshape(sh, sw, *[1] * (light.ndim - 2))
    else:
        white = diffused(light)
    ys, xs = np.minimum(np.arange(h) // dot, sh - 1), np.minimum(np.arange(w) // dot, sw - 1)
    return np.repeat(np.where(white, 255.0, 0.0)[np.ix_(ys, xs)][..., None], 3, -1)


def dither(plates: DataFrame, method: str = "diffusion", size: int = 2, mid: int = 128) -> DataFrame:
    """Black and white dots of ``size``; brightness ``mid`` counts as the middle."""
    return repainted_together(plates, dithered, method=method, size=size, mid=mid)


def lattice_noise(seed: int, columns: int, rows: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smooth noise from 0 to 1 over a lattice of draws, repeating beyond it."""
    u0, v0 = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    fu, fv = ((t * t * (3 - 2 * t)) for t in (u - u0, v - v0))
    at = lambda i, j: (split_mix(seed, (v0 + j) % rows * columns + (u0 + i) % columns) % np.uint64(10_001)).astype(float) / 10_000
    top, bottom = (at(0, j) * (1 - fu) + at(1, j) * fu for j in (0, 1))
    return top * (1 - fv) + bottom * fv


def leak(plates: DataFrame, color: Colour = (255, 150, 60), strength: int = 70, size: int = 50, edge: str = "random", spread: int = 0, wobble: int = 0, seed: int = 0) -> DataFrame:
    """A screened glow from one side, or from a drawn point of the edge; its hue may wander and its reach and strength waver."""

    def effect(picture):
        h, w = picture.shape[:2]
        y, x = np.mgrid[:h, :w].astype(float)
        drawn = Draws(seed)
        if edge == "random":
            along, side = drawn.below(1001) / 1000, drawn.below(4)
            ox, oy = ((0, h * along), (w, h * along), (w * along, 0), (w * along, h))[side]
            away = np.hypot(x - ox, y - oy)
        else:
            away = {"left": x, "right": w - x, "top": y, "bottom": h - y}[edge]
        reach, power, ink = w * size / 100, strength / 100, np.array(color, float)
        if spread > 0 or wobble > 0:
            uneven = []
            for patch, more in zip((PATCH, PATCH, TINT_PATCH), PATCH_SEEDS, strict=True):
                cell = max(1.0, patch * max(h, w) / 1000)
                uneven.append((lattice_noise(seed + more, math.ceil(w / cell) + 2, math.ceil(h / cell) + 2, x / cell, y / cell) - 0.5) * 2)
            reach = reach * np.maximum(0.2, 1 + uneven[0] * wobble / 100 * 0.8)
            power = power * np.maximum(0.0, 1 + uneven[1] * wobble / 100 * 0.8)
            hue, saturation, value = to_hsv(ink)
            ink = from_hsv(hue + uneven[2] * spread, np.full((h, w), saturation), np.full((h, w), value))
        glow = np.clip(1 - away / np.maximum(1.0, reach), 0, 1)
        return picture + (255 - (255 - picture) * (255 - ink) / 255 - picture) * (glow * glow * power)[..., None]

    return repainted(plates, effect)


def slices(plates: DataFrame, count: int = 12, shift: int = 120, tall=(8, 120), split: bool = False, invert: bool = False, seed: int = 0) -> DataFrame:
    """Bands of rows drawn from the seed and moved sideways, with ``split`` each channel by itself; with ``invert`` every third or so turns negative."""

    def effect(picture):
        h, w = picture.shape[:2]
        side, drawn, out = max(h, w), Draws(seed), picture.copy()
        for _ in range(count):
            rows = max(1, drawn.between(scaled(tall[0], side), scaled(tall[1], side)))
            top, most = drawn.below(h), scaled(shift, side)
            band = slice(top, min(h, top + rows))
            first = drawn.around(most)
            moves = [first, drawn.around(most), drawn.around(most)] if split else [first] * 3
            negative = invert and drawn.below(3) == 0
            for c, dx in enumerate(moves):
                own = np.roll(picture[band, :, c], dx, axis=1)
                out[band, :, c] = 255 - own if negative else own
        return out

    return repainted(plates, effect)
