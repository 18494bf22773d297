"""Development of pictures in their camera's colours: ``(pic, width, height, camera, preview, balance, matrix)``, one row each.

``camera`` holds linear channels of all pixels, row by row, with 1 the sensor's white; ``preview`` the camera's own picture,
channels 0 to 255, of any size. All stages of a picture run in one Arrow pass over its row, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .plates import PLATE, reading

#: Shares of red, green and blue in linear light.
LUMA = np.array([0.2126, 0.7152, 0.0722])
#: Fixed values, in linear light: where highlights bend and how fast, what turns white, what the sensor clips, lifts, shadows, gains.
KNEE, SHOULDER = 0.6, 1.2
WHITE_FROM, WHITE_RANGE, WHITE_MOST = 1.0, 6.0, 0.3
CLIP_FROM, CLIP_TO, CLIP_NEUTRAL = 0.80, 0.99, 0.9
LIFT, LIFT_MOST = 0.8, 0.06
DARK_FROM, DARK_TO = 0.01, 0.08
LEAST_GAIN, MOST_GAIN, MOST_VIVID = 0.5, 8.0, 0.45
#: Pixels of a cell's side, cells that a blur of clipped or dark parts reaches, pixels that a median or mean needs, halvings.
CELL, CLIP_REACH, DARK_REACH, SAMPLE, HALVINGS = 4, 3, 2, 20_000, 10

DEVELOPED = PLATE + ", gain double, vividness double"


def _eased(low: float, high: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def averaging(size: int, reach: int) -> np.ndarray:
    """Matrix (size, size) of the mean over ``reach`` cells either way, fewer at the edges."""
    at = np.arange(size)
    near = np.abs(at[:, None] - at[None, :]) <= reach
    return near / near.sum(1, keepdims=True)


def cells(values: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """Values (height, width, ..) combined over square cells; those at the far edges may be smaller."""
    rows = combine.reduceat(values, np.arange(0, values.shape[0], CELL), axis=0)
    return combine.reduceat(rows, np.arange(0, values.shape[1], CELL), axis=1)


def read_smoothly(grid: np.ndarray, height: int, width: int, reach: int) -> np.ndarray:
    """Cells (rows, columns) blurred and read at every pixel between them."""
    rows, columns = grid.shape
    down = reading(height, rows, CELL) @ averaging(rows, reach)
    across = reading(width, columns, CELL) @ averaging(columns, reach)
    return down @ grid @ across.T


def clipped(camera: np.ndarray) -> np.ndarray:
    """How far each pixel is clipped, from 0 to 1: two of its channels count, of a cell the most clipped pixel."""
    middle = camera.sum(-1) - camera.max(-1) - camera.min(-1)
    top = np.maximum(cells(middle, np.maximum), 0)
    return read_smoothly(_eased(CLIP_FROM, CLIP_TO, top), *camera.shape[:2], CLIP_REACH)


#: Exchanges that bring the middle of nine values to place 4.
MIDDLE_OF_NINE = ((1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2))


def median3(values: np.ndarray) -> np.ndarray:
    """3 x 3 medians, edges repeated, by exchanges of whole pictures."""
    (h, w), padded = values.shape, np.pad(values, 1, mode="edge")
    p = [padded[y : y + h, x : x + w] for y in range(3) for x in range(3)]
    for a, b in MIDDLE_OF_NINE:
        p[a], p[b] = np.minimum(p[a], p[b]), np.maximum(p[a], p[b])
    return p[4]


def without_false_colour(camera: np.ndarray) -> np.ndarray:
    """Red and blue less green replaced by their 3 x 3 medians, edges repeated; pictures below 3 pixels stay."""
    if min(camera.shape[:2]) < 3:
        return camera
    green = camera[..., 1]
    out = camera.copy()
    for c in (0, 2):
        out[..., c] = green + median3(camera[..., c] - green)
    return out


def to_linear(camera: np.ndarray, balance: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Camera colours balanced and turned to linear sRGB; what is below 0 or above 1 stays."""
    return (camera * balance) @ matrix.T


def linear_of(encoded: np.ndarray) -> np.ndarray:
    return np.where(encoded <= 0.04045, encoded / 12.92, ((encoded + 0.055) / 1.055) ** 2.4)


def encoded_of(linear: np.ndarray) -> np.ndarray:
    linear = np.clip(linear, 0, 1)
    return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)


def _sampled(pixels: np.ndarray) -> np.ndarray:
    return pixels[:: max(1, len(pixels) // SAMPLE)]


def median_light(pixels: np.ndarray) -> float:
    """Upper median of the luminance of linear pixels (n, 3), 0 for none."""
    light = _sampled(pixels) @ LUMA
    return float(np.partition(light, len(light) // 2)[len(light) // 2]) if len(light) else 0.0


def gain_of(linear: np.ndarray, preview: np.ndarray) -> float:
    """What brings the median of ours (n, 3) to that of the camera's picture (n, 3); 1 where either is black."""
    ours, theirs = median_light(linear), median_light(linear_of(_sampled(preview) / 255))
    return min(max(theirs / ours, LEAST_GAIN), MOST_GAIN) if ours > 1e-6 and theirs > 1e-6 else 1.0


def vivid(rgb: np.ndarray, vividness: float) -> np.ndarray:
    """A share of each colour's least channel taken out."""
    return rgb - vividness * np.maximum(rgb.min(-1, keepdims=True), 0)


def into_gamut(rgb: np.ndarray) -> np.ndarray:
    """Colours with a negative channel get a little white; what is negative still is cut."""
    low = rgb.min(-1, keepdims=True)
    return np.where(low < 0, np.maximum(rgb + np.minimum(-low * LIFT, LIFT_MOST), 0), rgb)


def roll_off(rgb: np.ndarray) -> np.ndarray:
    """Highlights bent below 1, in their hue but for some white in the brightest."""
    top = rgb.max(-1, keepdims=True)
    above = np.maximum(top - KNEE, 0) / SHOULDER
    bent = np.where(top <= KNEE, top, KNEE + (1 - KNEE) * above / (1 + above))
    kept = rgb * np.where(top > 0, bent / np.where(top > 0, top, 1), 1)
    return kept + (bent - kept) * (np.clip((top - WHITE_FROM) / WHITE_RANGE, 0, 1) * WHITE_MOST)


def mean_saturation(encoded: np.ndarray) -> float:
    """Over the pixels (n, 3) that are not dark; 0 if all are."""
    top = encoded.max(-1)
    lit = top > 0.15
    return float(((top - encoded.min(-1))[lit] / top[lit]).mean()) if lit.any() else 0.0


def vividness_of(linear: np.ndarray, gain: float, preview: np.ndarray) -> float:
    """What makes our mean saturation that of the camera's picture, by halving; the saturation grows with it."""
    theirs, own = mean_saturation(_sampled(preview) / 255), _sampled(linear) * gain
    ours = lambda v: mean_saturation(encoded_of(roll_off(into_gamut(vivid(own, v)))))
    if ours(0.0) >= theirs:
        return 0.0
    if ours(MOST_VIVID) <= theirs:
        return MOST_VIVID
    low, high = 0.0, MOST_VIVID
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        low, high = (middle, high) if ours(middle) < theirs else (low, middle)
    return (low + high) / 2


def quiet_shadows(rgb: np.ndarray) -> np.ndarray:
    """Dark colours (after the gain) take the mean colour of the dark pixels about them and keep their luminance."""
    grey = rgb @ LUMA
    dark = 1 - _eased(DARK_FROM, DARK_TO, grey)
    parts = np.concatenate([dark[..., None] * (rgb - grey[..., None]), dark[..., None]], -1)
    sums = cells(parts, np.add)
    around = np.stack([read_smoothly(sums[..., k], *grey.shape, DARK_REACH) for k in range(4)], -1)
    weight = around[..., 3:]
    mean = np.where(weight < 1e-6, 0, around[..., :3] / np.where(weight < 1e-6, 1, weight))
    return rgb + dark[..., None] * (mean - (rgb - grey[..., None]))


def speckle(height: int, width: int) -> np.ndarray:
    """A fraction of each pixel, without a pattern."""
    y, x = np.mgrid[:height, :width].astype(np.uint32)
    with np.errstate(over="ignore"):
        h = x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77)
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(8)) / float(1 << 24)


def finished(linear: np.ndarray, gain: float, vividness: float, clip: np.ndarray | None) -> np.ndarray:
    """Linear light as channels 0 to 255."""
    rgb = into_gamut(vivid(quiet_shadows(linear * gain), vividness))
    if clip is not None:
        rgb = rgb + ((rgb @ LUMA)[..., None] - rgb) * (clip * CLIP_NEUTRAL)[..., None]
    dithered = encoded_of(roll_off(rgb)) * 255 + (speckle(*linear.shape[:2]) - 0.5)[..., None]
    return np.clip(np.floor(dithered + 0.5), 0, 255).astype(np.int16)


def _linear(camera: np.ndarray, balance: list | None, matrix: list | None) -> np.ndarray:
    balance = np.array([np.nan if v is None else v for v in balance or [None] * 3], float)
    return to_linear(without_false_colour(camera), np.ones(3) if np.isnan(balance).any() else balance, np.eye(3) if matrix is None else np.array(matrix, float).reshape(3, 3))


def _developed(camera: np.ndarray, preview: np.ndarray | None, balance: list | None, matrix: list | None) -> tuple[np.ndarray, float, float]:
    linear = _linear(camera, balance, matrix)
    gain, vividness = 1.0, 0.0
    if preview is not None and len(preview):
        flat = linear.reshape(-1, 3)
        gain = gain_of(flat, preview)
        vividness = vividness_of(flat, gain, preview)
    return finished(linear, gain, vividness, clipped(camera)), gain, vividness


def _numbers(column: pa.ListArray, k: int) -> np.ndarray | None:
    if not column.is_valid()[k].as_py():
        return None
    return column[k].values.to_numpy(zero_copy_only=False).astype(float)


def developed(pictures: DataFrame) -> DataFrame:
    """``(pic, width, height, rgb, gain, vividness)`` of pictures in camera colours.

    Exposure and saturation follow the preview; without one (null or empty) the gain is 1 and nothing is taken out. A null
    balance, or one with a null or NaN, is none; a null matrix says that the colours are linear sRGB. Without ``camera``, or with
    no pixels, ``rgb`` is null or empty and the rest null. A camera array of another length than its sides tell is an error.
    """

    def run(batches):
        schema = pa.schema([("pic", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.list_(pa.int16())), ("gain", pa.float64()), ("vividness", pa.float64())])
        for batch in batches:
            for k, own in enumerate(batch.select(["pic", "width", "height", "balance", "matrix"]).to_pylist()):
                camera, rgb, gain, vividness = _numbers(batch.column("camera"), k), None, None, None
                if camera is not None:
                    rgb = np.empty(0, np.int16)
                if camera is not None and own["width"] and own["height"]:
                    preview = _numbers(batch.column("preview"), k)
                    preview = None if preview is None else preview.reshape(-1, 3)
                    rgb, gain, vividness = _developed(camera.reshape(own["height"], own["width"], 3), preview, own["balance"], own["matrix"])
                    rgb = rgb.reshape(-1)
                cell = pa.array([None], schema.field("rgb").type) if rgb is None else pa.ListArray.from_arrays(pa.array([0, len(rgb)], pa.int32()), pa.array(rgb))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([own[c]], schema.field(c).type) for c in ("pic", "width", "height")), cell, pa.array([gain], pa.float64()), pa.array([vividness], pa.float64())], schema=schema
                )

    return pictures.select("pic", "width", "height", "camera", "preview", "balance", "matrix").mapInArrow(run, DEVELOPED)


def gains(pictures: DataFrame) -> DataFrame:
    """``(pic, gain)`` as from ``developed``, without the rest of the development."""

    def run(batches):
        for batch in batches:
            out = []
            for k, own in enumerate(batch.select(["width", "height", "balance", "matrix"]).to_pylist()):
                camera, preview = _numbers(batch.column("camera"), k), _numbers(batch.column("preview"), k)
                out.append(None)
                if camera is not None and own["width"] and own["height"]:
                    out[-1] = 1.0
                    if preview is not None and len(preview):
                        linear = _linear(camera.reshape(own["height"], own["width"], 3), own["balance"], own["matrix"])
                        out[-1] = gain_of(linear.reshape(-1, 3), preview.reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column("pic").cast(pa.int64()), pa.array(out, pa.float64())], names=["pic", "gain"])

    return pictures.select("pic", "width", "height", "camera", "preview", "balance", "matrix").mapInArrow(run, "pic long, gain double")


#: How an orientation tag turns the rows and columns of a picture as it is stored: mirrored rows, columns, then exchanged.
ORIENTATIONS = {1: (1, 1, False), 2: (1, -1, False), 3: (-1, -1, False), 4: (-1, 1, False), 5: (1, 1, True), 6: (-1, 1, True), 7: (-1, -1, True), 8: (1, -1, True)}


def upright(plates: DataFrame) -> DataFrame:
    """Plates turned as their column ``orientation`` tells; another number or null leaves them."""

    def run(batches):
        for batch in batches:
            rows = batch.select(["pic", "width", "height", "orientation"]).to_pylist()
            for k, own in enumerate(rows):
                down, across, exchanged = ORIENTATIONS.get(own["orientation"], ORIENTATIONS[1])
                picture = batch.column("rgb")[k].values.to_numpy().reshape(own["height"], own["width"], 3)[::down, ::across]
                picture = picture.transpose(1, 0, 2) if exchanged else picture
                cell = pa.ListArray.from_arrays(pa.array([0, picture.size], pa.int32()), pa.array(np.ascontiguousarray(picture).reshape(-1)))
                sides = [pa.array([n], pa.int32()) for n in (picture.shape[1], picture.shape[0])]
                yield pa.RecordBatch.from_arrays([pa.array([own["pic"]], pa.int64()), *sides, cell], names=["pic", "width", "height", "rgb"])

    return plates.select("pic", "width", "height", "rgb", "orientation").mapInArrow(run, PLATE)
