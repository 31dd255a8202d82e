"""Pluggable encoders: text or pictures to embedding columns.

An encoder is any Column -> Column function. The hash projection stands in where no model is given: a
text's words vote for signed hashed dimensions, and the vector is scaled to length one.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vectors as V

# Picture size and the channel scaling of the picture encoder's input.
PICTURE_SIDE = 224
PIXEL_MEAN = 0.5
PIXEL_STD = 0.5
# Pictures beyond the first side go to the second by nearest pixels before they are resized; loaders keep pictures within the third;
# side and scaling of the detector's input; side of an aligned face.
LARGE_SIDE, MIDDLE_SIDE, LOADED_SIDE = 896, 448, 512
DETECTOR_SIDE, DETECTOR_MEAN, DETECTOR_STD = 640, 127.5, 128.0
FACE_SIDE = 112


def hash_projection(text: Column, dimension: int = 64) -> Column:
    """Deterministic bag-of-words embedding; the zero vector for a text without words."""
    hashes = F.transform(T.tokens(F.lower(text)), lambda t: F.xxhash64(t))
    empty = F.array_repeat(F.lit(0.0), dimension)
    slots = F.transform(hashes, lambda h: F.struct(F.pmod(h, F.lit(dimension)).alias("at"), F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    vector = F.aggregate(slots, empty, lambda sums, s: F.transform(sums, lambda x, i: F.when(i == s["at"], x + s["sign"]).otherwise(x)))
    return V.normalise(vector)


def onnx_encoder(model_path: str, input_name: str = "input_ids"):
    """Encoder that runs an ONNX text model on token ids, one session for each worker. The path must be readable on executors."""

    def encode(ids: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime

            session = onnxruntime.InferenceSession(model_path)
            for rows in batches:
                out = session.run(None, {input_name: np.stack(rows.to_list()).astype(np.int64)})[0]
                lengths = np.linalg.norm(out, axis=1, keepdims=True)
                yield pd.Series(list(out / np.where(lengths == 0, 1, lengths)))

        return V.as_double(run(ids))

    return encode


def resize_bilinear(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Picture (h, w, channels) at another size; sample points lie at pixel centres."""
    h, w = pixels.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = pixels[y0][:, x0] * (1 - fx) + pixels[y0][:, x1] * fx
    bottom = pixels[y1][:, x0] * (1 - fx) + pixels[y1][:, x1] * fx
    return top * (1 - fy) + bottom * fy


def resize_nearest(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = pixels.shape[:2]
    return pixels[np.arange(height) * h // height][:, np.arange(width) * w // width]


def within_side(pixels: np.ndarray, side: int = LOADED_SIDE) -> np.ndarray:
    """Picture with its longer side at most ``side``, in its proportions."""
    h, w = pixels.shape[:2]
    if max(h, w) <= side:
        return pixels
    return resize_bilinear(pixels.astype(float), max(1, round(h * side / max(h, w))), max(1, round(w * side / max(h, w))))


def decode_picture(content: bytes) -> np.ndarray | None:
    """RGB pixels (h, w, 3) of a picture file, within ``LOADED_SIDE``; null where it cannot be read.

    Portable pixmaps are read here; other formats take an image library where one is installed.
    """
    if found := re.match(rb"P6\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content):
        w, h, top = map(int, found.groups())
        body = np.frombuffer(content, dtype=np.uint8, offset=found.end())
        return within_side(body[: h * w * 3].reshape(h, w, 3) * (255.0 / top)) if 0 < top < 256 and len(body) >= h * w * 3 else None
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        return within_side(np.asarray(Image.open(io.BytesIO(content)).convert("RGB")))
    except (OSError, ValueError):
        return None


def letterbox(pixels: np.ndarray, side: int = DETECTOR_SIDE) -> tuple[np.ndarray, float, float, float]:
    """(channels-first detector input, scale, pad_x, pad_y): the picture in its proportions, centred on black."""
    h, w = pixels.shape[:2]
    scale = min(side / h, side / w)
    high, wide = max(1, round(h * scale)), max(1, round(w * scale))
    top, left = (side - high) // 2, (side - wide) // 2
    whole = np.zeros((side, side, 3))
    whole[top : top + high, left : left + wide] = resize_bilinear(pixels.astype(float), high, wide)
    return ((whole - DETECTOR_MEAN) / DETECTOR_STD).transpose(2, 0, 1).astype(np.float32), scale, float(left), float(top)


def face_input(pixels: np.ndarray, points: np.ndarray | None, target: np.ndarray, box: tuple[float, float, float, float], side: int = FACE_SIDE) -> np.ndarray:
    """Channels-first input of the face encoder: warped to the target's points or, where there are none or they coincide, the box cut out."""
    matrix = None if points is None else _aligned(np.asarray(points, dtype=float).ravel(), target)
    if matrix is not None:
        face = warp(pixels.astype(float), np.asarray(matrix).reshape(2, 3), side)
    else:
        h, w = pixels.shape[:2]
        left, top = int(np.clip(box[0], 0, w - 1)), int(np.clip(box[1], 0, h - 1))
        right, bottom = int(np.clip(math.ceil(box[2]), left + 1, w)), int(np.clip(math.ceil(box[3]), top + 1, h))
        face = resize_bilinear(pixels[top:bottom, left:right].astype(float), side, side)
    return (face / DETECTOR_MEAN - 1).transpose(2, 0, 1).astype(np.float32)


def picture_input(pixels: np.ndarray, side: int = PICTURE_SIDE) -> np.ndarray:
    """Channels-first model input of an RGB picture: resized, scaled to -1..1."""
    if max(pixels.shape[:2]) > LARGE_SIDE:
        pixels = resize_nearest(pixels, MIDDLE_SIDE, MIDDLE_SIDE)
    small = resize_bilinear(pixels.astype(float), side, side)
    return ((small / 255.0 - PIXEL_MEAN) / PIXEL_STD).transpose(2, 0, 1).astype(np.float32)


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of the least-squares rotation, scale and shift that takes points to points."""
    mean_s, mean_t = source.mean(0), target.mean(0)
    a, b = source - mean_s, target - mean_t
    variance = (a**2).sum()
    if variance == 0:
        raise ValueError("points coincide")
    cos, sin = (a * b).sum() / variance, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / variance
    linear = np.array([[cos, -sin], [sin, cos]])
    return np.hstack([linear, (mean_t - linear @ mean_s)[:, None]])


def warp(pixels: np.ndarray, matrix: np.ndarray, side: int) -> np.ndarray:
    """Picture moved by a 2 x 3 matrix to a square of ``side``, bilinear; outside is 0."""
    full = np.vstack([matrix, [0, 0, 1]])
    back = np.linalg.inv(full)
    ys, xs = np.mgrid[0:side, 0:side]
    x, y, _ = back @ np.stack([xs.ravel(), ys.ravel(), np.ones(side * side)])
    h, w = pixels.shape[:2]
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    mixed = (pixels[y0, x0] * (1 - fx) + pixels[y0, x1] * fx) * (1 - fy) + (pixels[y1, x0] * (1 - fx) + pixels[y1, x1] * fx) * fy
    return (mixed * inside[:, None]).reshape(side, side, -1)


class Encoders:
    """Named encoders in order of preference; the first that is available serves, and its name keys stored embeddings."""

    def __init__(self, options: dict[str, tuple[Callable[[], bool], Callable[[Column], Column]]]) -> None:
        self.options = options

    def pick(self, wanted: str | None = None) -> tuple[str, Callable[[Column], Column]]:
        for name, (available, encode) in self.options.items():
            if wanted in (None, name) and available():
                return name, encode
        raise ValueError("no encoder is available" if wanted is None else f"encoder {wanted!r} is not available")


def picture_inputs(pixels: Column, height: int, width: int, side: int = PICTURE_SIDE) -> Column:
    """Flat channels-first model inputs of flat RGB pictures of one size; null where a picture has another."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda p: picture_input(np.asarray(p, dtype=float).reshape(height, width, 3), side).ravel() if p is not None and len(p) == height * width * 3 else None)

    return run(pixels)


def alignment(points: Column, target: np.ndarray) -> Column:
    """The six numbers of the transform that takes a face's flat points to the target's; null where they coincide or are incomplete."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda p: _aligned(p, target))

    return run(points)


def _aligned(flat, target: np.ndarray) -> list[float] | None:
    if flat is None or len(flat) != target.size:
        return None
    try:
        return similarity_transform(np.asarray(flat, dtype=float).reshape(target.shape), target).ravel().tolist()
    except ValueError:
        return None
