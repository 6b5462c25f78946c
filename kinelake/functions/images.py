"""Pixels as numpy arrays: scaling into a square, ImageNet scale, and columns of raw bytes.

Codecs are hooks (:mod:`kinelake.sources.formats`); these functions start from
height x width x 3 bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# ImageNet mean and deviation per channel.
MEAN = np.array([0.485, 0.456, 0.406], np.float32)
STD = np.array([0.229, 0.224, 0.225], np.float32)


def _places(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two pixels between which the middle of each new pixel lies, and the share of the second."""
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    first = np.minimum(at.astype(int), max(old - 2, 0))
    return first, np.minimum(first + 1, old - 1), (at - first).astype(np.float32)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear between the middles of pixels; whole numbers are rounded."""
    up, down, v = _places(height, image.shape[0])
    left, right, u = _places(width, image.shape[1])
    v, u = v[:, None, None], u[None, :, None]
    rows = image[up].astype(np.float32) * (1 - v) + image[down].astype(np.float32) * v
    out = rows[:, left] * (1 - u) + rows[:, right] * u
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out.astype(image.dtype)


def letterbox_size(height: int, width: int, size: int) -> tuple[int, int, int, int]:
    """Height and width inside the square, and the black rows above and columns before."""
    scale = size / max(height, width)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    return h, w, (size - h) // 2, (size - w) // 2


def letterbox(image: np.ndarray, size: int = 224) -> np.ndarray:
    h, w, top, left = letterbox_size(*image.shape[:2], size)
    out = np.zeros((size, size, image.shape[2]), image.dtype)
    out[top : top + h, left : left + w] = resize(image, h, w)
    return out


def black(size: int = 224) -> np.ndarray:
    """What stands for a frame of an absent camera; its mask is false."""
    return np.zeros((size, size, 3), np.uint8)


def imagenet(image: np.ndarray) -> np.ndarray:
    """Channels first, scaled by the ImageNet statistics."""
    return ((image.astype(np.float32) / 255 - MEAN) / STD).transpose(2, 0, 1)


def letterbox_column(pixels, height, width, size: int = 224):
    """Raw bytes of images as raw bytes of ``size`` squares; null is black."""

    def run(raw: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        empty = black(size).tobytes()
        return pd.Series([empty if r is None else letterbox(np.frombuffer(r, np.uint8).reshape(int(a), int(b), 3), size).tobytes() for r, a, b in zip(raw, h, w)])

    return F.pandas_udf(run, "binary")(pixels, height, width)


def bf16_float(bits: np.ndarray) -> np.ndarray:
    """float32 of brain-float bits kept as uint16."""
    return (np.asarray(bits, np.uint16).astype(np.uint32) << 16).view(np.float32)


def float_bf16(x: np.ndarray) -> np.ndarray:
    """Brain-float bits of float32, rounded half to even; NaN stays NaN."""
    raw = np.asarray(x, np.float32).view(np.uint32)
    rounded = ((raw + 0x7FFF + ((raw >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(x), np.uint16(0x7FC0), rounded)


def bf16_column(bits):
    """array<int> of brain-float bits as array<float>."""

    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bf16_float(np.array(x)).tolist() for x in v])

    return F.pandas_udf(run, "array<float>")(bits)
