"""Image signals from decoded pixels: sharpness and perceptual hash.

The columns are those of Spark's ``image`` source: height, width, nChannels and
data (rows from the top, channels in BGR order). Nothing outside numpy is used.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed-point luma weights of the two common gray conversions
# (blue, green, red), their shift and their rounding term.
BLUR_WEIGHTS = (1868, 9617, 4899, 14)
HASH_WEIGHTS = (7471, 38470, 19595, 16)
HASH_SIDE = 8
DCT_SIDE = 32


def gray(height, width, channels, data, weights) -> np.ndarray | None:
    """Gray pixels as int64, or null for what cannot be read."""
    if data is None or min(height, width, channels) < 1:
        return None
    pixels = np.frombuffer(data, dtype=np.uint8)
    if pixels.size != height * width * channels:
        return None
    pixels = pixels.reshape(height, width, channels).astype(np.int64)
    if channels < 3:
        return pixels[:, :, 0]
    blue, green, red, shift = weights
    total = pixels[:, :, 0] * blue + pixels[:, :, 1] * green + pixels[:, :, 2] * red
    return (total + (1 << (shift - 1))) >> shift


def laplacian_variance(pixels: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, border reflected
    without repeating the edge pixel."""
    height, width = pixels.shape
    rows = np.pad(pixels, ((1, 1), (0, 0)), mode="reflect" if height > 1 else "edge")
    cols = np.pad(pixels, ((0, 0), (1, 1)), mode="reflect" if width > 1 else "edge")
    return float((rows[:-2] + rows[2:] + cols[:, :-2] + cols[:, 2:] - 4 * pixels).var())


@lru_cache(maxsize=4096)
def _lanczos(size: int) -> np.ndarray:
    """Weights that resample ``size`` pixels to 32, support scaled with the step."""
    step = size / DCT_SIDE
    scale = max(step, 1.0)
    centers = (np.arange(DCT_SIDE) + 0.5) * step
    low = np.maximum((centers - 3 * scale + 0.5).astype(int), 0)
    high = np.minimum((centers + 3 * scale + 0.5).astype(int), size)
    positions = np.arange(size)
    distance = (positions[None, :] - centers[:, None] + 0.5) / scale
    weights = np.where(np.abs(distance) < 3, np.sinc(distance) * np.sinc(distance / 3), 0.0)
    inside = (positions[None, :] >= low[:, None]) & (positions[None, :] < high[:, None])
    weights = np.where(inside, weights, 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _clip(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255)


def _shrink(pixels: np.ndarray) -> np.ndarray:
    values = pixels.astype(np.float64)
    height, width = pixels.shape
    if width != DCT_SIDE:
        values = _clip(values @ _lanczos(width).T)
    if height != DCT_SIDE:
        values = _clip(_lanczos(height) @ values)
    return values


@lru_cache(maxsize=1)
def _dct() -> np.ndarray:
    n = np.arange(DCT_SIDE)
    k = np.arange(HASH_SIDE)[:, None]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * DCT_SIDE))


def perceptual_hash(pixels: np.ndarray) -> str:
    """64-bit DCT hash: the low frequencies of the 32x32 image against their
    median, row by row, the highest bit first.

    Coefficients are rounded to 6 decimals, so that values which are equal but
    for floating-point noise (as in a flat image) do not become random bits.
    """
    matrix = _dct()
    low = np.round(matrix @ _shrink(pixels) @ matrix.T, 6).ravel()
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


def _each(function, weights, height, width, channels, data) -> pd.Series:
    values = []
    for row in zip(height, width, channels, data):
        pixels = None if any(v is None or v != v for v in row[:3]) else gray(
            int(row[0]), int(row[1]), int(row[2]), row[3], weights
        )
        values.append(None if pixels is None else function(pixels))
    return pd.Series(values, dtype=object)


@F.pandas_udf(T.DoubleType())
def blur_score(
    height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series
) -> pd.Series:
    """Sharpness: variance of the Laplacian; null where there are no pixels."""
    return _each(laplacian_variance, BLUR_WEIGHTS, height, width, channels, data).astype(float)


@F.pandas_udf(T.DoubleType())
def gray_variance(
    height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series
) -> pd.Series:
    """Population variance of the gray values, a cruder measure of detail."""
    return _each(
        lambda pixels: float(pixels.var()), HASH_WEIGHTS, height, width, channels, data
    ).astype(float)


@F.pandas_udf(T.StringType())
def phash(
    height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series
) -> pd.Series:
    """Perceptual hash as 16 hex digits; null where there are no pixels."""
    return _each(perceptual_hash, HASH_WEIGHTS, height, width, channels, data)


def measure(
    min_sharpness: float | None = None, with_score: bool = True, with_detail: bool = False, with_hash: bool = True
):
    """All signals of an image in one pass over its pixels, as a struct.

    The function takes height, width, nChannels, data and what is known already of
    blur_score and phash. It stops early: a picture below ``min_sharpness`` is not hashed,
    and a signal that is known or not asked for is not computed. Null pixels give the
    known signals back.
    """

    @F.pandas_udf("blur_score double, gray_variance double, phash string")
    def run(
        height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series, score: pd.Series, known: pd.Series
    ) -> pd.DataFrame:
        scores, details, hashes = [], [], []
        for high, wide, depth, raw, sharp, digits in zip(height, width, channels, data, score, known):
            sharp, detail = (None if sharp is None or sharp != sharp else sharp), None
            shaped = raw is not None and not any(v is None or v != v for v in (high, wide, depth))
            shape = (int(high), int(wide), int(depth), raw) if shaped else (0, 0, 0, None)
            if with_score and sharp is None and (pixels := gray(*shape, BLUR_WEIGHTS)) is not None:
                sharp = laplacian_variance(pixels)
            blurred = min_sharpness is not None and sharp is not None and sharp < min_sharpness
            hashing = with_hash and digits is None and not blurred
            if (hashing or with_detail) and (pixels := gray(*shape, HASH_WEIGHTS)) is not None:
                detail = float(pixels.var()) if with_detail else None
                digits = perceptual_hash(pixels) if hashing else digits
            scores.append(sharp)
            details.append(detail)
            hashes.append(digits)
        return pd.DataFrame(
            {
                "blur_score": pd.Series(scores, dtype="float64"),
                "gray_variance": pd.Series(details, dtype="float64"),
                "phash": pd.Series(hashes, dtype=object),
            }
        )

    return run
