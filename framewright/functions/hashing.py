"""64-bit perceptual hashes: parsing, distance and covering masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_PATTERN = "^[0-9a-fA-F]{16}$"
MAX_THRESHOLD = 24
# Part radii up to this value keep a light cover at 2**7 - 1 masks per part.
MAX_PART_RADIUS = 6


def is_hash(column: Column) -> Column:
    """True for 16 hex digits; null or malformed text is not a hash."""
    return F.coalesce(column.rlike(HASH_PATTERN), F.lit(False))


def hash_bits(column: Column) -> Column:
    """16 hex digits as a BIGINT with the same 64 bits, else null."""

    def half(start):
        return F.conv(F.substring(column, start, 8), 16, 10).cast("bigint")

    return F.when(is_hash(column), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _field_power(value: int, exponent: int, degree: int) -> int:
    """value**exponent in GF(2**degree)."""
    # Primitive polynomials over GF(2), by degree.
    polynomial = {1: 0b11, 2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011}[degree]
    result = 1
    for _ in range(exponent):
        product, shifted = 0, result
        for bit in range(degree):
            if value >> bit & 1:
                product ^= shifted
            shifted <<= 1
            if shifted >> degree & 1:
                shifted ^= polynomial
        result = product
    return result


def covering_masks(radius: int, width: int = 64, offset: int = 0) -> list[int]:
    """Masks such that words within ``radius`` agree under at least one of them.

    A covering family without false negatives (Pagh, "CoveringLSH", 2018). Bit
    position i gets a vector of radius + 1 bits, and mask v holds the positions
    whose vector has odd overlap with v. The positions where two words differ
    give at most ``radius`` linear conditions on v, so some v other than 0 is
    free of all of them. The vectors are columns of an extended BCH code, which
    keeps the masks near half of the positions: 2**(radius + 1) - 1 masks.
    """
    degree = max(1, (width - 1).bit_length())
    vectors = []
    for position in range(width):
        bits = [1]
        for exponent in (1, 3, 5, 7):
            power = _field_power(position, exponent, degree)
            bits += [power >> bit & 1 for bit in range(degree)]
        bits += [position >> bit & position >> (bit + 1) & 1 for bit in range(degree)]
        vectors.append(sum(bit << rank for rank, bit in enumerate(bits[: radius + 1])))
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = 0
        for position, vector in enumerate(vectors):
            if bin(vector & v).count("1") & 1:
                mask |= 1 << (position + offset)
        masks.append(mask)
    return masks


def _split_cover(threshold: int, parts: int) -> list[int]:
    """Masks by pigeonhole: words within the threshold are within radius r_p in
    some part p as long as the radii plus one add up to more than the threshold."""
    total = threshold - parts + 1
    masks, offset = [], 0
    for part in range(parts):
        radius = total // parts + (1 if part < total % parts else 0)
        width = 64 // parts + (1 if part < 64 % parts else 0)
        masks += covering_masks(radius, width, offset)
        offset += width
    return masks


def _light_parts(threshold: int) -> int:
    parts = 1
    while -(-(threshold - parts + 1) // parts) > MAX_PART_RADIUS:
        parts += 1
    return parts


def light_cover(threshold: int) -> np.ndarray:
    """Few masks of few bits each: cheap keys, broad buckets."""
    masks = _split_cover(threshold, _light_parts(threshold))
    return np.array([_signed(m) for m in masks], dtype=np.int64)


def deep_cover(threshold: int) -> np.ndarray:
    """More masks of more bits each, for rows whose light buckets are crowded.

    Equal to the light cover where that already spans all 64 bits at once.
    """
    masks = _split_cover(threshold, max(1, _light_parts(threshold) - 1))
    return np.array([_signed(m) for m in masks], dtype=np.int64)
