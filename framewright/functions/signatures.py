"""File formats by the bytes at a file's start, whatever its name says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that the signatures look at.
HEAD_BYTES = 16

# The first bytes of image files as hex digits.
SIGNATURES = {
    "JPEG": "^FFD8FF",
    "PNG": "^89504E470D0A1A0A",
    "GIF": "^474946383[79]61",
    "BMP": "^424D",
    "TIFF": "^(49492A00|4D4D002A|49492B00|4D4D002B)",
    "WEBP": "^52494646.{8}57454250",
}


def format_of(head: Column) -> Column:
    """Name of the format whose signature opens the bytes; null for an unknown one."""
    digits = F.hex(F.substring(head, 1, HEAD_BYTES))
    name = F.lit(None).cast("string")
    for known, signature in SIGNATURES.items():
        name = F.when(digits.rlike(signature), known).otherwise(name)
    return name
