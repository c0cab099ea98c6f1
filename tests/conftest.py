import os
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from framewright.session import ship_packages

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_packages(session, os.path.join(ROOT, "checks"))
    yield session
    session.stop()


def write_png(path, pixels: np.ndarray) -> None:
    """Gray or RGB pixels as a PNG, with nothing but zlib."""
    height, width = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    rows = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(height))

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    header = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    with open(path, "wb") as out:
        out.write(
            b"\x89PNG\r\n\x1a\n"
            + chunk(b"IHDR", header)
            + chunk(b"IDAT", zlib.compress(rows))
            + chunk(b"IEND", b"")
        )


def record_row(**values):
    """A complete record with the given values."""
    import datetime

    row = {
        "id": "x", "source": "unsplash", "source_id": "abc123", "url": "https://example.org/p",
        "download_url": "https://example.org/p.jpg", "local_path": None, "license_type": "unsplash",
        "license_url": "https://unsplash.com/license", "attribution": "Photo by Jane Doe on Unsplash",
        "photographer": "Jane Doe", "photographer_url": "", "width": 800, "height": 600,
        "file_size_bytes": 0, "format": "", "tags": ["dog"], "description": "", "blur_score": None,
        "phash": None, "downloaded_at": datetime.datetime(2024, 1, 2), "query": "golden retriever",
        "dataset_name": "", "ordinal": 0,
    }
    row.update(values)
    return row


@pytest.fixture
def frame(spark):
    from framewright.schema import MANIFEST

    def build(*rows):
        return spark.createDataFrame([record_row(**r) for r in rows], MANIFEST)

    return build
