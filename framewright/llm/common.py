"""What the training-data operators share: table access, folds, batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import ship_packages

#: Rows of one Arrow batch: a thousand long texts fit into a small Python worker.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Give workers this package, and keep Arrow batches of texts small."""
    ship_packages(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of a column's text modulo ``folds`` (a null counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def unit_hash(seed: int, *columns: str) -> Column:
    """A seeded pseudo-random number in [0, 1), the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def text_slices(batches: Iterator[pd.DataFrame], column: str, chars: int) -> Iterator[pd.DataFrame]:
    """Cut batches so that each holds about ``chars`` characters, or one longer text."""
    for batch in batches:
        lengths = batch[column].str.len().fillna(0).to_numpy()
        start, total = 0, 0
        for i, length in enumerate(lengths):
            if total and total + length > chars:
                yield batch.iloc[start:i]
                start, total = i, 0
            total += length
        if start < len(batch):
            yield batch.iloc[start:]


def byte_slices(batches: Iterator[pd.DataFrame], columns: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Cut batches so that the binary columns of each hold about ``most`` bytes, or one longer row."""
    for batch in batches:
        sizes = sum((batch[c].map(len).to_numpy() for c in columns), np.zeros(len(batch), np.int64))
        number = np.cumsum(sizes) // most
        for n in np.unique(number):
            yield batch[number == n]


def unused(name: str, columns: list[str]) -> str:
    """A column name that the table does not have yet: ``name`` with underscores in front."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, or ``name`` itself if it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
