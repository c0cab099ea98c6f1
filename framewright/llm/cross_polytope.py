"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a
fast Hadamard transform) and hashed to the nearest signed axis. Several tables
use rotations of their own; a second, shorter rotation splits
each axis into cells, the more the larger the index, so that cells stay about the same size. A query looks into
the cells nearest to it over all tables together, those that miss the nearest cell of their table by the
smallest margin, and every candidate found there is ranked by its exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import prepare
from framewright.session import materialize

#: Rows of a bucket that one task compares with the bucket's queries at a time.
PART_ROWS = 4096
#: Queries whose distances to all cells are held at once.
QUERY_ROWS = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    rows, dims, step = len(x), x.shape[1], 1
    while step < dims:
        y = x.reshape(rows, dims // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, dims)
        step *= 2
    return x / np.sqrt(dims)


class Hashes:
    """Signed axes of vectors in every table; the rotations follow from the seed."""

    def __init__(self, dims: int, tables: int, fine: int, seed: int):
        self.dims, self.width, self.fine = dims, 1 << max(1, (dims - 1).bit_length()), fine
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (tables, 2, 3, self.width))

    def _turned(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        for signs in self.signs[table, which]:
            x = hadamard(x * signs)
        return x

    def closeness(self, x: np.ndarray, table: int) -> np.ndarray:
        """How near each row is to each bucket's direction, larger is nearer."""
        x = np.pad(x, ((0, 0), (0, self.width - self.dims)))
        y = self._turned(x, table, 0)
        axes = np.concatenate([y, -y], axis=1)
        if self.fine < 2:
            return axes
        z = self._turned(x, table, 1)[:, : self.fine // 2]
        return (axes[:, :, None] + np.concatenate([z, -z], axis=1)[:, None, :]).reshape(len(x), -1)

    def places(self, x: np.ndarray) -> np.ndarray:
        """The nearest bucket of each row in every table: (rows, tables)."""
        x = np.pad(x, ((0, 0), (0, self.width - self.dims)))
        out = np.empty((len(x), len(self.signs)), np.int64)
        for table in range(len(self.signs)):
            y = self._turned(x, table, 0)
            out[:, table] = np.concatenate([y, -y], axis=1).argmax(axis=1)
            if self.fine > 1:
                z = self._turned(x, table, 1)[:, : self.fine // 2]
                out[:, table] = out[:, table] * self.fine + np.concatenate([z, -z], axis=1).argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` buckets of all tables, as table * buckets + bucket, that miss their table's nearest least."""
        behind = []
        for table in range(len(self.signs)):
            near = self.closeness(x, table)
            behind.append(near.max(axis=1, keepdims=True) - near)
        behind = np.concatenate(behind, axis=1)
        return np.argpartition(behind, min(count, behind.shape[1]) - 1, axis=1)[:, :count]


def fine_buckets(rows: int, dims: int, bucket_rows: int) -> int:
    """Into how many each axis is split for buckets of about ``bucket_rows`` rows (1: not)."""
    width = 1 << max(1, (dims - 1).bit_length())
    wanted = rows / (2 * width * bucket_rows)
    return 1 if wanted < 2 else min(2 * width, 2 * round(wanted / 2))


def nearest_neighbours(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    tables: int = 16,
    probes: int = 7,
    bucket_rows: int = 8,
    seed: int = 3,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, id and score (cosine) of the k nearest rows found for each query.

    Every row of ``index`` but those with the query's own id is a candidate; nearest first,
    ties to the smaller id, fewer than k rows if fewer are found. Null or zero vectors, such with
    null, NaN or infinite components, null ids, and vectors of another length than the most usual one take
    no part. Equal vectors are one entry that keeps the k + 1 smallest ids, which is
    all that can be returned of them; so copies fill no bucket. An id that occurs twice is
    two candidates with one id, of which the nearer is returned; as a query it is answered for its
    first vector. Cells hold about ``bucket_rows`` rows, and a query looks into ``probes`` cells a table on average, times
    the root of the number of cells that an axis is split into. The cells of an axis are one group, cut into parts of
    about ``PART_ROWS`` rows, and every query of a group meets every part, so that no cell is
    capped. Other columns play no part; empty tables give no rows.
    """
    spark = index.sparkSession
    prepare(spark)

    element = index.schema[vector_column].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"  # floats travel as such and are compared as doubles

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_column), lambda x: x.cast(kind))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null")
        return rows.where(F.coalesce(good, F.lit(False)) & F.exists("v", lambda x: x != 0))

    flat = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))  # -0.0 and 0.0 are one number
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    rows = usable(index).select("id", flat.alias("v"))
    # The smallest ids of equal vectors, cut in two steps so that no list holds a large group.
    some = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(ids.alias("ids"))
    entries = materialize(
        some.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")),
        "entries",
    )
    n = entries.count()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    if not n:
        return empty
    dims = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    fine = fine_buckets(n, dims, bucket_rows)
    hashes = Hashes(dims, tables, fine, seed)
    axes = 2 * hashes.width
    looks = min(round(tables * probes * fine**0.5), tables * axes * fine)

    def unit(batch: pd.DataFrame) -> np.ndarray:
        return unit_rows(np.stack(batch["v"].to_numpy()).astype(float)) if len(batch) else np.zeros((0, dims))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(places=list(hashes.places(unit(batch))))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each group of cells that a query looks into."""
        for batch in batches:
            for begin in range(0, len(batch), QUERY_ROWS):
                some = batch.iloc[begin : begin + QUERY_ROWS]
                found = np.sort(hashes.probes(unit(some), looks), axis=1)
                of = np.repeat(np.arange(len(some)), found.shape[1])
                groups, cells = found.ravel() // fine, (found.ravel() % fine).astype(np.int32)
                cuts = np.flatnonzero((of[1:] != of[:-1]) | (groups[1:] != groups[:-1])) + 1
                firsts = np.concatenate([[0], cuts])
                yield pd.DataFrame(
                    {
                        "v": some["v"].to_numpy()[of[firsts]],
                        "id": some["id"].to_numpy()[of[firsts]],
                        "bucket": groups[firsts],
                        "cells": np.split(cells, cuts),
                    }
                )

    of_size = F.size("v") == dims
    placed = (
        entries.where(of_size)
        .mapInPandas(place, f"v array<{kind}>, ids array<bigint>, places array<bigint>")
        .select("v", "ids", F.posexplode("places").alias("table", "place"))
        .select(
            "v",
            "ids",
            (F.col("table") * axes + F.floor(F.col("place") / fine)).alias("bucket"),
            (F.col("place") % fine).cast("int").alias("cell"),
        )
    )
    sizes = placed.groupBy("bucket").count()
    parts = materialize(sizes.select("bucket", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")), "parts")
    asked = usable(queries).select("id", flat.alias("v")).groupBy("v").agg(F.min("id").alias("some"))
    asked = materialize(asked.select("v", F.col("some").alias("id")), "queries")
    probing = (
        asked.where(of_size)
        .mapInPandas(look, f"v array<{kind}>, id bigint, bucket bigint, cells array<int>")
        .join(parts, "bucket")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
    )
    filled = placed.join(parts.withColumnRenamed("parts", "pieces"), "bucket").withColumn(
        "part", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asked": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        left = left.sort_values("cell", kind="stable")
        x = np.stack(left["v"].to_numpy()).astype(float)
        q = np.stack(right["v"].to_numpy()).astype(float)
        ours, theirs, scores = candidates(q, right["cells"].tolist(), x, left["cell"].to_numpy())
        kept = best_of_each(ours, scores, k + 1)
        ours, theirs = ours[kept], theirs[kept]
        return pd.DataFrame(
            {
                "asked": right["id"].to_numpy()[ours],
                "ids": left["ids"].to_numpy()[theirs],
                "score": exact_cosines(q[ours], x[theirs]),
            }
        )

    met = filled.groupBy("bucket", "part").cogroup(probing.groupBy("bucket", "part")).applyInPandas(
        meet, "asked long, ids array<bigint>, score double"
    )
    near = met.withColumn("id", F.explode("ids")).groupBy("asked", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("asked").orderBy(F.desc("score"), "id")
    # k + 1 of each distinct query vector: a query leaves out its own id
    near = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    of_vector = usable(queries).groupBy("id").agg(F.min(flat).alias("v"))
    named = of_vector.join(asked.select("v", F.col("id").alias("asked")), "v").select(F.col("id").alias("query_id"), "asked")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        named.join(near, "asked")
        .where(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )


def candidates(
    q: np.ndarray, cells: list[np.ndarray], x: np.ndarray, cell: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the rows in the cells that each query looks into; ``cell`` rises."""
    of = np.repeat(np.arange(len(q)), [len(c) for c in cells])
    wanted = np.concatenate(cells)
    order = np.argsort(wanted, kind="stable")
    of, wanted = of[order], wanted[order]
    names, firsts = np.unique(wanted, return_index=True)
    lasts = np.append(firsts[1:], len(wanted))
    ours, theirs, scores = [], [], []
    q, x = unit_rows(q), unit_rows(x)
    begins, ends = np.searchsorted(cell, names), np.searchsorted(cell, names, "right")
    for first, last, begin, end in zip(firsts, lasts, begins, ends, strict=True):
        if begin < end:
            some = of[first:last]
            scores.append((q[some] @ x[begin:end].T).ravel())
            ours.append(np.repeat(some, end - begin))
            theirs.append(np.tile(np.arange(begin, end), len(some)))
    none = np.zeros(0, np.int64)
    return (
        np.concatenate(ours) if ours else none,
        np.concatenate(theirs) if theirs else none,
        np.concatenate(scores) if scores else np.zeros(0),
    )


def best_of_each(of: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of each query's ``count`` best scores, and of those that rounding could put among them."""
    order = np.lexsort((-scores, of))
    of, scores = of[order], scores[order]
    firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(firsts, len(of)))
    limit = scores[firsts + np.minimum(sizes, count) - 1] if len(of) else scores
    return order[scores >= np.repeat(limit, sizes) - 1e-9]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit of a cosine, so that no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=1e-300))[1])


def exact_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, each by sums of its own two vectors in one order."""
    q, x = _scaled(q), _scaled(x)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
