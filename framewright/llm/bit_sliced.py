"""Exact top-k search by a bit-sliced index.

A block of rows holds each attribute as bitmaps, one per binary digit: bit i of
a slice belongs to row i. A query's integer inner product with all rows of the block is
a sum of slices, added with bitmap arithmetic (carry-save adders over 64 rows at
a word); the sum is again a set of slices. The top rows are read off from the
most significant slice downward, and ties at the boundary are resolved exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import prepare
from framewright.session import materialize

#: Rows of one block of the index, and most queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null if any component can't take part."""
    good = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)
    )
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(good, whole)


class Slices:
    """Bitmaps of a block of non-negative integers: ``bits[d, b]`` is digit b of attribute d."""

    def __init__(self, values: np.ndarray):
        self.rows, self.low = len(values), values.min(axis=0)
        shifted = (values - self.low).astype(np.uint64)
        self.depth = max(1, int(shifted.max()).bit_length()) if shifted.size else 1
        padded = np.zeros((-(-self.rows // 64) * 64, values.shape[1]), np.uint64)
        padded[: self.rows] = shifted
        self.bits = np.stack([pack((padded >> np.uint64(b)) & np.uint64(1)) for b in range(self.depth)], axis=1)
        self.inverse = ~self.bits

    def stored(self) -> dict[str, bytes | int]:
        """The index of the block as columns of a table."""
        return {"size": self.rows, "depth": self.depth, "low": self.low.tobytes(), "bits": self.bits.tobytes()}

    @classmethod
    def loaded(cls, size: int, depth: int, low: bytes, bits: bytes) -> Slices:
        block = cls.__new__(cls)
        block.rows, block.depth, block.low = size, depth, np.frombuffer(low, np.int64)
        block.bits = np.frombuffer(bits, np.uint64).reshape(len(block.low), depth, -1)
        block.inverse = ~block.bits
        return block

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner product, least digit first, and the constant to add.

        A factor is a sum of signed powers of two, as few as can be; for each, the
        attribute's slices go to the columns of their significance. A negative power takes
        the complement slices: -x = (m - x) - m, with m the largest number of the depth.
        """
        most = (1 << self.depth) - 1
        constant = int(query @ self.low)
        plus: list[list[np.ndarray]] = []
        for d in np.flatnonzero(query):
            for sign, shift in signed_powers(int(query[d])):
                while len(plus) < shift + self.depth:
                    plus.append([])
                slices = self.bits[d] if sign > 0 else self.inverse[d]
                if sign < 0:
                    constant -= most << shift
                for b in range(self.depth):
                    plus[shift + b].append(slices[b])
        return reduce_columns(plus, self.bits.shape[2]), constant


def signed_powers(factor: int) -> list[tuple[int, int]]:
    """(sign, exponent) of the shortest sum of signed powers of two."""
    out, shift = [], 0
    while factor:
        if factor & 1:
            sign = 2 - (factor & 3)
            out.append((sign, shift))
            factor -= sign
        factor >>= 1
        shift += 1
    return out


def pack(flags: np.ndarray) -> np.ndarray:
    """Columns of 0 and 1 as rows of 64-bit words, the first row in the lowest bit."""
    return np.ascontiguousarray(np.packbits(flags.astype(np.uint8).T, axis=1, bitorder="little")).view("<u8")


def reduce_columns(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Add bitmaps of equal significance with full adders, carries going one column up.

    Three bitmaps become a sum and a carry; many such triples are added at once.
    """
    out, at = [], 0
    columns = [list(c) for c in columns]
    while at < len(columns):
        column = np.stack(columns[at]) if columns[at] else np.zeros((1, words), np.uint64)
        carries = []
        while len(column) > 1:
            triples = len(column) // 3
            if triples:
                a, b, c = column[:triples], column[triples : 2 * triples], column[2 * triples : 3 * triples]
                half = a ^ b
                carries.append((a & b) | (half & c))
                column = np.concatenate([half ^ c, column[3 * triples :]])
            else:
                carries.append((column[:1] & column[1:2]))
                column = column[:1] ^ column[1:2]
        out.append(column[0])
        if carries:
            if at + 1 == len(columns):
                columns.append([])
            columns[at + 1].extend(np.concatenate(carries))
        at += 1
    return out


def top_rows(slices: list[np.ndarray], rows: int, k: int) -> np.ndarray:
    """Rows that are among the k largest, with all rows that tie at the boundary.

    Downward from the most significant slice: rows with the digit set are sure while
    they are fewer than wanted; otherwise only they go on.
    """
    full = np.zeros(slices[0].shape[0] * 64, np.uint8)
    full[:rows] = 1
    sure = np.zeros_like(slices[0])
    maybe = np.packbits(full, bitorder="little").view("<u8")
    for digit in reversed(slices):
        ahead = sure | (maybe & digit)
        if int(np.bitwise_count(ahead).sum()) > k:
            maybe = maybe & digit
        else:
            sure, maybe = ahead, maybe & ~digit
    return np.flatnonzero(np.unpackbits((sure | maybe).view(np.uint8), bitorder="little")[:rows])


def values_of(slices: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The integers that slices hold for some rows."""
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    total = np.zeros(len(rows), np.int64)
    for b, digit in enumerate(slices):
        total += ((digit[word] >> bit) & np.uint64(1)).astype(np.int64) << b
    return total


def block_top(index: Slices, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's k best ids for a query and their scores, the query's own rows left out."""
    slices, constant = index.scores(query)
    if not slices:
        slices = [np.zeros(index.bits.shape[2], np.uint64)]
    spare = int((ids == own).sum())
    found = top_rows(slices, index.rows, k + spare)
    found = found[ids[found] != own]
    scores = values_of(slices, found) + constant
    best = np.lexsort((ids[found], -scores))[:k]
    return ids[found][best], scores[best]


def top_k_products(
    index: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, id and score of each query's k largest integer inner products.

    Vectors become floor(scale * x). Every row of ``index`` but those with the query's id is a candidate, ties
    go to the smaller id. Null vectors and such with null, NaN or infinite components, null
    ids and vectors of another length than the most usual one take no part; an id that occurs twice is two
    candidates, and as a query it is answered once for each distinct vector. Empty tables give
    no rows. The bitmaps of a block of rows are built once; each block of queries meets each of them once, and only k
    rows of each meeting are shuffled. Components beyond 2^57 in size have no defined score. Other columns play no part.
    """
    spark = index.sparkSession
    prepare(spark)

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column), scale).alias("v"))
        return rows.where("id is not null and v is not null and size(v) > 0")

    rows = materialize(usable(index), "quantised")
    asked = materialize(usable(queries).distinct(), "queries")
    n, m = rows.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score long")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    row_blocks, cores = -(-n // BLOCK_ROWS), spark.sparkContext.defaultParallelism
    # Few blocks of rows leave cores idle: then the queries are cut further.
    query_blocks = max(-(-m // BLOCK_QUERIES), min(-(-2 * cores // row_blocks), -(-m // 64)))
    of = lambda blocks: F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        slices = Slices(np.stack(rows["v"].to_numpy()).astype(np.int64))
        return pd.DataFrame([{"rb": rows["rb"].iloc[0], "ids": rows["id"].to_numpy(np.int64).tobytes()} | slices.stored()])

    # Each block's bitmaps are built once and stored; a component takes as many bits as its digits.
    blocked = rows.where(F.size("v") == dims).select("id", "v", of(row_blocks).alias("rb"))
    columns = "rb int, ids binary, size long, depth int, low binary, bits binary"
    blocks = materialize(blocked.groupBy("rb").applyInPandas(build, columns), "slices").withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asked = asked.where(F.size("v") == dims).select(
        "id", "v", of(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb")
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            block = left.iloc[0]
            slices = Slices.loaded(block["size"], block["depth"], block["low"], block["bits"])
            ids = np.frombuffer(block["ids"], np.int64)
            for own, query in zip(right["id"], right["v"], strict=True):
                best, scores = block_top(slices, ids, np.asarray(query, np.int64), own, k)
                found.append((own, hash(tuple(query)), best, scores))
        sizes = [len(best) for *_, best, _ in found]
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array([f[0] for f in found], np.int64), sizes),
                "query": np.repeat(np.array([f[1] for f in found], np.int64), sizes),
                "id": np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64),
                "score": np.concatenate([f[3] for f in found]) if found else np.zeros(0, np.int64),
            }
        )

    parts = blocks.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(
        meet, "query_id long, query long, id long, score long"
    )
    best = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return (
        parts.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )
