"""The manifest: a Parquet table of records, kept as whole versions.

A write never touches the version that is being read. Rows are written to a folder
of their own, which a rename makes the next version, so a failed or repeated job leaves no
half table and two writers never take one number. A change that another writer has
overtaken is made again from the newer version. A large table with small changes and one
writer is better kept as a ``PartitionedManifest``, which rewrites only what changes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from framewright.operators.joins import remove_many, removed_count
from framewright.operators.ordering import last_wins
from framewright.schema import MANIFEST, ORDINAL
from framewright.session import hadoop_path, materialize


class Manifest:
    """Upsert by id, look-up by source and (source, source_id)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # Versions

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        fs, root = hadoop_path(self.spark, self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            done = hadoop_path(self.spark, f"{self.path}/{name}/_SUCCESS")[1]
            if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
                found.append(int(name[1:]))
        return sorted(found)

    def write(self, records: DataFrame) -> None:
        """Write a new version. Columns missing from the records become null."""
        columns = [
            (F.col(f.name) if f.name in records.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in MANIFEST.fields
        ]
        staged = self._stage(records.select(*columns))
        while not self._commit(staged, self._latest()):
            pass

    def _latest(self) -> int:
        return (self.versions() or [0])[-1]

    def _stage(self, records: DataFrame) -> str:
        """Write rows to a folder of their own, clustered for look-ups by source and source_id."""
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        clustered = records.repartitionByRange("source", "source_id", "id")
        sorted_rows = clustered.sortWithinPartitions("source", "source_id")
        sorted_rows.write.option("compression", "zstd").parquet(staged)
        return staged

    def _commit(self, staged: str, base: int) -> bool:
        """Make a staged folder the version after ``base``; false if another writer has it.

        The one step that a single writer can win is a rename that fails where the version is there already.
        What a dead writer left under the number, without its rows' ``_SUCCESS``, goes first.
        """
        fs, folder = hadoop_path(self.spark, f"{self.path}/v{base + 1:08d}")
        if fs.exists(folder) and base + 1 not in self.versions():
            fs.delete(folder, True)
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        source = hadoop_path(self.spark, staged)[1]
        try:
            context.rename(source, folder, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if base + 1 in self.versions():
                return False
            raise error
        return True

    def _replace(self, change) -> None:
        """Write ``change(table)`` as the next version, again from the newer table on a conflict."""
        while True:
            base = self._latest()
            staged = self._stage(change(self.read()))
            if self._commit(staged, base):
                return
            fs, folder = hadoop_path(self.spark, staged)
            fs.delete(folder, True)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions."""
        for number in self.versions()[:-keep]:
            fs, old = hadoop_path(self.spark, f"{self.path}/v{number:08d}")
            fs.delete(old, True)

    # Scans

    def read(self) -> DataFrame:
        """The latest version; order by ``ordinal`` where order matters."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/v{versions[-1]:08d}")

    def iterate(self) -> Iterator[Row]:
        """Rows in order, one partition at a time, for a loop on the driver."""
        return self.read().orderBy(ORDINAL).toLocalIterator()

    def count(self) -> int:
        return self.read().count()

    def known_hashes(self) -> DataFrame:
        return known_hashes(self.read())

    def lookup(self, **keys) -> DataFrame:
        return lookup(self.read(), **keys)

    # Changes

    def upsert(self, batch: DataFrame) -> None:
        """Insert or replace by id. Written rows go to the end of the order.

        Whole records are not shuffled by a grouping or a join with the batch: rows are
        grouped only where ids repeat, and only the ids that the table has already leave it, through
        an anti-join, which broadcasts them where they are few.
        """
        newest = materialize(batch, "batch", "zstd")
        ids = newest.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count(ORDINAL).alias("placed"))
        if not ids.where("rows > 1 or placed = 0").isEmpty():
            newest = materialize(last_wins(newest), "batch", "zstd")
        low = newest.agg(F.coalesce(F.min(ORDINAL), F.lit(0))).first()[0]

        def change(table: DataFrame) -> DataFrame:
            top = table.agg(F.coalesce(F.max(ORDINAL) + 1, F.lit(0))).first()[0]
            moved = newest.withColumn(ORDINAL, F.col(ORDINAL) + (top - low)).select(*table.columns)
            replaced = materialize(table.select("id").join(newest.select("id"), "id", "left_semi"), "replaced")
            rest = table if replaced.isEmpty() else remove_many(table, replaced)
            return rest.unionByName(moved)

        self._replace(change)

    def remove_many(self, ids: DataFrame) -> int:
        """Delete by id; returns how many rows went."""
        removed = removed_count(self.read(), ids)
        if removed:
            self._replace(lambda table: remove_many(table, ids))
        return removed


class PartitionedManifest:
    """The manifest in partitions by a hash of the id: a change rewrites the partitions of its ids only.

    Spark's own dynamic partition overwrite replaces them, so there are no versions, and one writer at a time. A
    job that fails before it commits changes nothing; after one that died while committing, the
    same batch is given again, which writes the same rows. The number of partitions is that of the first write.
    """

    def __init__(self, spark: SparkSession, path: str, partitions: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        fs, root = hadoop_path(spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        told = [m for m in (re.fullmatch(r"part_of_(\d+)=\d+", name) for name in names) if m]
        self.partitions = int(told[0][1]) if told else partitions
        self.column = f"part_of_{self.partitions}"
        self.empty = not told

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.column, F.pmod(F.xxhash64("id"), F.lit(self.partitions)).cast("int"))

    def _table(self) -> DataFrame:
        if self.empty:
            return self._placed(self.spark.createDataFrame([], MANIFEST))
        placed = self._placed(self.spark.createDataFrame([], MANIFEST))
        return self.spark.read.schema(placed.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._table().drop(self.column)

    def _rewrite(self, ids: DataFrame, added: DataFrame | None) -> None:
        """Take rows with the given ids out of their partitions, and put rows in."""
        touched = [r[0] for r in self._placed(ids.select("id")).select(self.column).distinct().collect()]
        table = self._table()
        rest = table.where(F.col(self.column).isin(touched)).join(ids.select("id"), "id", "left_anti")
        rows = rest.select(table.columns)
        if added is not None:
            rows = rows.unionByName(self._placed(added).select(table.columns))
        rows = rows.repartition(F.col(self.column)).sortWithinPartitions(self.column, "source", "source_id")
        # What leaves a partition without rows is not overwritten: its folder goes.
        left = materialize(rows, "partitions")
        filled = {r[0] for r in left.select(self.column).distinct().collect()}
        writer = left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(self.column).parquet(self.path)
        for number in set(touched) - filled:
            fs, folder = hadoop_path(self.spark, f"{self.path}/{self.column}={number}")
            fs.delete(folder, True)
        self.empty = self.empty and not filled

    def upsert(self, batch: DataFrame) -> None:
        """Insert or replace by id. Written rows go to the end of the order."""
        newest = materialize(last_wins(batch.select(*MANIFEST.names)), "batch")
        low = newest.agg(F.min(ORDINAL)).first()[0] or 0
        top = self._table().agg(F.coalesce(F.max(ORDINAL) + 1, F.lit(0))).first()[0]
        self._rewrite(newest, newest.withColumn(ORDINAL, F.col(ORDINAL) + (top - low)))

    def remove_many(self, ids: DataFrame) -> int:
        """Delete by id; returns how many rows went."""
        ids = materialize(ids.select("id").distinct(), "ids")
        removed = removed_count(self.read(), ids)
        if removed:
            self._rewrite(ids, None)
        return removed


def known_hashes(records: DataFrame) -> DataFrame:
    return records.where("phash is not null").select("phash")


def lookup(records: DataFrame, **keys) -> DataFrame:
    """Rows by equality on source, id, source_id, ...; reaches the Parquet scan."""
    for name, value in keys.items():
        records = records.where(F.col(name) == value)
    return records
