"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "framewright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume.

    Shuffle parallelism is left to adaptive execution: give
    ``spark.sql.shuffle.partitions`` a generous value on a cluster and let it
    coalesce. Skewed sort-merge joins are split at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_packages(spark: SparkSession, *folders: str) -> None:
    """Send Python packages to the workers, once per Spark application."""
    context = spark.sparkContext
    for folder in (os.path.dirname(os.path.abspath(__file__)), *folders):
        folder = os.path.abspath(folder)
        name = f"{os.path.basename(folder)}.zip"
        if name in context._python_includes:
            continue
        archive = os.path.join(tempfile.mkdtemp(prefix="framewright-"), name)
        with zipfile.ZipFile(archive, "w") as out:
            for root, _, files in os.walk(folder):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(root, file)
                        out.write(path, os.path.relpath(path, os.path.dirname(folder)))
        context.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    Where nothing is set, a local run gets a temporary folder. On a cluster that would be
    another folder on each machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_RUN = uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place below this application's part of the shared folder."""
    return f"{shared_dir(spark)}/framewright/{_RUN}/{uuid.uuid4().hex}/{name}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.

    Call it once results are stored: lazy results still read from them.
    """
    fs, root = hadoop_path(spark, f"{shared_dir(spark)}/framewright/{_RUN}")
    fs.delete(root, True)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    The files survive lost executors, and their size gives the optimizer real
    statistics for the joins that follow. Whole texts take half the space with ``zstd``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy work at least as many partitions as there are cores, with rows in all of them.

    A scan of a few large row groups yields a few tasks only, or many of which few have rows, since a
    row group is read by one task. Where the rows of the scan already are dealt to enough tasks, nothing is shuffled.
    ``df`` should be a plain scan: asking for its partitions plans it, and its rows are counted without their columns.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= cores:
        dealt = df.groupBy(F.spark_partition_id().alias("part")).count()
        largest, rows = dealt.agg(F.max("count"), F.sum("count")).first()
        if not rows or largest * cores <= 2 * rows:
            return df
    return df.repartition(max(cores, parts), key)


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a location, through the file systems Spark uses."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
