"""File copies and deletions as distributed jobs, and small driver-side files."""

from __future__ import annotations

import functools
import itertools
import re
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.gates import has_file
from framewright.session import hadoop_path


@functools.lru_cache(maxsize=64)
def _opened(root: str):
    """File system and base path of a scheme and bucket, opened once in each worker."""
    from pyarrow import fs

    # Hadoop's names of the S3 connector are unknown to Arrow.
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", root))


def file_system(location: str):
    """(file system, path) of a location, in a worker."""
    from pyarrow import fs

    location = re.sub("^file:/+", "/", location)
    found = re.match("([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(/.*)?$", location, re.DOTALL)
    if found is None:
        return fs.LocalFileSystem(), location
    system, base = _opened(found[1])
    return system, base.rstrip("/") + (found[2] or "")


def spread_files(plan: DataFrame, key: str) -> DataFrame:
    """Rows of files over the whole cluster.

    The number is explicit: adaptive execution would judge the plan by its bytes,
    which are few, while each row stands for work on a file.
    """
    spark = plan.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return plan.repartition(tasks, key)


def _copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        states = []
        for src, dst in zip(batch["src"], batch["dst"]):
            if src == dst:
                states.append("same")
                continue
            try:
                source, source_path = file_system(src)
                target, target_path = file_system(dst)
                target.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
                # Write beside the target, then rename: a task that dies half-way, or
                # runs twice, leaves no partial image under the final name.
                partial = f"{target_path}.{uuid.uuid4().hex}"
                fs.copy_files(
                    source_path, partial, source_filesystem=source, destination_filesystem=target
                )
                target.move(partial, target_path)
                states.append("copied")
            except OSError as error:
                states.append(f"failed: {error}")
        yield batch[["src", "dst"]].assign(state=states)


def copy_files(plan: DataFrame) -> DataFrame:
    """Copy each (src, dst); returns the counts per state.

    Targets have to be distinct: resolve collisions first. The plan is spread
    over the cluster, since its rows are tiny but their files are not.
    """
    spark = plan.sparkSession
    done = spread_files(plan.select("src", "dst"), "dst").mapInPandas(
        _copy, "src string, dst string, state string"
    )
    state = F.when(F.startswith("state", F.lit("failed")), "failed").otherwise(F.col("state"))
    rows = done.groupBy(state.alias("state")).agg(
        F.count("*").alias("files"), F.first("state").alias("example")
    ).collect()
    for row in rows:
        if row["state"] == "failed":
            raise OSError(f"{row['files']} files were not copied, e.g. {row['example']}")
    return spark.createDataFrame(
        [(r["state"], r["files"]) for r in rows], "state string, files bigint"
    )


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        gone = []
        for path in batch["path"]:
            system, name = file_system(path)
            try:
                system.delete_file(name)
                gone.append(True)
            except FileNotFoundError:
                gone.append(False)
        yield batch[["path"]].assign(gone=gone)


def delete_files(paths: DataFrame) -> int:
    """Delete the files of a ``path`` column; returns how many were there."""
    done = spread_files(paths.select("path"), "path").mapInPandas(_remove, "path string, gone boolean")
    return done.where("gone").count()


def _touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            system, name = file_system(path)
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(name):
                pass
        yield batch[["path"]]


def touch_files(paths: DataFrame) -> int:
    """Create an empty file per ``path``; returns how many."""
    return spread_files(paths.select("path"), "path").mapInPandas(_touch, "path string").count()


def _stat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lengths = []
        for path in batch["path"]:
            system, name = file_system(path)
            info = system.get_file_info(name)
            lengths.append(info.size if info.is_file else None)
        yield batch[["path"]].assign(length=pd.array(lengths, dtype="Int64"))


def stat_files(paths: DataFrame) -> DataFrame:
    """(path, length) of the files that exist among the given paths.

    Unlike a folder listing, which Spark limits to files with content, this also
    sees empty files.
    """
    return spread_files(paths.select("path"), "path").mapInPandas(_stat, "path string, length bigint").where(
        "length is not null"
    )


def make_dirs(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, target = hadoop_path(spark, path)
        fs.mkdirs(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver."""
    fs, target = hadoop_path(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def _place_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy each part to its place in a file that is there already. A repeated task writes the same bytes."""
    for batch in batches:
        for part, target, offset in zip(batch["part"], batch["target"], batch["offset"]):
            with open(file_system(part)[1], "rb") as source, open(file_system(target)[1], "r+b") as out:
                out.seek(offset)
                shutil.copyfileobj(source, out, 1 << 20)
        yield batch[["part"]]


def _join_parts(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    """Parts (path, length), in order, as one file ``target``.

    The bytes do not pass the driver: a file system that can join files does so by its metadata
    (HDFS), and on a local one, which all workers share, each part is written to its place by a
    task. Object stores can do neither; there the parts stream through the driver's client.
    """
    fs, path = hadoop_path(spark, target)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    Path = jvm.org.apache.hadoop.fs.Path
    scheme = fs.getUri().getScheme()
    if scheme == "file":
        offsets = [0, *itertools.accumulate(length for _, length in parts)]
        # Not through the checksummed file system, which would remember the empty file's checksum.
        fs.getRaw().create(path, True).close()
        rows = [(part, target, offset) for (part, _), offset in zip(parts, offsets, strict=False)]
        plan = spark.createDataFrame(rows, "part string, target string, offset bigint")
        placed = spread_files(plan, "part").mapInPandas(_place_parts, "part string")
        if placed.count() != len(parts):
            raise OSError(f"not all parts of {target} were written")
        return
    if scheme in ("hdfs", "viewfs", "webhdfs"):
        fs.rename(Path(parts[0][0]), path)
        rest = [part for part, length in parts[1:] if length]
        if rest:
            array = gateway.new_array(Path, len(rest))
            for i, part in enumerate(rest):
                array[i] = Path(part)
            fs.concat(path, array)
        return
    stream = fs.create(path, True)
    for part, _ in parts:
        source = fs.open(Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
        source.close()
    stream.close()


def to_single_file(df: DataFrame, path: str, write, order: str, head: str = "", tail: str = "") -> None:
    """Rows in order as one file of any length: ``head``, the rows, ``tail``.

    The rows are sorted and written as part files by the cluster, whose names
    follow the order; head and tail are small files before and behind them. The driver only
    lists names and lengths (see ``_join_parts``); the file gets its name when it is complete.
    """
    spark = df.sparkSession
    folder, partial = f"{path}.parts-{uuid.uuid4().hex}", f"{path}.partial-{uuid.uuid4().hex}"
    write(df.orderBy(order), folder)
    fs, source = hadoop_path(spark, folder)
    found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(source))
    parts = [(f"{folder}/{name}", length) for name, length in found if name.startswith("part-")]
    for name, text in (("head", head), ("tail", tail)):
        write_text(spark, f"{folder}/_{name}", text)
    head_part, tail_part = (f"{folder}/_head", len(head.encode())), (f"{folder}/_tail", len(tail.encode()))
    _join_parts(spark, [head_part, *parts, tail_part], partial)
    target = hadoop_path(spark, path)[1]
    fs.delete(target, True)
    fs.rename(hadoop_path(spark, partial)[1], target)
    fs.delete(source, True)


def with_image_file(records: DataFrame, files: DataFrame | None) -> DataFrame:
    """Records whose image exists; without a listing, those with a path."""
    if files is None:
        return records.where("local_path is not null and local_path <> ''")
    return has_file(records, files)
