"""Image files: listing, decoding and signals."""

from __future__ import annotations

import itertools
import os
import re
import stat
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import pixels
from framewright.functions.decoding import decoded_image
from framewright.functions.signatures import HEAD_BYTES, format_of
from framewright.functions.text import normalize_path
from framewright.session import hadoop_path, materialize
from framewright.sinks.files import file_system, spread_files

#: Files, and bytes of them, that a task of the scan reads.
TASK_FILES, TASK_BYTES = 1024, 1 << 27
#: The same where the files of a task may be one batch in memory.
READ_BYTES = 1 << 25
#: Files that a task of the listing holds at once.
LISTED_ROWS = 10_000


def glob_pattern(pattern: str) -> str:
    """A file name pattern (``*``, ``?``, ``[ab]``, ``{a,b}``, ``\\*``) as a regular expression."""
    parts, depth = [], 0
    for piece in re.findall(r"\\.|\[!?[^]]*\]|.", pattern, re.DOTALL):
        if piece[0] == "\\":
            parts.append(re.escape(piece[-1]))
        elif len(piece) > 1:
            parts.append("[^" + piece[2:] if piece.startswith("[!") else piece)
        elif piece in "{}":
            depth += 1 if piece == "{" else -1
            parts.append("(?:" if piece == "{" else ")")
        elif piece == "," and depth:
            parts.append("|")
        else:
            parts.append({"*": ".*", "?": "."}.get(piece, re.escape(piece)))
    return "".join(parts)


def _hidden(name: str) -> bool:
    return name[:1] in (".", "_")


def _left_out(name: str) -> bool:
    """Names that Spark's readers leave out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name[:1] == "." or (name[:1] == "_" and "=" not in name) or name.endswith("._COPYING_")


def _children(folder: str) -> Iterator[tuple[str, int | None, bool]]:
    """(name, size, whether a folder) of what lies in a folder. A local one is not held as a whole,
    however many files it has; of other stores Arrow gives the list of a folder."""
    from pyarrow import fs

    system, name = file_system(folder)
    if not isinstance(system, fs.LocalFileSystem):
        for found in system.get_file_info(fs.FileSelector(name, allow_not_found=True)):
            yield found.base_name, found.size, found.type == fs.FileType.Directory
        return
    try:
        entries = os.scandir(name)
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            if entry.is_dir():
                yield entry.name, None, True
                continue
            try:
                found = entry.stat()
            except FileNotFoundError:  # a link to nothing
                found = None
            yield entry.name, found.st_size if found and stat.S_ISREG(found.st_mode) else None, False


def _list_folders(pattern: str, hidden: Callable[[str], bool]):
    """Folders to what lies in them, in parts of bounded size."""
    wanted = re.compile(glob_pattern(pattern), re.DOTALL)

    def below(folders: Iterator[str]) -> Iterator[tuple[str, int | None, bool]]:
        for folder in folders:
            for name, size, is_folder in _children(folder):
                if not hidden(name) and (is_folder or wanted.fullmatch(name)):
                    yield f"{folder.rstrip('/')}/{name}", size, is_folder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = below(folder for batch in batches for folder in batch["path"])
        while part := list(itertools.islice(found, LISTED_ROWS)):
            yield pd.DataFrame(part, columns=["path", "length", "folder"]).astype({"length": "Int64"})

    return run


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, empty ones too; no content is read.

    Folders are rows, listed by the cluster level by level, so that neither a deep nor a
    broad tree is walked by the driver. A missing folder has no files, and names that begin
    with a dot or underscore are hidden.
    """
    return _listed(spark, [path], pattern, _hidden)


def _listed(spark: SparkSession, folders: list[str], pattern: str, hidden: Callable[[str], bool]) -> DataFrame:
    rows = [(folder,) for folder in folders]
    level = spark.createDataFrame(rows, "path string").select(normalize_path(F.col("path")).alias("path"))
    levels = []
    while not levels or not level.isEmpty():
        below = spread_files(level, "path").mapInPandas(
            _list_folders(pattern, hidden), "path string, length bigint, folder boolean"
        )
        below = materialize(below, "listing")
        levels.append(below.where(~F.col("folder")).select("path", "length"))
        level = below.where("folder").select("path")
    return reduce(DataFrame.unionByName, levels)


def _read_listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of the files that Spark's readers find at a path, which may be a pattern, and of empty ones."""
    system, target = hadoop_path(spark, path)
    if set(path) & set("{}[]*?\\"):
        found = list(system.globStatus(target) or [])
    else:
        found = [system.getFileStatus(target)] if system.exists(target) else []
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    folders = [status.getPath().toString() for status in found if status.isDirectory()]
    listed = _listed(spark, folders, pattern, _left_out)
    wanted = re.compile(glob_pattern(pattern), re.DOTALL)
    single = [
        (status.getPath().toString(), status.getLen())
        for status in found
        if status.isFile() and wanted.fullmatch(name := status.getPath().getName()) and not _left_out(name)
    ]
    if single:
        files = spark.createDataFrame(single, "path string, length bigint")
        listed = listed.unionByName(files.select(normalize_path(F.col("path")).alias("path"), "length"))
    return listed.dropDuplicates(["path"]) if len(found) > 1 else listed


def file_contents(skip: tuple[type[OSError], ...] = ()):
    """Whole files by path; null for those whose reading fails with an error to skip.

    The files of an Arrow batch are in memory at once: rows are to be dealt to tasks by bytes.
    """

    @F.arrow_udf(T.BinaryType())
    def run(paths: pa.Array) -> pa.Array:
        contents = []
        for path in paths.to_pylist():
            try:
                system, name = file_system(path)
                with system.open_input_file(name) as file:
                    contents.append(file.read())
            except skip:
                contents.append(None)
        return pa.array(contents, pa.binary())

    return run.asNondeterministic()


def _scan_tasks(listed: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks of a scan of these files: as many as files or bytes ask for, and several per core for few files."""
    files, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = listed.sparkSession.sparkContext.defaultParallelism
    return max(-(-files // TASK_FILES), -(-size // task_bytes), 4 * cores)


def read_image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file with its size, first bytes and decoded pixels: path, length, head, height,
    width, nChannels, data. What cannot be decoded has null pixels.

    The files are rows of a listing by the cluster, dealt to tasks that read them once and decode them
    with the decoder of Spark's ``image`` source. That source would list, index and plan all files in
    the driver, whose memory then grows with their number. Spark's settings to ignore missing
    and corrupt files hold.
    """
    listed = _read_listing(spark, path, pattern)
    missing, corrupt = (
        spark.conf.get(f"spark.sql.files.ignore{kind}Files") == "true" for kind in ("Missing", "Corrupt")
    )
    skip = (OSError,) if corrupt else (FileNotFoundError,) if missing else ()
    files = listed.where("length > 0").repartition(_scan_tasks(listed, READ_BYTES), "path")
    contents = files.withColumn("content", file_contents(skip)("path"))
    if skip:
        contents = contents.where("content is not null")
    decoded = contents.select(
        "path",
        "length",
        F.substring("content", 1, HEAD_BYTES).alias("head"),
        decoded_image(spark, F.col("content")).alias("decoded"),
    )
    scanned = decoded.select(
        "path", "length", "head", *[F.col(f"decoded.image.{c}") for c in ("height", "width", "nChannels", "data")]
    )
    empty = listed.where("length = 0")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in scanned.schema.fields[2:]]
    return scanned.unionByName(empty.select("path", "length", *nothing))


def image_signals(images: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Signals per image: size, dimensions, format, sharpness, detail and hash.

    The format is that of the file's first bytes (``head``), null where they are unknown.
    Decoded pixels are large: set ``spark.sql.execution.arrow.maxRecordsPerBatch``
    to a few rows (16) before running this over photographs.
    """
    decoded = [F.col(c) for c in ("height", "width", "nChannels", "data")]
    unknown = [F.lit(None).cast("double"), F.lit(None).cast("string")]
    measured = images.withColumn("__signals", pixels.measure(with_detail=True)(*decoded, *unknown))
    return measured.select(
        *keep,
        F.col("length").alias("file_size_bytes"),
        "width",
        "height",
        format_of(F.col("head")).alias("format"),
        *[F.col(f"__signals.{name}").alias(name) for name in ("blur_score", "gray_variance", "phash")],
    )
