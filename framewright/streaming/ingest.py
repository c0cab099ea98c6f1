"""Pick up newly landed provider pages and add the records not seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.operators.joins import resume_join
from framewright.operators.ordering import first_wins, with_ordinal
from framewright.schema import ORDINAL
from framewright.session import materialize
from framewright.sources.manifest import Manifest
from framewright.sources.providers import checked_pages, landed_lines, read_records, rejected


def unseen(records: DataFrame, manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Records whose (source, source_id) is not in the manifest, each once.

    With a listing of files (``path``), a record counts as seen only while the file of its row
    is there: one whose file was lost is picked up again.
    """
    once = first_wins(records, ["source", "source_id"])
    if files is None:
        return once.join(manifest.select("source", "source_id"), ["source", "source_id"], "left_anti")
    # Whole rows of the manifest are not asked for.
    return resume_join(once, manifest.select("source", "source_id", "local_path", ORDINAL), files)[1]


def with_place(records: DataFrame, places: DataFrame) -> DataFrame:
    """The records that ``places`` (place, rank_in_page, source, source_id, id, ordinal) names, with its id and ordinal."""
    keys = ("rank_in_page", "source", "source_id")
    line = lambda place: F.col(f"{place}.line")
    named = places.select(
        F.col("place").alias("__place"), F.col("id").alias("__id"), ORDINAL, *[F.col(k).alias(f"__{k}") for k in keys]
    )
    same = line("place") == line("__place")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return records.join(named, same).select(
        *[F.col("__id").alias(c) if c == "id" else F.col(c) for c in records.columns if c != ORDINAL], ORDINAL
    )


def incremental_ingest(
    spark: SparkSession,
    landing: str,
    manifest: Manifest,
    source: str,
    checkpoint: str,
    query: str = "",
    dataset_name: str = "",
    max_files: int = 10_000,
    files: Callable[[], DataFrame] | None = None,
    rejects: str | None = None,
    **options,
) -> StreamingQuery:
    """Process what has landed since the last run, then stop.

    Records enter the manifest in the order in which they landed: file name, block, line, place in
    the page. ``files`` gives the listing of landed images, taken anew for each batch, so that
    records whose file is gone come again. Pages that are not sound are added to the Parquet folder
    ``rejects``; their whole hits are kept either way. The file source remembers the pages it
    has read. A batch that runs again after a failure adds nothing twice: ids derive from the
    record's identity and known pairs are left out.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(landing)
    lines = lines.select("value", "_metadata")

    def add(batch: DataFrame, epoch: int) -> None:
        # What is lazy here is read several times: the lines are written once, with their places.
        pages = checked_pages(materialize(landed_lines(batch), "lines", "zstd"), source)
        if rejects is not None:
            rejected(pages).write.mode("overwrite").parquet(f"{rejects}/batch={epoch}")
        named = pages.drop("page", "fault", "rescued_hits").withColumns(
            {"query": F.lit(query), "dataset_name": F.lit(dataset_name)}
        )
        records = read_records(named, source, **options)
        # Which records are new, and their order, is told by keys; the whole records then move once.
        keys = records.select("place", "rank_in_page", "source", "source_id", "id")
        ordered = with_ordinal(keys, "place", "rank_in_page", "source_id", "id", name=ORDINAL)
        listing = None if files is None else files()
        fresh = materialize(unseen(ordered, manifest.read(), listing), "fresh")
        manifest.upsert(with_place(records, fresh))

    return (
        lines.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
