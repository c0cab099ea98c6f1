"""Search over landed pages and the label index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.aggregates import stamp
from framewright.operators.ordering import source_quota
from framewright.operators.sets import union_sources


def explode_queries(df: DataFrame, column: str = "query", lower: bool = False) -> DataFrame:
    """One row per item of a comma-separated list; blanks around it are cut off."""
    from framewright.functions.text import strip

    items = F.transform(F.split(column, ","), strip)
    exploded = df.withColumn(column, F.explode(items))
    return exploded.withColumn(column, F.lower(column)) if lower else exploded


def search_all(
    hits: Mapping[str, DataFrame],
    count: int,
    dataset_name: str = "dataset",
    rank: str = "rank",
    queries: Sequence[str] = (),
) -> DataFrame:
    """Records of all sources for every query: ``count`` per query, split evenly.

    ``hits`` maps source names, in order, to records with ``rank`` (place within
    source and query). A source with too few hits gives no share to the others.
    The result is in the order of the queries (as listed, then by text), within
    a query of the sources, within a source of the ranks.
    """
    if not hits:
        raise ValueError("No sources configured.")
    limited = [
        source_quota(df, list(hits), count, rank).where(F.col("source") == name)
        for name, df in hits.items()
    ]
    before: tuple = ("query",)
    if queries:
        places = F.create_map(*[F.lit(v) for pair in enumerate(queries) for v in reversed(pair)])
        listed = F.coalesce(F.try_element_at(places, F.col("query")), F.lit(len(queries)))
        before = (listed, "query")
    return stamp(union_sources(*limited, rank=rank, before=before), dataset_name)
