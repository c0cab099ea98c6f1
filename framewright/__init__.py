"""Curation of licensed image datasets as Spark DataFrame operators."""

from framewright.operators.dedup import duplicate_ordinals, mark_duplicates, near_dedup, near_pairs
from framewright.operators.gates import quality_gate, semantic_gate
from framewright.plans.curate import curate
from framewright.plans.maintain import export, merge_datasets, refilter
from framewright.plans.search import search_all
from framewright.schema import MANIFEST, RECORD
from framewright.session import build_session, clean_scratch
from framewright.sources.manifest import Manifest

__all__ = [
    "MANIFEST",
    "RECORD",
    "Manifest",
    "build_session",
    "clean_scratch",
    "curate",
    "duplicate_ordinals",
    "export",
    "mark_duplicates",
    "merge_datasets",
    "near_dedup",
    "near_pairs",
    "quality_gate",
    "refilter",
    "search_all",
    "semantic_gate",
]
