"""Corpus acquisition as Spark table work.

Index pages, dataset requests, stored objects and the ledger of earlier runs are
DataFrames; every public function takes DataFrames and returns DataFrames.
"""

from corpusplan.operators.families import (
    DirectoryFamily,
    Families,
    FixedFamily,
    PageFamily,
    TableFamily,
    standard_families,
)
from corpusplan.plans.acquire import Run, acquire, plan_from_pages
from corpusplan.session import Store, configure, shared_dir

__all__ = [
    "DirectoryFamily",
    "Families",
    "FixedFamily",
    "PageFamily",
    "Run",
    "Store",
    "TableFamily",
    "acquire",
    "configure",
    "plan_from_pages",
    "shared_dir",
    "standard_families",
]
