"""Importing this module registers every query."""

from quillcheck.plans import (  # noqa: F401
    catalog_queries,
    clause_queries,
    dataset_queries,
    equivalence_queries,
    linking_queries,
    metric_queries,
    ranking_queries,
    relational,
    text_queries,
    value_queries,
)
