"""Re-validation of stored batches from whatever tables exist."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bitloom.operators.validation import merge_validation, term_issues, term_stats
from bitloom.schemas import Batch


def revalidate(batch: Batch, domain_issues: list[DataFrame] | None = None,
               domain_stats: list[DataFrame] | None = None):
    """Structural checks, plus the family's own where domain tables were kept.

    ``domain_issues``/``domain_stats`` are the family tables built from domain data (empty for a
    batch that was stored without any). Returns (issues, characteristics, status).
    """
    return merge_validation(
        batch.instances, [term_issues(batch), *(domain_issues or [])],
        [term_stats(batch), *(domain_stats or [])])
