"""Solver labels and status classes of result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD_STATUSES = ["completed", "optimal"]


def solver_label(file: Column, solver_type: Column) -> Column:
    """Text after the first ``--`` of the file stem, else the solver type, else ``unknown``."""
    stem = F.regexp_replace(F.substring_index(F.coalesce(file, F.lit("")), "/", -1),
                            r"(?i)\.json$", "")
    at = F.instr(stem, "--")
    fallback = F.coalesce(F.nullif(solver_type, F.lit("")), F.lit("unknown"))
    return F.when(at > 0, F.substr(stem, at + 2)).otherwise(fallback)


def status_class(status: Column) -> Column:
    return F.when(status.isin(GOOD_STATUSES), F.lit("good")).otherwise(F.lit("bad"))
