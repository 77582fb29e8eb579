"""Greatest common divisor as a grouped aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folded(frame: pd.DataFrame, keys: list[str], name: str) -> pd.DataFrame:
    """One row per group of a frame, in the order in which groups appear."""
    groups = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
    found = frame.iloc[order[starts]].copy()
    found[name] = np.gcd(np.gcd.reduceat(frame[name].to_numpy(dtype="int64")[order], starts), 0)
    return found


def gcd_by(df: DataFrame, keys: list[str], column: str, name: str = "gcd") -> DataFrame:
    """gcd per group of the non-null values, 0 for none, folded for all groups of an Arrow batch at once.

    Batches are folded before the shuffle, so a huge group sends one row per batch; behind it, rows come sorted
    by group, and a group that goes on in the next batch is carried there.
    """
    def before(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield _folded(frame, keys, name)

    def behind(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for frame in frames:
            if len(frame):
                found = _folded(frame if carried is None else pd.concat([carried, frame]), keys, name)
                carried = found.iloc[-1:]
                yield found.iloc[:-1]
        if carried is not None:
            yield carried

    values = df.select(*keys, F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint")).alias(name))
    partial = values.mapInPandas(before, values.schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(behind, values.schema)
