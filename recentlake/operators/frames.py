"""Small DataFrame helpers shared by report assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side, without a join.

    Each input is a one-row aggregate (a report section).  The frames are
    unioned by name (missing columns as nulls, so a handful of rows in all)
    and folded by one global aggregate keeping each column's non-null value.
    A column present in several frames must carry the same value in each.
    """
    cols: list[str] = []
    for f in frames:
        for c in f.columns:
            if c not in cols:
                cols.append(c)
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
