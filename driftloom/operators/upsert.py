"""Replace-by-key and merges of keyed tables, as plain joins over immutable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """`new` in place of every old row with one of its keys; keys of `deleted` go."""
    gone = new.select(*keys) if deleted is None else new.select(*keys).unionByName(deleted.select(*keys))
    return old.join(gone.distinct(), keys, "left_anti").unionByName(new)


def merge_prefer_new(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full-outer merge: a new value that is not blank wins, else the old one stays; keys of either side are kept."""
    a = old.select(*keys, *[F.col(v).alias(f"__o_{v}") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"__n_{v}") for v in values])

    def pick(v: str) -> Column:
        n = F.col(f"__n_{v}")
        return F.when(n.isNotNull() & ~F.coalesce(n.cast("string").rlike(r"^\s*$"), F.lit(False)), n).otherwise(F.col(f"__o_{v}")).alias(v)

    return a.join(b, keys, "full_outer").select(*keys, *[pick(v) for v in values])
