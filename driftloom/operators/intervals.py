"""Interval joins that keep an equality on the path, so that they hash on it and filter the rest.

Lines are inclusive at both ends, offsets half-open.  For paths with very many intervals, `bucket` splits the equality
further by position: an interval is repeated once per bucket it touches, and a pair is reported from its first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bucket: int = 2000) -> DataFrame:
    """Pairs whose inclusive ranges overlap; the range columns of the two sides must have different names."""
    l_ = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col(a[0]) / bucket), F.floor(F.greatest(F.col(a[0]), F.col(a[1])) / bucket))))
    r_ = right.withColumn("__c", F.explode(F.sequence(F.floor(F.col(b[0]) / bucket), F.floor(F.greatest(F.col(b[0]), F.col(b[1])) / bucket))))
    both = l_.join(r_.withColumnRenamed("__c", "__b"), [*keys, "__b"]).filter((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bucket)
    return both.filter(F.col("__b") == first).drop("__b")


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, order: list[str], bucket: int = 4000) -> DataFrame:
    """For each point the smallest span [start, end) that holds it, ties by `order`; points in no span are left out."""
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(F.col(start), F.col(end) - 1) / bucket))))
    p = points.withColumn("__b", F.floor(F.col(point) / bucket))
    hit = p.join(s, [*keys, "__b"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("__b")
    span_cols = [c for c in spans.columns if c not in keys]
    best = F.min_by(F.struct(*span_cols), F.struct(F.col(end) - F.col(start), *order))
    return hit.groupBy(*points.columns).agg(best.alias("s")).select(*points.columns, "s.*")
