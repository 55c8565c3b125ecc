"""Ordered folds over small groups: budgets, skips and greedy cuts.

A group is what one run works on; it is gathered and folded on the JVM side, so groups must be bounded (runs, files),
never whole owners.  Order is given by a column; equal order values are taken by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_cap(df: DataFrame, keys: list[str], order: str, size: str, cap: int) -> DataFrame:
    """The rows up to the first that would make the running sum exceed `cap` (sizes are not negative)."""
    w = Window.partitionBy(*keys).orderBy(order, size).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= cap)


def _gather(df: DataFrame, keys: list[str], order: str, size: str, item: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(size).cast("bigint").alias("s"), F.col(item).alias("i"))))
    return df.groupBy(*keys).agg(rows.alias("rows"))


def skip_cap(df: DataFrame, keys: list[str], order: str, size: str, item: str, cap: int) -> DataFrame:
    """The rows taken in order where each that does not fit the rest of `cap` is skipped and the scan goes on."""
    kind = dict(df.dtypes)[item]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["s"] <= cap
        return F.struct(F.when(fits, acc["used"] + x["s"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["i"]))).otherwise(acc["taken"]).alias("taken"))

    return _gather(df, keys, order, size, item).select(*keys, F.aggregate("rows", start, step).alias("a")).select(*keys, F.explode("a.taken").alias(item))


def greedy_bins(df: DataFrame, keys: list[str], order: str, size: str, item: str, cap: int) -> DataFrame:
    """(keys, item, bin): consecutive items fill a bin until the next does not fit; a larger item has its own bin."""
    kind = dict(df.dtypes)[item]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).cast("bigint").alias("bin"), F.array().cast(f"array<struct<i:{kind},b:bigint>>").alias("out"))

    def step(acc, x):
        opens = (acc["bin"] < 0) | (acc["used"] + x["s"] > cap)
        b = F.when(opens, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(F.when(opens, x["s"]).otherwise(acc["used"] + x["s"]).alias("used"), b.alias("bin"), F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), b.alias("b")))).alias("out"))

    return _gather(df, keys, order, size, item).select(*keys, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("r")).select(*keys, F.col("r.i").alias(item), F.col("r.b").alias("bin"))
