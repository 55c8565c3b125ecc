"""References to records that do not exist.

References carry a composite key of which some columns may be null.  They are grouped by their null mask; each
mask is anti-joined to the referenced keys on the columns that are not null, under a declared match rule:

``simple``   a reference with any null column is no reference (never an orphan);
``partial``  the non-null columns must occur together in some referenced key; all null is no reference;
``full``     either no column is null and the key exists, or all are null; mixed references are orphans.

Defined results: an empty reference table gives no row; an empty key table makes every checked reference an orphan;
repeated references are kept as often as they come; null keys on the referenced side match nothing under ``simple``
and ``full``.  Column names beside the key columns are free, names that clash with the internal ones (prefix
``__``) are not accepted.

Scale: a mask costs one shuffle of the references on their key and none of the key table beyond its distinct keys.
A hot key (one parent referenced by a third of all rows) is no problem for an anti-join against *distinct* keys when
Spark splits it, and ``salt`` does so without relying on it: references are spread over ``salt`` slots and the
distinct keys are repeated once per slot.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_RULES = ("simple", "partial", "full")


def _mask(keys: list[str]) -> Column:
    return F.concat(*[F.when(F.col(k).isNull(), F.lit("0")).otherwise(F.lit("1")) for k in keys])


def orphan_references(refs: DataFrame, keys: DataFrame, on: list[str], match: str = "simple", salt: int = 1) -> DataFrame:
    """The rows of `refs` whose key `on` refers to no row of `keys`, with their null mask as ``null_mask``.

    ``null_mask`` has a 1 for each column of `on` that has a value, a 0 for each null.
    """
    if match not in MATCH_RULES:
        raise ValueError(f"match must be one of {MATCH_RULES}")
    if any(c.startswith("__") for c in refs.columns) or "null_mask" in refs.columns:
        raise ValueError("columns starting with __ and null_mask are reserved")
    refs = refs.withColumn("null_mask", _mask(on))
    whole = "1" * len(on)
    parts: list[DataFrame] = []
    if match == "full":
        parts.append(refs.filter((F.col("null_mask") != whole) & (F.col("null_mask") != "0" * len(on))))
    # Which masks a partial match needs is a property of the schema: columns that cannot be null are never masked.
    nullable = {f.name: f.nullable for f in refs.schema.fields}
    choices = [("1", "0") if match == "partial" and nullable[k] else ("1",) for k in on]
    for bits in map("".join, product(*choices)):
        cols = [k for k, bit in zip(on, bits) if bit == "1"]
        if not cols:
            continue
        group = refs if bits == whole and len(choices) == 1 else refs.filter(F.col("null_mask") == bits)
        there = keys.select(*[F.col(k).alias(f"__{k}") for k in cols]).dropna().distinct()
        if salt > 1:
            group = group.withColumn("__slot", F.pmod(F.xxhash64(*[c for c in refs.columns if _hashable(refs, c)]), F.lit(salt)))
            there = there.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
        cond = [F.col(k) == F.col(f"__{k}") for k in cols] + ([F.col("__slot") == F.col("__at")] if salt > 1 else [])
        parts.append(group.join(there, cond, "left_anti").drop("__slot"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hashable(df: DataFrame, c: str) -> bool:
    return not dict(df.dtypes)[c].startswith(("map", "variant"))


def orphan_report(orphans: DataFrame, refs: DataFrame, by: list[str]) -> DataFrame:
    """References and orphans per group of `by`, with the orphaned share; groups without references have no row."""
    total = refs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    gone = orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    return (
        total.join(gone, by, "left")
        .withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0).cast("bigint")))
        .withColumn("orphan_share", F.round(F.col("n_orphans") / F.col("n_refs"), 6))
    )
