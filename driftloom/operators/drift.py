"""Block fingerprints and the detectors that compare them.

A block's fingerprint is a hash per facet it depends on, over the entities its section owns.  Stored and current
fingerprints are compared facet by facet where both exist; a block without a stored fingerprint is not stale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.blocks import BLOCK_FACETS, FACETS


def facet_hashes(owned: DataFrame, keys: list[str]) -> DataFrame:
    """Per `keys`, a hash of each facet over the owned entities in the order of their ids.

    `owned` has the keys, id, and one column per facet; a null facet hashes as the empty string.  The owned entities of
    one key are gathered, so keys must be sections or files, whose entities are few.
    """
    rows = F.array_sort(F.collect_set(F.struct("id", *FACETS)))

    def one(facet: str) -> Column:
        lines = F.transform(F.col("rows"), lambda r: F.concat_ws("|", r["id"], F.coalesce(r[facet], F.lit(""))))
        return F.sha2(F.array_join(lines, "\n"), 256).alias(facet)

    return owned.groupBy(*keys).agg(rows.alias("rows")).select(*keys, *[one(f) for f in FACETS])


def block_fingerprint(block: Column) -> Column:
    """The fingerprint string of a block from the facet hash columns of its section."""
    parts = {b: F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f)) for f in fs]) for b, fs in BLOCK_FACETS.items()}
    return reduce(lambda c, b: c.when(block == b, parts[b]), parts, F.when(F.lit(False), F.lit(None)))


def changed_facets(stored: Column, current: Column) -> Column:
    """Facets that both fingerprint strings have and that differ, in the fixed order; null where one string is null."""
    a, b = F.str_to_map(stored, F.lit(","), F.lit("=")), F.str_to_map(current, F.lit(","), F.lit("="))
    differ = F.filter(F.array(*[F.lit(f) for f in FACETS]), lambda f: F.coalesce(a[f] != b[f], F.lit(False)))
    return F.when(stored.isNotNull() & current.isNotNull(), differ)


def merge_passes(*passes: DataFrame) -> DataFrame:
    """One row per (repo, section, block): the facets of all passes in the order of passes, and the first drift kind.

    Each pass has repo, section, block, drift and facets (an array).
    """
    all_ = reduce(lambda x, y: x.unionByName(y), [p.withColumn("pass_no", F.lit(i)) for i, p in enumerate(passes)])
    rows = F.array_sort(F.collect_list(F.struct("pass_no", "drift", "facets")))
    return (
        all_.groupBy("repo", "section", "block").agg(rows.alias("rows"))
        .select("repo", "section", "block", F.col("rows")[0]["drift"].alias("drift"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["facets"]))).alias("facets"))
    )
