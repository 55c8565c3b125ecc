"""Changes between consecutive deliveries of the entity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.blocks import FACETS
from driftloom.operators.snapshot_diff import snapshot_changes
from driftloom.sources.tables import table



def canonical_hash(c: Column) -> Column:
    """Lower case, without an algorithm name before a colon; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^[^:]*:\s*", ""), F.lit(""))


def entity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"contentHash": canonical_hash(F.col("contentHash"))} | {f: canonical_hash(F.col(f"facets.{f}")) for f in FACETS}
    return snapshot_changes(table(spark, sf_dir, "entities"), "repo", "snapshot_no", "id", values)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_changes(spark, sf_dir).select("repo", "snapshot_no", "id", "change").distinct()


def p7_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed entities of each delivery that changed anything."""
    c = F.col("change")
    return (
        entity_changes(spark, sf_dir)
        .groupBy("repo", "snapshot_no")
        .agg(F.count_if(c == "added").alias("n_added"), F.count_if(c == "removed").alias("n_removed"), F.count_if(c == "changed").alias("n_changed"))
    )


def _h(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c})), '^[^:]*:\\s*', ''), '')"


_CHANGES_SQL = f"""
rows AS (
  SELECT repo, snapshot_no, id, max({_h("contentHash")}) AS h0, {", ".join(f"max({_h('facets.' + f)}) AS h{i + 1}" for i, f in enumerate(FACETS))}
  FROM entities GROUP BY repo, snapshot_no, id),
steps AS (
  SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS previous
  FROM (SELECT DISTINCT repo, snapshot_no FROM entities)),
new_rows AS (SELECT r.*, s.previous FROM rows r JOIN steps s USING (repo, snapshot_no) WHERE s.previous IS NOT NULL),
old_rows AS (SELECT s.snapshot_no AS delivery, r.* FROM rows r JOIN steps s ON r.repo = s.repo AND r.snapshot_no = s.previous),
changes AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.delivery) AS snapshot_no, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
      WHEN {" OR ".join(f"coalesce(n.h{i} <> o.h{i}, false)" for i in range(6))} THEN 'changed' END AS change
  FROM new_rows n FULL JOIN old_rows o ON n.repo = o.repo AND n.snapshot_no = o.delivery AND n.id = o.id)
"""

QUERIES = {"p7_found": p7_found, "p7_change_counts": p7_change_counts}
SQL = {
    "p7_found": f"WITH {_CHANGES_SQL} SELECT DISTINCT repo, snapshot_no, id, change FROM changes WHERE change IS NOT NULL",
    "p7_change_counts": f"""WITH {_CHANGES_SQL} SELECT repo, snapshot_no, count(*) FILTER (change = 'added') AS n_added,
  count(*) FILTER (change = 'removed') AS n_removed, count(*) FILTER (change = 'changed') AS n_changed
FROM changes WHERE change IS NOT NULL GROUP BY repo, snapshot_no""",
}
