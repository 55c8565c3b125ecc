"""The references of the project's tables in one long form, and what they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.ids import canonical_id, canonical_path, strip_blank
from driftloom.operators.orphans import orphan_references, orphan_report
from driftloom.sources.tables import table

KEY = ["repo", "snapshot_no", "target_id"]


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reference: table, repo, snapshot, record, field, the reference as reported and the id it names.

    Null and blank references are left out; a reference that its record lists twice comes once per listing.
    """
    e = table(spark, sf_dir, "entities").select("repo", "snapshot_no", F.col("id").alias("record_id"), "directDeps", "directUsages")
    # one explode over the tagged concatenation reads the table once for both arrays
    def tag(field: str):
        return F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda x: F.struct(F.lit(field).alias("field_name"), x.alias("raw")))

    tagged = F.concat(tag("directDeps"), tag("directUsages"))
    from_entities = (
        e.select("repo", "snapshot_no", "record_id", F.explode(tagged).alias("r"))
        .select(F.lit("entities").alias("table_name"), "repo", "snapshot_no", "record_id", "r.field_name", canonical_id(F.col("r.raw")).alias("ref"))
        .filter("ref <> ''")
        .withColumn("target_id", F.col("ref"))
    )
    w = table(spark, sf_dir, "write_sections")
    from_sections = (
        w.select("repo", "snapshot_no", F.col("section_row_id").cast("string").alias("record_id"), F.explode("dependencyEntityIds").alias("raw"))
        .select(
            F.lit("write_sections").alias("table_name"), "repo", "snapshot_no", "record_id",
            F.lit("dependencyEntityIds").alias("field_name"), canonical_id(F.col("raw")).alias("ref"),
        )
        .filter("ref <> ''")
        .withColumn("target_id", F.col("ref"))
    )
    d = table(spark, sf_dir, "domain_map")
    from_domains = (
        d.select(
            F.lit("domain_map").alias("table_name"), "repo", "snapshot_no", F.col("slug").alias("record_id"),
            F.lit("file").alias("field_name"), canonical_path(strip_blank(F.col("file"))).alias("ref"),
        )
        .filter("ref <> ''")
        .withColumn("target_id", F.concat(F.lit("file:"), "ref"))
    )
    return from_entities.unionByName(from_sections).unionByName(from_domains)


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("repo", "snapshot_no", canonical_id(F.col("id")).alias("target_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = orphan_references(reference_rows(spark, sf_dir), entity_keys(spark, sf_dir), KEY, "simple")
    return gone.select("table_name", "repo", "snapshot_no", "record_id", "field_name", "ref").distinct()


def p2_orphan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and dead references per table, field and snapshot number (distinct references of a record)."""
    cols = ["table_name", "repo", "snapshot_no", "record_id", "field_name", "ref"]
    refs = reference_rows(spark, sf_dir).select(*cols, "target_id").distinct()
    gone = orphan_references(refs, entity_keys(spark, sf_dir), KEY, "simple")
    return orphan_report(gone, refs, ["table_name", "field_name", "snapshot_no"])


_REFS_SQL = r"""
refs AS (
  SELECT 'entities' AS table_name, repo, snapshot_no, id AS record_id, 'directDeps' AS field_name, unnest(directDeps) AS raw FROM entities
  UNION ALL
  SELECT 'entities', repo, snapshot_no, id, 'directUsages', unnest(directUsages) FROM entities
  UNION ALL
  SELECT 'write_sections', repo, snapshot_no, CAST(section_row_id AS VARCHAR), 'dependencyEntityIds', unnest(dependencyEntityIds) FROM write_sections
  UNION ALL
  SELECT 'domain_map', repo, snapshot_no, slug, 'file', 'file:' || regexp_replace(file, '^\s+|\s+$', '', 'g') FROM domain_map
),
clean AS (SELECT * EXCLUDE (raw), regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM refs),
canon AS (
  SELECT * EXCLUDE (t),
    CASE WHEN regexp_matches(t, '^(file|symbol):') THEN
      regexp_extract(t, '^(file|symbol):', 1) || ':' ||
      regexp_replace(replace(regexp_extract(t, '^(?:file|symbol):([^#]*)', 1), '\', '/'), '^(\./+)+', '') ||
      regexp_extract(t, '^(?:file|symbol):[^#]*(#.*)$', 1)
    ELSE t END AS target_id
  FROM clean WHERE t IS NOT NULL AND t <> '' AND t <> 'file:'
),
named AS (
  SELECT DISTINCT table_name, repo, snapshot_no, record_id, field_name,
    CASE WHEN field_name = 'file' THEN substr(target_id, 6) ELSE target_id END AS ref, target_id
  FROM canon
),
keys AS (SELECT DISTINCT repo, snapshot_no, regexp_replace(id, '^\s+|\s+$', '', 'g') AS target_id FROM entities),
gone AS (SELECT n.* FROM named n WHERE NOT EXISTS (
  SELECT 1 FROM keys k WHERE k.repo = n.repo AND k.snapshot_no = n.snapshot_no AND k.target_id = n.target_id))
"""

QUERIES = {"p2_found": p2_found, "p2_orphan_rates": p2_orphan_rates}
SQL = {
    "p2_found": f"WITH {_REFS_SQL} SELECT DISTINCT table_name, repo, snapshot_no, record_id, field_name, ref FROM gone",
    "p2_orphan_rates": f"""WITH {_REFS_SQL},
total AS (SELECT table_name, field_name, snapshot_no, count(*) AS n_refs FROM named GROUP BY ALL),
bad AS (SELECT table_name, field_name, snapshot_no, count(*) AS n_orphans FROM gone GROUP BY ALL)
SELECT t.table_name, t.field_name, t.snapshot_no, n_refs, coalesce(n_orphans, 0) AS n_orphans,
  round(coalesce(n_orphans, 0) / n_refs, 6) AS orphan_share
FROM total t LEFT JOIN bad b ON t.table_name = b.table_name AND t.field_name = b.field_name AND t.snapshot_no = b.snapshot_no""",
}
