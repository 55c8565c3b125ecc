"""The newest delivery of every repository, its dependency edges, its domains, and the sections written about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.ids import canonical_id, canonical_path, strip_blank
from driftloom.sources.tables import table


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first of `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def newest(df: DataFrame) -> DataFrame:
    """The rows of each repository's newest snapshot: one aggregate on the key columns, then a semi-join."""
    last = df.groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    return df.join(last, ["repo", "snapshot_no"], "left_semi")


def current_entities(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One row per repo and id of the newest snapshot, re-deliveries resolved by arrival."""
    e = table(spark, sf_dir, "entities")
    want = columns or ["type", "path", "name", "signature", "range", "directDeps", "directUsages", "contentHash", "facets"]
    keep = ["repo", "snapshot_no", "id", "loaded_at", "ord", *want]
    return first_of(newest(e.select(*keep)), ["repo", "id"], ["loaded_at", "ord"]).select("repo", "snapshot_no", "id", *want)


def dependency_edges(cur: DataFrame) -> DataFrame:
    """(owner, src, dst): distinct dependencies between entities of the index, in canonical spelling, without self."""
    raw = cur.select(F.col("repo").alias("owner"), F.col("id").alias("src"), F.explode("directDeps").alias("r")).select("owner", "src", canonical_id(F.col("r")).alias("dst"))
    ids = cur.select(F.col("repo").alias("owner"), F.col("id").alias("dst"))
    return raw.filter("dst <> src").distinct().join(ids, ["owner", "dst"], "left_semi").select("owner", "src", "dst")


def current_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, slug, file, domain_ord, file_ord) of the newest map, paths in canonical spelling, repeats dropped."""
    d = newest(table(spark, sf_dir, "domain_map"))
    file = canonical_path(strip_blank(F.col("file")))
    return d.withColumn("file", file).groupBy("repo", "slug", "file").agg(F.min("domain_ord").alias("domain_ord"), F.min("file_ord").alias("file_ord"))


def sections(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The latest work item per repo and section."""
    w = table(spark, sf_dir, "write_sections").select("repo", "sectionId", "snapshot_no", "created_at", "section_row_id", *columns)
    return first_of(w, ["repo", "sectionId"], [F.desc("created_at"), F.desc("section_row_id")]).drop("created_at", "section_row_id")


# The same views for DuckDB.
_CANON = r"""CASE WHEN regexp_matches({t}, '^(file|symbol):') THEN regexp_extract({t}, '^(file|symbol):', 1) || ':' ||
  regexp_replace(replace(regexp_extract({t}, '^(?:file|symbol):([^#]*)', 1), '\', '/'), '^(\./+)+', '') || regexp_extract({t}, '^(?:file|symbol):[^#]*(#.*)$', 1) ELSE {t} END"""
TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
CUR = """cur AS (SELECT * EXCLUDE (rn) FROM (
  SELECT e.*, row_number() OVER (PARTITION BY repo, id ORDER BY loaded_at, ord) AS rn FROM entities e
  SEMI JOIN (SELECT repo, max(snapshot_no) AS snapshot_no FROM entities GROUP BY repo) l USING (repo, snapshot_no)) WHERE rn = 1)"""
EDGES = f"""{CUR}, raw_deps AS (SELECT repo AS owner, id AS src, {TRIM.format(c="r")} AS t FROM (SELECT repo, id, unnest(directDeps) AS r FROM cur)),
edges AS (SELECT DISTINCT d.owner, d.src, d.dst FROM (SELECT owner, src, {_CANON.format(t="t")} AS dst FROM raw_deps) d
  SEMI JOIN cur c ON c.repo = d.owner AND c.id = d.dst WHERE d.dst <> d.src)"""
DOMAINS = f"""domains AS (SELECT repo, slug, regexp_replace(replace({TRIM.format(c="file")}, '\\', '/'), '^(\\./+)+', '') AS file,
  min(domain_ord) AS domain_ord, min(file_ord) AS file_ord FROM domain_map
  SEMI JOIN (SELECT repo, max(snapshot_no) AS snapshot_no FROM domain_map GROUP BY repo) l USING (repo, snapshot_no) GROUP BY 1, 2, 3)"""
SECTIONS = """sections AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, sectionId ORDER BY created_at DESC, section_row_id DESC) AS rn FROM write_sections) WHERE rn = 1)"""
