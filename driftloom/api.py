"""One function per question of the command line: what changed, what is affected, what is stale, what is invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.plans import chunks, domains, graphs, references, snapshots, states


def analyze_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections affected by what changed since they were written, most direct first."""
    return graphs.q_impact(spark, sf_dir).orderBy("impact_order", "repo", "sectionId")


def changed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.entity_changes(spark, sf_dir)


def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale blocks of all detectors."""
    return states.q_stale_merged(spark, sf_dir)


def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be refreshed, in what order: stale blocks with the impact order of their section (3 without one)."""
    stale = states.q_stale_merged(spark, sf_dir).withColumnRenamed("section", "sectionId")
    j = stale.join(graphs.q_impact(spark, sf_dir), ["repo", "sectionId"], "left")
    return j.select("repo", "sectionId", "block", "drift", "facets", F.coalesce("impact_order", F.lit(3).cast("bigint")).alias("impact_order"))


def validate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of sections and of the domain maps in one table."""
    a = domains.q_validate(spark, sf_dir).select("repo", F.col("sectionId").alias("subject"), "issue", "detail")
    return a.unionByName(domains.q_domain_coverage(spark, sf_dir).select("repo", F.col("file").alias("subject"), "issue", F.col("slugs").alias("detail")))


def dead_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.p2_found(spark, sf_dir)


def generation_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.q_waves(spark, sf_dir).orderBy("owner", "wave", "scc", "node")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.q_file_nodes(spark, sf_dir)


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.q_constraints(spark, sf_dir)


QUERIES = {"q_refresh_plan": refresh_plan, "q_validate_docs": validate_docs}
SQL = {
    "q_refresh_plan": f"""WITH s AS ({states.SQL["q_stale_merged"]}), i AS ({graphs.SQL["q_impact"]})
SELECT s.repo, s.section AS sectionId, s.block, s.drift, s.facets, coalesce(i.impact_order, 3) AS impact_order FROM s LEFT JOIN i ON i.repo = s.repo AND i.sectionId = s.section""",
    "q_validate_docs": f"""SELECT repo, sectionId AS subject, issue, detail FROM ({domains.SQL["q_validate"]}) UNION ALL SELECT repo, file, issue, slugs FROM ({domains.SQL["q_domain_coverage"]})""",
}
