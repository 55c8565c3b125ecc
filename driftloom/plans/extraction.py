"""What the source files hold: entities, imports, calls, literals, the edges between them and the decisions about pages.

A path of a repository may have several versions; edges and decisions are those of the newest, the rest covers all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import extract as X
from driftloom.plans.current import first_of
from driftloom.session import cut_lineage
from driftloom.sources.tables import table


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_files(table(spark, sf_dir, "source_files"))


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").filter("source IS NOT NULL")
    return cut_lineage(X.extract_files(first_of(f, ["repo", "path"], [F.desc("committed_at"), F.desc("file_id")])))


def q_extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table_of(_all(spark, sf_dir), "entities").drop("refs").distinct()


def q_extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of the newest files with the file each comes from."""
    return X.resolved_imports(_newest(spark, sf_dir)).select("repo", "path", "local", "imported", "module", "type_only", "external", "referenced", "resolved").distinct()


def q_extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each entity calls what."""
    return X.table_of(_all(spark, sf_dir), "calls").distinct().groupBy("file_id", "entity", "callee").agg(F.count(F.lit(1)).alias("n_calls"), F.min("offset").alias("first_offset"))


def q_extract_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table_of(_all(spark, sf_dir), "literals").select("file_id", "entity", "offset", "role", "value").distinct()


def q_shared_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that entities of several files of a repository hold: contracts that no import shows."""
    x = X.table_of(_newest(spark, sf_dir), "literals").select("repo", "path", "entity", "value").distinct()
    n = x.groupBy("repo", "value").agg(F.count_distinct("path").alias("n_files")).filter("n_files > 1")
    return x.join(n, ["repo", "value"]).select("repo", "value", "entity", "n_files")


def q_extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.references(_newest(spark, sf_dir))


def q_page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, side effects, use, weight and role of each entity."""
    e = _newest(spark, sf_dir)
    return X.metrics(e, X.references(e))


def q_block_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks each entity's page has, and those left out."""
    e = _newest(spark, sf_dir)
    edges = cut_lineage(X.references(e))
    m = X.metrics(e, edges)
    inner = edges.filter(~F.col("dst").startswith(F.concat("src", F.lit(".")))).select("repo", F.col("src").alias("id")).distinct().withColumn("d", F.lit(True))
    outer = X.table_of(e, "imports").filter("referenced AND NOT type_only AND NOT (external AND module LIKE 'node:%')").select("repo", "path").distinct().withColumn("i", F.lit(True))
    j = m.join(inner, ["repo", "id"], "left").join(outer, ["repo", "path"], "left")
    out = X.block_inclusion(j, F.coalesce(F.col("d"), F.col("i"), F.lit(False)))
    return out.select("repo", "id", F.array_join("allowed", ",").alias("allowed"), F.array_join("skipped", ",").alias("skipped"))


QUERIES = {f.__name__: f for f in (q_extract_entities, q_extract_imports, q_extract_calls, q_extract_literals, q_shared_literals, q_extract_edges, q_page_roles, q_block_inclusion)}
SQL: dict[str, str] = {}
