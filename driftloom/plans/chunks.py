"""Budgeted chunk planning over runs, and metrics of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.ids import path_of_id
from driftloom.operators.folds import greedy_bins, prefix_cap, skip_cap
from driftloom.plans.current import CUR, EDGES, current_entities, dependency_edges
from driftloom.plans.graphs import SQL as GRAPH_SQL
from driftloom.plans.graphs import q_in_degree
from driftloom.sources.tables import table

PREFIX_CAP, SKIP_CAP, BIN_CAP, BATCH = 500, 400, 300, 3


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, section_row_id, size): the characters of callers' bodies and the heading of each work item."""
    w = table(spark, sf_dir, "write_sections")
    bodies = F.aggregate(F.coalesce(F.transform("callers", lambda c: F.coalesce(F.char_length(c["body"]), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    return w.select("run_id", "section_row_id", (bodies + F.char_length("sectionId")).cast("bigint").alias("size")).distinct()


def q_prefix_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_cap(_work(spark, sf_dir), ["run_id"], "section_row_id", "size", PREFIX_CAP).select("run_id", "section_row_id", F.col("used").cast("bigint").alias("used"))


def q_skip_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_cap(_work(spark, sf_dir), ["run_id"], "section_row_id", "size", "section_row_id", SKIP_CAP)


def q_bin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_bins(_work(spark, sf_dir), ["run_id"], "section_row_id", "size", "section_row_id", BIN_CAP)


def q_chunk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items of a run in batches of a fixed number."""
    w = Window.partitionBy("run_id").orderBy("section_row_id", "size")
    return _work(spark, sf_dir).select("run_id", "section_row_id", F.floor((F.row_number().over(w) - 1) / BATCH).cast("bigint").alias("batch"))


def q_run_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and rounded-up tokens (four characters each) of each run."""
    return _work(spark, sf_dir).groupBy("run_id").agg(F.sum("size").alias("n_chars"), F.ceil(F.sum("size") / 4).cast("bigint").alias("n_tokens"))


def q_chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each earlier cut's file is covered, counted once, with its gaps and repeats."""
    c = table(spark, sf_dir, "writer_chunks").select("run_id", "file_id", F.explode("coverage").alias("c")).select("run_id", "file_id", F.col("c.startOffset").cast("bigint").alias("s"), F.col("c.endOffset").cast("bigint").alias("e")).filter("s IS NOT NULL AND e > s").distinct()
    w = Window.partitionBy("run_id", "file_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("e").over(w), F.lit(0))
    x = c.withColumn("before", before)
    return x.groupBy("run_id", "file_id").agg(
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("covered"), F.sum(F.greatest(F.lit(0), F.col("s") - F.col("before"))).alias("gaps"), F.sum(F.greatest(F.lit(0), F.least("before", "e") - F.col("s"))).alias("repeated")
    )


def q_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each symbol from its size and use: ln(lines + 2) times one plus half of ln(in-degree + 1)."""
    cur = current_entities(spark, sf_dir, ["type", "range"]).filter("type IN ('function', 'class', 'method')")
    lines = F.coalesce(F.col("range.endLine") - F.col("range.startLine") + 1, F.lit(0))
    j = cur.join(q_in_degree(spark, sf_dir), ["repo", "id"])
    return j.select("repo", "id", F.round(F.log(lines + F.lit(2.0)) * (1 + 0.5 * F.log(F.col("in_degree") + F.lit(1.0))), 6).alias("weight"))


def q_method_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class with two or more methods: the share of method pairs that have a dependency in common.

    Pairs that share are found through the shared dependency, not by pairing all methods.
    """
    cur = current_entities(spark, sf_dir, ["path", "name", "type", "directDeps"])
    m = cur.filter("type = 'method'").select("repo", "path", F.regexp_replace("name", r"\.[^.]*$", "").alias("cls"), "id")
    e = dependency_edges(cur).select(F.col("owner").alias("repo"), F.col("src").alias("id"), "dst")
    d = m.join(e, ["repo", "id"])
    pairs = d.alias("x").join(d.alias("y"), ["repo", "path", "cls", "dst"]).filter("x.id < y.id").select("repo", "path", "cls", F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    n = m.groupBy("repo", "path", "cls").agg(F.count(F.lit(1)).alias("n_methods")).filter("n_methods > 1")
    k = pairs.groupBy("repo", "path", "cls").agg(F.count(F.lit(1)).alias("k"))
    share = F.coalesce("k", F.lit(0)) / (F.col("n_methods") * (F.col("n_methods") - 1) / 2)
    return n.join(k, ["repo", "path", "cls"], "left").select("repo", "path", "cls", "n_methods", F.round(share, 6).alias("overlap"))


def q_file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: symbols, symbols used from elsewhere, and lines of the largest symbol."""
    cur = current_entities(spark, sf_dir, ["path", "type", "range"]).filter("type <> 'file' AND path IS NOT NULL")
    j = cur.join(q_in_degree(spark, sf_dir), ["repo", "id"])
    return j.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("in_degree") > 0).alias("n_used"), F.max(F.col("range.endLine") - F.col("range.startLine") + 1).cast("bigint").alias("largest_lines")
    )


def q_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with callers in other files, and the files that call them."""
    e = dependency_edges(current_entities(spark, sf_dir, ["directDeps"]))
    x = e.filter("dst LIKE 'symbol:%'").withColumn("f", path_of_id(F.col("src"))).filter((F.col("f") != "") & (F.col("f") != path_of_id(F.col("dst"))))
    return x.groupBy(F.col("owner").alias("repo"), F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("caller_files"))


_WORK = "work AS (SELECT DISTINCT run_id, section_row_id, CAST(coalesce(list_sum(list_transform(callers, lambda c: coalesce(length(c.body), 0))), 0) + length(sectionId) AS BIGINT) AS size FROM write_sections)"
_RN = f"{_WORK}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY section_row_id, size) AS n FROM work)"
_DEG = f"deg AS ({GRAPH_SQL['q_in_degree']})"

QUERIES = {f.__name__: f for f in (q_prefix_cap, q_skip_cap, q_bin_pack, q_chunk_batch, q_run_budget, q_chunk_coverage, q_weight, q_method_overlap, q_file_roles, q_constraints)}
SQL = {
    "q_prefix_cap": f"WITH {_WORK}, s AS (SELECT *, sum(size) OVER (PARTITION BY run_id ORDER BY section_row_id, size ROWS UNBOUNDED PRECEDING) AS used FROM work) SELECT run_id, section_row_id, CAST(used AS BIGINT) AS used FROM s WHERE used <= {PREFIX_CAP}",
    "q_skip_cap": f"""WITH RECURSIVE {_RN}, f AS (SELECT run_id, n, section_row_id, CASE WHEN size <= {SKIP_CAP} THEN size ELSE 0 END AS used, size <= {SKIP_CAP} AS taken FROM o WHERE n = 1
  UNION ALL SELECT o.run_id, o.n, o.section_row_id, CASE WHEN f.used + o.size <= {SKIP_CAP} THEN f.used + o.size ELSE f.used END, f.used + o.size <= {SKIP_CAP} FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)
SELECT run_id, section_row_id FROM f WHERE taken""",
    "q_bin_pack": f"""WITH RECURSIVE {_RN}, f AS (SELECT run_id, n, section_row_id, size AS used, CAST(0 AS BIGINT) AS bin FROM o WHERE n = 1
  UNION ALL SELECT o.run_id, o.n, o.section_row_id, CASE WHEN f.used + o.size > {BIN_CAP} THEN o.size ELSE f.used + o.size END, CASE WHEN f.used + o.size > {BIN_CAP} THEN f.bin + 1 ELSE f.bin END FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)
SELECT run_id, section_row_id, bin FROM f""",
    "q_chunk_batch": f"WITH {_RN} SELECT run_id, section_row_id, CAST((n - 1) // {BATCH} AS BIGINT) AS batch FROM o",
    "q_run_budget": f"WITH {_WORK} SELECT run_id, CAST(sum(size) AS BIGINT) AS n_chars, CAST(ceil(sum(size) / 4) AS BIGINT) AS n_tokens FROM work GROUP BY 1",
    "q_chunk_coverage": """WITH c AS (SELECT DISTINCT run_id, file_id, CAST(c.startOffset AS BIGINT) AS s, CAST(c.endOffset AS BIGINT) AS e FROM (SELECT run_id, file_id, unnest(coverage) AS c FROM writer_chunks) WHERE c.startOffset IS NOT NULL AND c.endOffset > c.startOffset),
x AS (SELECT *, coalesce(max(e) OVER (PARTITION BY run_id, file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT run_id, file_id, CAST(sum(greatest(0, e - greatest(s, before))) AS BIGINT) AS covered, CAST(sum(greatest(0, s - before)) AS BIGINT) AS gaps, CAST(sum(greatest(0, least(before, e) - s)) AS BIGINT) AS repeated FROM x GROUP BY 1, 2""",
    "q_weight": f"""WITH {CUR}, {_DEG} SELECT c.repo, c.id, round(ln(coalesce(c.range.endLine - c.range.startLine + 1, 0) + 2.0) * (1 + 0.5 * ln(d.in_degree + 1.0)), 6) AS weight
FROM cur c JOIN deg d ON d.repo = c.repo AND d.id = c.id WHERE c.type IN ('function', 'class', 'method')""",
    "q_method_overlap": f"""WITH {EDGES}, m AS (SELECT repo, path, regexp_replace(name, '\\.[^.]*$', '') AS cls, id FROM cur WHERE type = 'method'), d AS (SELECT m.*, e.dst FROM m JOIN edges e ON e.owner = m.repo AND e.src = m.id),
p AS (SELECT DISTINCT x.repo, x.path, x.cls, x.id AS a, y.id AS b FROM d x JOIN d y ON x.repo = y.repo AND x.path = y.path AND x.cls = y.cls AND x.dst = y.dst AND x.id < y.id),
k AS (SELECT repo, path, cls, count(*) AS k FROM p GROUP BY 1, 2, 3), n AS (SELECT repo, path, cls, count(*) AS n_methods FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT n.repo, n.path, n.cls, n_methods, round(coalesce(k, 0) / (n_methods * (n_methods - 1) / 2), 6) AS overlap FROM n LEFT JOIN k ON k.repo = n.repo AND k.path = n.path AND k.cls = n.cls""",
    "q_file_roles": f"""WITH {CUR}, {_DEG} SELECT c.repo, c.path, count(*) AS n_symbols, count(*) FILTER (d.in_degree > 0) AS n_used, CAST(max(c.range.endLine - c.range.startLine + 1) AS BIGINT) AS largest_lines
FROM cur c JOIN deg d ON d.repo = c.repo AND d.id = c.id WHERE c.type <> 'file' AND c.path IS NOT NULL GROUP BY 1, 2""",
    "q_constraints": f"""WITH {EDGES}, x AS (SELECT DISTINCT owner, dst, regexp_extract(src, '^(?:file:|symbol:)([^#]*)', 1) AS f FROM edges WHERE dst LIKE 'symbol:%')
SELECT owner AS repo, dst AS id, string_agg(f, ',' ORDER BY f) AS caller_files FROM x WHERE f <> '' AND f <> regexp_extract(dst, '^(?:file:|symbol:)([^#]*)', 1) GROUP BY 1, 2""",
}
