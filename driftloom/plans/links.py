"""Links between pages, symbols in earlier cuts, and pages for a site."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.markdown import linkify, site_page
from driftloom.plans.texts import _canonical, q_unique_links
from driftloom.sources.tables import table


def relative_href(source, target):
    """The relative path from the page `source` to `target`, both with slashes."""
    a, b = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    most = F.least(F.size(a), F.size(b) - 1)
    same = F.size(F.filter(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.concat(F.repeat(F.lit("../"), F.size(a) - same), F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def q_relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link from each page to the next one of its source."""
    d = table(spark, sf_dir, "documents").filter("doc_path IS NOT NULL").select("source", "doc_path").distinct()
    nxt = d.withColumn("next_path", F.lead("doc_path").over(Window.partitionBy("source").orderBy("doc_path"))).filter("next_path IS NOT NULL")
    return nxt.select("source", "doc_path", "next_path", relative_href(F.col("doc_path"), F.col("next_path")).alias("href"))


def q_path_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that exactly one document has, and the paths that several share with their number."""
    d = table(spark, sf_dir, "documents").filter("doc_path IS NOT NULL").groupBy("doc_path").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return d.select("doc_path", "n", F.when(F.col("n") == 1, F.col("first")).alias("doc_id"))


def q_symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of an earlier cut that holds each exported function's start: the first that covers it, else the file's first part."""
    s = table(spark, sf_dir, "source_files").filter("source IS NOT NULL").select("file_id", "source").distinct()
    names = s.select("file_id", "source", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"(?m)^export function ([A-Za-z_$][A-Za-z0-9_$]*)\("), F.lit(1)))).alias("name"))
    at = names.select("file_id", "name", (F.instr("source", F.concat(F.lit("export function "), "name", F.lit("("))) - 1).alias("at"))
    c = table(spark, sf_dir, "writer_chunks").select("file_id", "part", F.explode("coverage").alias("c")).select("file_id", "part", F.col("c.startOffset").alias("s"), F.col("c.endOffset").alias("e"))
    any_part = table(spark, sf_dir, "writer_chunks").groupBy("file_id").agg(F.min("part").alias("first_part"))
    hit = at.join(c, "file_id").filter("s <= at AND at < e").groupBy("file_id", "name").agg(F.min("part").alias("part"))
    return at.join(any_part, "file_id").join(hit, ["file_id", "name"], "left").select("file_id", "name", F.coalesce("part", "first_part").alias("part"), F.col("part").isNotNull().alias("covered"))


def q_linkify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts with links where a code span names exactly one file."""
    links = q_unique_links(spark, sf_dir).groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("span", "target"))).alias("targets"))

    @F.pandas_udf(T.StringType())
    def link(texts: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([linkify(t, dict(m) if m is not None else {}) for t, m in zip(texts, targets)])

    j = _canonical(spark, sf_dir).select("pair_id", "text").join(links, "pair_id", "left")
    return j.select("pair_id", link("text", "targets").alias("linked"))


def q_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page document as the site gets it: length and hash of the transformed text."""

    @F.pandas_udf(T.StringType())
    def page(texts: pd.Series) -> pd.Series:
        return texts.map(site_page, na_action="ignore")

    d = table(spark, sf_dir, "documents").filter("kind = 'page' AND text IS NOT NULL").select("doc_id", page("text").alias("p"))
    return d.select("doc_id", F.char_length("p").cast("bigint").alias("n_chars"), F.sha2("p", 256).alias("page_hash"))


QUERIES = {f.__name__: f for f in (q_relative_links, q_path_targets, q_symbol_chunks, q_linkify, q_site_pages)}
SQL = {
    "q_relative_links": """WITH d AS (SELECT DISTINCT source, doc_path FROM documents WHERE doc_path IS NOT NULL), n AS (SELECT *, lead(doc_path) OVER (PARTITION BY source ORDER BY doc_path) AS next_path FROM d),
x AS (SELECT *, string_split(doc_path, '/')[:-2] AS a, string_split(next_path, '/') AS b FROM n WHERE next_path IS NOT NULL),
y AS (SELECT *, len(list_filter(range(1, least(len(a), len(b) - 1) + 1), lambda i: a[1:i] = b[1:i])) AS k FROM x)
SELECT source, doc_path, next_path, repeat('../', len(a) - k) || array_to_string(b[k + 1:], '/') AS href FROM y""",
    "q_path_targets": "SELECT doc_path, count(*) AS n, CASE WHEN count(*) = 1 THEN min(doc_id) END AS doc_id FROM documents WHERE doc_path IS NOT NULL GROUP BY 1",
    "q_symbol_chunks": """WITH s AS (SELECT DISTINCT file_id, source FROM source_files WHERE source IS NOT NULL),
n AS (SELECT DISTINCT file_id, source, unnest(regexp_extract_all(source, '(?m)^export function ([A-Za-z_$][A-Za-z0-9_$]*)\\(', 1)) AS name FROM s),
at_ AS (SELECT file_id, name, instr(source, 'export function ' || name || '(') - 1 AS p FROM n), c AS (SELECT file_id, part, unnest(coverage) AS c FROM writer_chunks), f AS (SELECT file_id, min(part) AS first_part FROM writer_chunks GROUP BY 1),
h AS (SELECT a.file_id, a.name, min(c.part) AS part FROM at_ a JOIN c ON c.file_id = a.file_id AND c.c.startOffset <= a.p AND a.p < c.c.endOffset GROUP BY 1, 2)
SELECT a.file_id, a.name, coalesce(h.part, f.first_part) AS part, h.part IS NOT NULL AS covered FROM at_ a JOIN f ON f.file_id = a.file_id LEFT JOIN h ON h.file_id = a.file_id AND h.name = a.name""",
}
