"""Queries over diffs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.diffs import parse_diff
from driftloom.sources.tables import table

_DIFF = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -3 +3 @@ export function one
@@ -10,2 +11,4 @@
diff --git a/src/old.ts b/src/old.ts
--- a/src/old.ts
+++ /dev/null
@@ -1,9 +0,0 @@
diff --git a/src/b.ts b/src/c.ts
--- a/src/b.ts
+++ b/src/c.ts
@@ -0,0 +1,25 @@"""


def q_diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hunks of a diff, one for each repository that has work items."""
    lines = table(spark, sf_dir, "write_sections").select(F.col("repo").alias("diff_id")).distinct().select("diff_id", F.posexplode(F.split(F.lit(_DIFF), "\n")).alias("line_no", "line"))
    return parse_diff(lines)


def q_run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls per feed and day, counted once per stage."""
    s = table(spark, sf_dir, "llm_stages").groupBy("stage_id").agg(F.min("feed").alias("feed"), F.min("logged_at").alias("at"))
    return s.filter("at IS NOT NULL").groupBy("feed", F.date_trunc("day", "at").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n_calls"))


def q_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per provider and model, stages delivered twice counted once."""
    u = F.col("response.usage")
    s = table(spark, sf_dir, "llm_stages").groupBy("stage_id").agg(F.min("provider").alias("provider"), F.min("model").alias("model"), F.max(u["promptTokens"]).alias("p"), F.max(u["completionTokens"]).alias("c"))
    return s.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n_stages"), F.sum("p").cast("bigint").alias("prompt_tokens"), F.sum("c").cast("bigint").alias("completion_tokens"))


QUERIES = {"q_diff_parse": q_diff_parse, "q_run_histogram": q_run_histogram, "q_token_usage": q_token_usage}
SQL = {
    "q_diff_parse": f"""WITH d AS (SELECT DISTINCT repo AS diff_id FROM write_sections), a AS (SELECT diff_id, string_split('{_DIFF}', chr(10)) AS x FROM d),
l AS (SELECT diff_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM a),
p AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\\+\\+\\+ b/') THEN regexp_extract(line, '^\\+\\+\\+ b/(.*)$', 1) WHEN regexp_matches(line, '^diff --git ') THEN regexp_extract(line, ' b/(.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY n) AS path FROM l),
h AS (SELECT diff_id, path, CAST(regexp_extract(line, '\\+(\\d+)', 1) AS INTEGER) AS s, regexp_extract(line, '\\+\\d+,(\\d+) @@', 1) AS c FROM p WHERE regexp_matches(line, '^@@'))
SELECT diff_id, path, s AS start_line, s + greatest(CASE WHEN c = '' THEN 1 ELSE CAST(c AS INTEGER) END - 1, 0) AS end_line FROM h""",
    "q_run_histogram": "SELECT feed, CAST(date_trunc('day', t) AS TIMESTAMP) AS day, count(*) AS n_calls FROM (SELECT stage_id, min(feed) AS feed, min(logged_at) AS t FROM llm_stages GROUP BY 1) WHERE t IS NOT NULL GROUP BY 1, 2",
    "q_token_usage": """SELECT provider, model, count(*) AS n_stages, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM (
  SELECT stage_id, min(provider) AS provider, min(model) AS model, max(response.usage.promptTokens) AS p, max(response.usage.completionTokens) AS c FROM llm_stages GROUP BY 1) GROUP BY 1, 2""",
}
