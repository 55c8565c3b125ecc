"""Unified diffs as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_diff(lines: DataFrame) -> DataFrame:
    """(diff_id, path, start_line, end_line) of the hunks of unified diffs.

    `lines`: (diff_id, line_no, line).  A ``diff --git`` header sets the path, ``+++ b/`` overrides it, ``+++ /dev/null``
    leaves it; a hunk without a count has one line, a count of 0 marks its start line.
    """
    line = F.col("line")
    header = F.regexp_extract(line, r"^diff --git a/.* b/(.*)$", 1)
    plus = F.regexp_extract(line, r"^\+\+\+ b/(.*)$", 1)
    path = F.when(plus != "", plus).when(header != "", header)
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 1)
    count = F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 2)
    n = F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,([0-9]+))? @@', 2) AS INT)"))
    s = F.expr("try_cast(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,([0-9]+))? @@', 1) AS INT)")
    at = lines.withColumn("path", F.last(path, ignorenulls=True).over(w)).filter(start != "")
    return at.select("diff_id", "path", s.alias("start_line"), (s + F.greatest(n - 1, F.lit(0))).alias("end_line")).filter("path IS NOT NULL")
