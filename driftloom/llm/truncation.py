"""Text cut off by field limits or in transfer.

Per source and column, the histogram of value lengths is tested for spikes, in characters and in bytes: a field limit
piles values up at one length, however many uncut values are longer, so a spike is held against the lengths shortly below
and shortly above it (`field_limits`).  Below `NEIGHBOURS`, where templates and empty containers pile up too, it must
exceed all longer values together.  `p1_limits` lists by its SQL only the spikes that do (`length_spikes`), `p1_at_limit`
the values without terminal punctuation at any of them.  A found value has one of two routes:

* ``limit``: it lies on a spike of its source and lacks terminal punctuation.  An exact check follows, which clears endings
  that are complete without such a mark (a closed JSON text, fence, table row, bracket or code span, a bare symbol).  Endings
  that only style can excuse (a list without final marks, a heading as the last line) are cut exactly here.
* ``transfer``: values cut in transfer end at any length, so that no histogram shows them; they are held against the
  structure of their ending alone (`endings.cut_kind`): an open sentence, list entry, table row, code span, fence or JSON
  text, or the mark an exporter left behind the cut.

Defined results: null and blank values are never cut; repeated records give one row per copy; an empty table gives an
empty result; extra columns are ignored; a very long text costs one pass over it.

Scale: the histogram is summed before its shuffle and has at most one row per source, column, unit and distinct
length, so a source with a third of all rows is no hot task; the limits found are joined as a small table whose size
Spark checks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.endings import cut_kind
from driftloom.sources.tables import table

#: A spike: at least this many values, and this many times the mean of so many lengths beside it.
MIN_VALUES, FACTOR, NEIGHBOURS = 5, 8.0, 64
#: Terminal punctuation at the end of a value.
TERMINAL = r"[.!?…][)\]}\"'»”*_]*\s*$"


@F.pandas_udf(T.StringType())
def cut_kind_udf(texts: pd.Series) -> pd.Series:
    return texts.map(cut_kind, na_action="ignore")


def _spikes(values: DataFrame, by: list[str], text: str, min_values: int, factor: float, neighbours: int) -> DataFrame:
    """Lengths that stand out from those below, with `n_longer` of all longer values and `n_above` of those shortly above."""
    lengths = F.array(
        F.struct(F.lit("chars").alias("unit"), F.char_length(text).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("length"))
    )
    hist = (
        values.filter(F.col(text).isNotNull()).select(*by, F.explode(lengths).alias("l")).select(*by, "l.unit", "l.length").filter("length > 0")
        .groupBy(*by, "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(*by, "unit").orderBy("length")
    near = F.coalesce(F.sum("n").over(w.rangeBetween(-neighbours, -1)), F.lit(0))
    above = F.coalesce(F.sum("n").over(w.rangeBetween(1, neighbours)), F.lit(0))
    longer = F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return (
        hist.withColumn("n_near", near).withColumn("n_above", above).withColumn("n_longer", longer)
        .filter((F.col("n") >= min_values) & (F.col("n") >= factor * (F.col("n_near") / neighbours + 0.5)))
    )


def length_spikes(values: DataFrame, by: list[str], text: str, min_values: int = MIN_VALUES, factor: float = FACTOR, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The spikes that few values exceed, per group `by`: unit (chars or bytes), length, number of values at it, below and above it."""
    return _spikes(values, by, text, min_values, factor, neighbours).filter(F.col("n") > F.col("n_longer")).drop("n_above")


def field_limits(values: DataFrame, by: list[str], text: str, min_values: int = MIN_VALUES, factor: float = FACTOR, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The field limits per group `by`, also those that many uncut values exceed: the spikes against both sides."""
    both = (F.col("length") >= neighbours) & (F.col("n") >= factor * (F.col("n_above") / neighbours + 0.5))
    return _spikes(values, by, text, min_values, factor, neighbours).filter((F.col("n") > F.col("n_longer")) | both)


def truncated_values(values: DataFrame, source: str, column: str, record: str, text: str) -> DataFrame:
    """(column, source, record, n_chars, n_bytes, at_limit, cut, route) of every value that is not null.

    `at_limit` names the unit whose spike a value without terminal punctuation sits on, `cut` what its ending lacks
    (null for a complete one; what style alone excuses counts at a limit only), `route` how a cut value was found.
    """
    spikes = field_limits(values, [column, source], text).select(column, source, "unit", "length")
    char_limits = spikes.filter("unit = 'chars'").select(column, source, F.col("length").alias("n_chars"), F.lit(True).alias("at_chars"))
    byte_limits = spikes.filter("unit = 'bytes'").select(column, source, F.col("length").alias("n_bytes"), F.lit(True).alias("at_bytes"))
    rows = values.filter(F.col(text).isNotNull()).select(
        column, source, record, F.char_length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"), cut_kind_udf(F.col(text)).alias("cut"),
        F.col(text).rlike(TERMINAL).alias("terminal"),
    )
    at = F.when(F.col("at_chars"), "chars").when(F.col("at_bytes"), "bytes")
    return (
        rows.join(char_limits, [column, source, "n_chars"], "left").join(byte_limits, [column, source, "n_bytes"], "left")
        .withColumn("at_limit", F.when(~F.col("terminal"), at))
        .select(column, source, record, "n_chars", "n_bytes", "at_limit", F.when(~F.col("cut").startswith("?") | F.col("at_limit").isNotNull(), F.regexp_replace("cut", r"^\?", "")).alias("cut"))
        .withColumn("route", F.when(F.col("cut").isNotNull(), F.when(F.col("at_limit").isNotNull(), "limit").otherwise("transfer")))
    )


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns that lose their ends, one row per value."""
    stages = table(spark, sf_dir, "llm_stages").select(
        F.lit("llm_stages").alias("table_name"), "feed", F.col("stage_id").alias("record_id"), F.col("response.content").alias("text")
    )
    claims = table(spark, sf_dir, "contradicted_claims").select(
        F.lit("contradicted_claims").alias("table_name"), "feed", F.col("claim_id").alias("record_id"), F.col("evidence").alias("text")
    )
    return stages.unionByName(claims)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_values(field_values(spark, sf_dir), "feed", "table_name", "record_id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).filter("cut IS NOT NULL").select("table_name", "record_id").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and feed: values, values cut, those found at a field limit and those found in transfer, and the share cut."""
    return (
        flagged(spark, sf_dir).groupBy("table_name", "feed")
        .agg(
            F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("cut").isNotNull()).alias("n_cut"),
            F.count_if(F.col("route") == "limit").alias("n_at_limit"), F.count_if(F.col("route") == "transfer").alias("n_in_transfer"),
        )
        .withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field limits that the length histograms show."""
    return length_spikes(field_values(spark, sf_dir), ["table_name", "feed"], "text").select("table_name", "feed", "unit", "length", "n", "n_near", "n_longer")


def p1_at_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values without terminal punctuation at a field limit: what the histograms flag, before any look at the ending."""
    values = field_values(spark, sf_dir).filter(F.col("text").isNotNull() & ~F.col("text").rlike(TERMINAL))
    by = ["table_name", "feed"]
    limits = field_limits(field_values(spark, sf_dir), by, "text").select(*by, "unit", "length")
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.char_length("text").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")))
    return values.select(*by, "record_id", F.inline(sizes)).join(limits, [*by, "unit", "length"]).select(*by, "record_id", "unit", "length").distinct()


def p1_limit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and feed: values and those the histograms flag, with their share."""
    n = field_values(spark, sf_dir).groupBy("table_name", "feed").agg(F.count("text").alias("n_values"))
    at = p1_at_limit(spark, sf_dir).groupBy("table_name", "feed").agg(F.count_distinct("record_id").alias("n_flagged"))
    flagged_ = F.coalesce("n_flagged", F.lit(0))
    return n.join(at, ["table_name", "feed"], "left").select("table_name", "feed", "n_values", flagged_.alias("n_flagged"), F.when(F.col("n_values") > 0, F.round(flagged_ / F.col("n_values"), 6)).alias("share_flagged"))


_HISTOGRAM = f"""WITH v AS (
  SELECT 'llm_stages' AS table_name, feed, stage_id AS record_id, response.content AS text FROM llm_stages
  UNION ALL SELECT 'contradicted_claims', feed, claim_id, evidence FROM contradicted_claims),
h AS (SELECT table_name, feed, unit, length, count(*) AS n FROM (
    SELECT table_name, feed, 'chars' AS unit, CAST(length(text) AS INTEGER) AS length FROM v
    UNION ALL SELECT table_name, feed, 'bytes', CAST(strlen(text) AS INTEGER) FROM v) WHERE length > 0 GROUP BY ALL),
w AS (SELECT *,
    CAST(coalesce(sum(n) OVER (PARTITION BY table_name, feed, unit ORDER BY length RANGE BETWEEN {NEIGHBOURS} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_near,
    CAST(coalesce(sum(n) OVER (PARTITION BY table_name, feed, unit ORDER BY length RANGE BETWEEN 1 FOLLOWING AND {NEIGHBOURS} FOLLOWING), 0) AS BIGINT) AS n_above,
    CAST(coalesce(sum(n) OVER (PARTITION BY table_name, feed, unit ORDER BY length ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS n_longer FROM h),
f AS (SELECT * FROM w WHERE n >= {MIN_VALUES} AND n >= {FACTOR} * (n_near / {NEIGHBOURS} + 0.5)
    AND (n > n_longer OR length >= {NEIGHBOURS} AND n >= {FACTOR} * (n_above / {NEIGHBOURS} + 0.5))),
a AS (SELECT DISTINCT v.table_name, v.feed, v.record_id, f.unit, f.length FROM v JOIN f ON v.table_name = f.table_name AND v.feed = f.feed
    AND f.length = CASE WHEN f.unit = 'chars' THEN length(v.text) ELSE strlen(v.text) END WHERE NOT regexp_matches(v.text, '{TERMINAL.replace("'", "''")}'))
"""

QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_limits": p1_limits, "p1_at_limit": p1_at_limit, "p1_limit_rates": p1_limit_rates}
SQL = {
    "p1_at_limit": _HISTOGRAM + "SELECT * FROM a",
    "p1_limit_rates": _HISTOGRAM
    + """SELECT table_name, feed, count(text) AS n_values, any_value(coalesce(n, 0)) AS n_flagged, CASE WHEN count(text) > 0 THEN round(any_value(coalesce(n, 0)) / count(text), 6) END AS share_flagged
FROM v LEFT JOIN (SELECT table_name, feed, count(DISTINCT record_id) AS n FROM a GROUP BY ALL) USING (table_name, feed) GROUP BY table_name, feed""",
    "p1_limits": f"""WITH v AS (
  SELECT 'llm_stages' AS table_name, feed, response.content AS text FROM llm_stages
  UNION ALL SELECT 'contradicted_claims', feed, evidence FROM contradicted_claims),
h AS (SELECT table_name, feed, unit, length, count(*) AS n FROM (
    SELECT table_name, feed, 'chars' AS unit, CAST(length(text) AS INTEGER) AS length FROM v
    UNION ALL SELECT table_name, feed, 'bytes', CAST(strlen(text) AS INTEGER) FROM v) WHERE length > 0 GROUP BY ALL),
w AS (SELECT *,
    CAST(coalesce(sum(n) OVER (PARTITION BY table_name, feed, unit ORDER BY length RANGE BETWEEN {NEIGHBOURS} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_near,
    CAST(coalesce(sum(n) OVER (PARTITION BY table_name, feed, unit ORDER BY length ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS n_longer FROM h)
SELECT table_name, feed, unit, length, n, n_near, n_longer FROM w
WHERE n >= {MIN_VALUES} AND n >= {FACTOR} * (n_near / {NEIGHBOURS} + 0.5) AND n > n_longer""",
}
