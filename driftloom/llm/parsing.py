"""Source files that do not parse as the language their extension claims.

Each file is held against a packrat grammar of its language (`grammars`), which must consume the whole input.  Where it
does not, the furthest position any rule reached is reported with its line, and the cause: merge conflict markers
there, a text that stops too early, or other syntax.

Defined results: a null source is no case; an empty ts or js file parses, an empty json file does not; files of other
extensions are left out; a file nested so deeply (about 150,000 brackets in each other) that it cannot be decided is no failure
but has the cause `undecided`; repeated files each give a row; an
empty table gives an empty result.

Scale: one pass over each file where it is read, linear in its length; only the rows of the report are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.syntax.grammars import UNDECIDED, cause_of, failure
from driftloom.sources.tables import table

LANGUAGES = ("ts", "js", "json")


def language_of_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, line, cause = [], [], []
        for lang, text in zip(b.column("language").to_pylist(), b.column("source").to_pylist()):
            f = failure(text, lang)
            known = f is not None and f != UNDECIDED
            at.append(f if known else None)
            line.append(text.count("\n", 0, f) + 1 if known else None)
            cause.append(cause_of(text, f) if known else f if f is None else "undecided")
        yield pa.record_batch([b.column("file_id"), b.column("repo"), b.column("language"), pa.array(at, pa.int32()), pa.array(line, pa.int32()), pa.array(cause, pa.string())], names=["file_id", "repo", "language", "failed_at", "line", "cause"])


_CHECKED = T.StructType(
    [T.StructField("file_id", T.LongType()), T.StructField("repo", T.StringType()), T.StructField("language", T.StringType()), T.StructField("failed_at", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("cause", T.StringType())]
)


def parse_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, failed_at, line, cause) of each file with a source; the last three null where it parses."""
    rows = files.select(F.col("file_id").cast("bigint"), "repo", language_of_path(F.col("path")).alias("language"), "source")
    return rows.filter(F.col("source").isNotNull() & F.col("language").isin(*LANGUAGES)).mapInArrow(_check, _CHECKED)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(table(spark, sf_dir, "source_files")).filter("failed_at IS NOT NULL").select("file_id").distinct()


def p5_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and why each file fails, and the files that could not be decided."""
    return parse_files(table(spark, sf_dir, "source_files")).filter("cause IS NOT NULL").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and language: files, files that fail, by cause, and the share that fails."""
    c = F.col("cause")
    return (
        parse_files(table(spark, sf_dir, "source_files")).groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("failed_at").alias("n_failed"), *[F.count_if(c == k).alias(f"n_{k}") for k in ("conflict", "end", "syntax", "undecided")])
        .withColumn("share_failed", F.round(F.col("n_failed") / F.col("n_files"), 6))
    )


QUERIES = {"p5_found": p5_found, "p5_failures": p5_failures, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
