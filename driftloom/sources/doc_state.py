"""Documentation state on disk: one JSON file per document, read and written as tables.

A state file has version, docPath, sectionOrder and sections by id; each section has its blocks.  Files of another
version stop the read; debug dumps are skipped.  Writing goes to a new folder and moves a pointer, never over a folder
that is being read.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_VERSION = 4

_BLOCK = T.StructType(
    [T.StructField("body", T.StringType()), T.StructField("rendered", T.BooleanType()), T.StructField("stale", T.BooleanType()), T.StructField("fingerprint", T.StringType()), T.StructField("language", T.StringType())]
)
_SECTION = T.StructType(
    [
        T.StructField("heading", T.StringType()), T.StructField("owns", T.ArrayType(T.StringType())), T.StructField("depends", T.ArrayType(T.StringType())),
        T.StructField("blockOrder", T.ArrayType(T.StringType())), T.StructField("blocks", T.MapType(T.StringType(), _BLOCK)),
    ]
)
STATE = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("docPath", T.StringType()), T.StructField("sectionOrder", T.ArrayType(T.StringType())), T.StructField("sections", T.MapType(T.StringType(), _SECTION))]
)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """(docPath, sectionOrder, sections) of every state file under `folder`; another version raises when it is read."""
    raw = spark.read.schema(STATE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    raw = raw.filter(~F.col("_metadata.file_path").contains(".generation-debug."))
    known = F.when(F.col("version") == STATE_VERSION, F.col("docPath")).otherwise(F.raise_error(F.concat(F.lit("state version "), F.coalesce(F.col("version").cast("string"), F.lit("missing")), F.lit(" in "), F.col("_metadata.file_path"))))
    return raw.select(known.alias("docPath"), "sectionOrder", "sections")


def section_rows(states: DataFrame) -> DataFrame:
    """(docPath, position, section_id, heading, owns, depends, blockOrder, blocks) in the order of each document."""
    s = states.select("docPath", "sections", F.posexplode("sectionOrder").alias("position", "section_id"))
    return s.withColumn("s", F.try_element_at("sections", F.col("section_id"))).filter("s IS NOT NULL").select("docPath", "position", "section_id", "s.*")


def block_rows(states: DataFrame) -> DataFrame:
    """(docPath, section_id, block, body, rendered, stale, fingerprint, language) with blank bodies and false flags for what is missing."""
    b = section_rows(states).select("docPath", "section_id", F.explode("blocks").alias("block", "b"))
    return b.select(
        "docPath", "section_id", "block", F.coalesce("b.body", F.lit("")).alias("body"), F.coalesce("b.rendered", F.lit(False)).alias("rendered"),
        F.coalesce("b.stale", F.lit(False)).alias("stale"), "b.fingerprint", "b.language",
    )


def duplicate_sections(states: DataFrame) -> DataFrame:
    """Section ids that more than one document (or place) holds."""
    return section_rows(states).groupBy("section_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def write_snapshot(df: DataFrame, root: str) -> str:
    """Writes `df` as a new snapshot folder under `root` and returns its path; older snapshots stay readable."""
    path = f"{root.rstrip('/')}/snapshot={time.time_ns()}"
    df.write.mode("errorifexists").parquet(path)
    return path


def changed_only(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of `new` whose key is new or whose value is not that of their key in `old`: write only what changed."""
    o = old.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__there"))
    return new.join(o, key, "left").filter(F.col("__there").isNull() | ~F.col("__old").eqNullSafe(F.col(value))).drop("__old", "__there")
