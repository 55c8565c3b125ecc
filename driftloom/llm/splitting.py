"""Cutting oversized items into pieces at natural boundaries, with a given overlap.

A hierarchy of separators is tried from coarse to fine: sections, paragraphs, sentences, words, characters.  For source
code a section begins at a top-level statement (with the comments before it), a paragraph behind a blank line, a
sentence at a line; for prose they are headings, blank lines and sentence ends.  A part that fits is kept whole, one
that does not is split at the next level; the parts are then packed greedily, and each piece but the first repeats the
last `overlap` characters before it.

Defined results: items within the limit are left out, null and empty ones too; pieces cover the item without gaps, stay
within the limit with their overlap, and are never empty; an overlap of the limit or more is refused; code that does not
parse is followed up to the failure and taken up again at the next line that begins a statement at the left margin;
repeated items give repeated pieces; an empty table gives an empty result.  Offsets are in code points.

Scale: one pass over each oversized item where it is read; the limits come as one small fixed table.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.syntax.grammars import RECURSION, _begin, grammar
from driftloom.llm.parsing import language_of_path
from driftloom.syntax.peg import Parsed
from driftloom.sources.tables import table

LEVELS = ("section", "paragraph", "sentence", "word", "character")
_COMMENT = re.compile(r"//[^\n\r  ]*|/\*[\s\S]*?\*/")
_LINE = re.compile(r"^(?=[^\s})\],.;:?|&=*+])", re.M)


def statement_starts(text: str, language: str) -> list[int]:
    """Where the top-level statements begin, comments before them included; the first statement is in the list."""
    p = Parsed(grammar(language), text, at := _begin(text))
    item = p.rules["ModuleItem"]
    starts: list[int] = []
    while True:
        t = p.token(at)
        if t[0] == "e":
            return starts
        try:
            end = item(at)
        except RecursionError:
            end = -1
        if t[1] == ";" and end == t[3]:
            at = end  # an empty statement is no boundary
            continue
        starts.append(_with_comments(text, at, t[2], bool(starts)))
        if end >= 0:
            at = end
            continue
        for m in _LINE.finditer(text, t[2] + 1):
            try:
                if p.token(m.start())[2] == m.start() and item(m.start()) >= 0:
                    at = m.start()
                    break
            except RecursionError:
                continue
        else:
            return starts


def _with_comments(text: str, gap: int, token: int, follows: bool) -> int:
    """The first comment between the end of one statement and the next that is not on the former's line."""
    at = gap
    while True:
        m = _COMMENT.search(text, at, token)
        if m is None:
            return token
        trailing = follows and "\n" not in text[gap : m.start()] and "\r" not in text[gap : m.start()] and re.compile(r"[ \t]*(?:[\n\r]|\Z)").match(text, m.end())
        if not trailing:
            return m.start()
        at = m.end()


def source_levels(text: str, starts: list[int]) -> list[Callable[[int, int], list[int]]]:
    """The separators of source code whose top-level statements behind the first begin at `starts`."""
    return [lambda a, b: [x for x in starts if a < x < b], *_plain_levels(text, re.compile(r"\n(?=[^\n])"))]


def prose_levels(text: str) -> list[Callable[[int, int], list[int]]]:
    heads = [m.start() for m in re.finditer(r"^#{1,6}\s", text, re.M)]
    return [lambda a, b: [x for x in heads if a < x < b], *_plain_levels(text, re.compile(r"(?<=[.!?])\s+"))]


def _plain_levels(text: str, sentence: re.Pattern) -> list[Callable[[int, int], list[int]]]:
    def ends(pattern: re.Pattern) -> Callable[[int, int], list[int]]:
        return lambda a, b: [m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b]

    return [ends(re.compile(r"\n[ \t\r]*\n+")), ends(sentence), ends(re.compile(r"\s+")), lambda a, b: list(range(a + 1, b))]


def parts_of(n: int, room: int, levels: list[Callable[[int, int], list[int]]]) -> list[tuple[int, int, int]]:
    """(start, end, level of the cut at the start) of the parts of at most `room` characters that the hierarchy gives.

    All cuts of a level are made where a part is too large; a part that fits stays whole.
    """
    parts: list[tuple[int, int, int]] = []

    def divide(a: int, b: int, level: int, at_start: int) -> None:
        if b - a <= room:
            parts.append((a, b, at_start))
            return
        if level == len(levels) - 1:
            for k in range(a, b, room):
                parts.append((k, min(b, k + room), at_start if k == a else level))
            return
        edges = [a, *levels[level](a, b), b]
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            divide(x, y, level + 1, at_start if k == 0 else level)

    divide(0, n, 0, 0)
    return parts


def pack(parts: list[tuple[int, int, int]], limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start with overlap, start of new content, end, level of the cut at that start) of the pieces, filled greedily in order."""
    out: list[tuple[int, int, int, int]] = []
    start, level = parts[0][0], parts[0][2]
    end = start
    for a, b, lv in parts:
        lead = max(0, start - overlap)
        if b - lead > limit and end > start:
            out.append((lead, start, end, level))
            start, level = a, lv
        end = b
    out.append((max(0, start - overlap), start, end, level))
    return out


def split(n: int, limit: int, overlap: int, levels: list[Callable[[int, int], list[int]]]) -> list[tuple[int, int, int, int]]:
    """The pieces of n characters, as `pack` gives them."""
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    return pack(parts_of(n, limit - overlap, levels), limit, overlap)


def _splitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(RECURSION)
    for b in batches:
        out: dict[str, list] = {f.name: [] for f in _PIECES}
        for i, path, lang, text, limit, overlap in zip(*(b.column(c).to_pylist() for c in ("file_id", "path", "language", "source", "max_size", "overlap"))):
            if overlap >= limit:
                raise ValueError("the overlap must be smaller than the limit")
            parts = parts_of(len(text), limit - overlap, source_levels(text, statement_starts(text, lang)[1:]))
            cut = pack(parts, limit, overlap)
            row = {
                "file_id": i, "path": path, "boundaries": [a for a, _, level in parts[1:] if level == 0], "n_chars": len(text),
                "pieces": [{"part": k, "start_offset": s, "content_start": c, "end_offset": e, "boundary": "start" if k == 0 else LEVELS[v]} for k, (s, c, e, v) in enumerate(cut)],
            }
            for k, v in row.items():
                out[k].append(v)
        yield pa.record_batch([pa.array(out[f.name], t) for f, t in zip(_PIECES, _ARROW)], names=list(out))


_PIECE = [("part", "int"), ("start_offset", "int"), ("content_start", "int"), ("end_offset", "int"), ("boundary", "string")]
_PIECES = T.StructType(
    [
        T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("boundaries", T.ArrayType(T.IntegerType())), T.StructField("n_chars", T.IntegerType()),
        T.StructField("pieces", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in _PIECE]))),
    ]
)
_ARROW = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.struct([(n, pa.int32() if k == "int" else pa.string()) for n, k in _PIECE]))]


def split_files(files: DataFrame, limits: DataFrame) -> DataFrame:
    """(file_id, path, boundaries, n_chars, pieces) of each ts or js file longer than its limit.

    `limits` is the small fixed table of limits: applies_to (an extension), max_size and overlap in characters.
    """
    limits = limits.filter("item_kind = 'source_file' AND unit = 'char'").groupBy(F.col("applies_to").alias("language")).agg(F.min("max_size").alias("max_size"), F.min_by("overlap", "max_size").alias("overlap"))
    rows = files.select(F.col("file_id").cast("bigint"), "path", language_of_path(F.col("path")).alias("language"), "source").filter(F.col("source").isNotNull() & F.col("language").isin("ts", "js"))
    return rows.join(limits, "language").filter(F.char_length("source") > F.col("max_size")).mapInArrow(_splitter, _PIECES)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_files(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "size_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("file_id", F.explode("boundaries").alias("start_offset")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces: offsets with and without the repeated overlap, and the level of the boundary each begins at."""
    return _split(spark, sf_dir).select("file_id", F.size("pieces").alias("parts"), F.explode("pieces").alias("p")).select("file_id", "parts", "p.*")


def p3_boundary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces begin at each level of boundary."""
    return p3_pieces(spark, sf_dir).groupBy("boundary").agg(F.count(F.lit(1)).alias("n_pieces"))


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an earlier run cut the oversized files, held against the splitter's boundaries.

    Per chunk and covered range: whether it begins at a natural boundary, how many characters it repeats of what the
    run had covered before, how many it leaves out, and by how many it exceeds the limit.  A null coverage gives no row.
    """
    chunks = table(spark, sf_dir, "writer_chunks").select("chunk_id", "run_id", "file_id", "part", F.explode("coverage").alias("c"))
    ranges = chunks.select("chunk_id", "run_id", "file_id", "part", F.col("c.startOffset").alias("start_offset"), F.col("c.endOffset").alias("end_offset")).distinct()
    before = Window.partitionBy("run_id", "file_id").orderBy("part", "start_offset", "end_offset", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end_offset").over(before)
    limits = table(spark, sf_dir, "size_limits")
    files = split_files(table(spark, sf_dir, "source_files"), limits).select("file_id", "boundaries", language_of_path(F.col("path")).alias("applies_to")).distinct()
    largest = limits.filter("item_kind = 'source_file' AND unit = 'char'").groupBy("applies_to").agg(F.min("max_size").alias("max_size"))
    start, end = F.col("start_offset"), F.col("end_offset")
    return (
        ranges.withColumn("reached", F.coalesce(reached, F.lit(0))).join(files, "file_id").join(largest, "applies_to")
        .select(
            "chunk_id", "run_id", "file_id", "part", "start_offset", "end_offset", ((start == 0) | F.array_contains("boundaries", start)).alias("at_boundary"),
            F.greatest(F.lit(0), F.least(F.col("reached"), end) - start).alias("n_repeated"), F.greatest(F.lit(0), start - F.col("reached")).alias("n_left_out"),
            F.greatest(F.lit(0), end - start - F.col("max_size")).alias("n_over"),
        )
    )


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_boundary_rates": p3_boundary_rates, "p3_chunks": p3_chunks}
SQL: dict[str, str] = {}
