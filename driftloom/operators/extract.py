"""Entities, imports, calls and literals of source files, and the dependencies between them.

Files are parsed where they are read, one pass each; everything after that is joins.  Defined results: null sources, null
paths and other extensions give no row; a file that does not parse gives what stands before the failure, marked as such; a
file without exports is one entity; repeated files give repeated rows; an empty table gives empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.syntax.extract import extract
from driftloom.syntax.grammars import RECURSION

_ENTITY = "struct<id:string,type:string,name:string,signature:string,start_offset:int,end_offset:int,start_line:int,end_line:int,content_hash:string,n_statements:int,side_effects:boolean,refs:array<string>>"
_IMPORT = "struct<local:string,imported:string,module:string,type_only:boolean,external:boolean,referenced:boolean,target:string>"
_CALL = "struct<entity:string,callee:string,root:string,last:string,offset:int>"
_LITERAL = "struct<value:string,role:string,offset:int,entity:string>"
SCHEMA = f"file_id bigint, repo string, path string, parsed boolean, entities array<{_ENTITY}>, imports array<{_IMPORT}>, calls array<{_CALL}>, literals array<{_LITERAL}>"
_KIND = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _arrow(struct: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _KIND[k]) for n, k in (f.split(":", 1) for f in struct.removeprefix("struct<").removesuffix(">").split(","))]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(RECURSION)
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("parsed", "entities", "imports", "calls", "literals")}
        for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "source"))):
            found = extract(text, language, path)
            for k, v in out.items():
                v.append(found[k])
        kinds = {"parsed": pa.bool_(), "entities": _arrow(_ENTITY), "imports": _arrow(_IMPORT), "calls": _arrow(_CALL), "literals": _arrow(_LITERAL)}
        yield pa.record_batch([b.column("file_id"), b.column("repo"), b.column("path"), *[pa.array(out[k], t) for k, t in kinds.items()]], names=["file_id", "repo", "path", *kinds])


def extract_files(files: DataFrame) -> DataFrame:
    """One row per ts or js file of `files` (file_id, repo, path, source): whether it parses, and what it holds."""
    language = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\s*$", 1))
    rows = files.select(F.col("file_id").cast("bigint"), "repo", "path", language.alias("language"), "source")
    return rows.filter(F.col("source").isNotNull() & F.col("language").isin("ts", "js")).mapInArrow(_run, SCHEMA)


def table_of(extracted: DataFrame, name: str) -> DataFrame:
    """One of the extracted arrays as rows."""
    return extracted.select("file_id", "repo", "path", F.explode(name).alias("x")).select("file_id", "repo", "path", "x.*")


def resolved_imports(extracted: DataFrame) -> DataFrame:
    """Imports with `resolved`, the file of the same repository that a relative module names: as written, a declaration or script
    for its source, without an extension, or the index of a folder; null where there is none."""
    imports = table_of(extracted, "imports")
    t = F.col("target")
    stem = F.regexp_replace(t, r"(\.d)?\.[cm]?[jt]s$", "")
    tries = F.array(t, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".js")), F.concat(t, F.lit(".ts")), F.concat(t, F.lit(".js")), F.concat(t, F.lit("/index.ts")), F.concat(t, F.lit("/index.js")))
    asked = imports.filter("target IS NOT NULL").select("repo", "target").distinct().select("repo", "target", F.posexplode(tries).alias("k", "file"))
    files = extracted.select("repo", F.col("path").alias("file")).distinct()
    hit = asked.join(files, ["repo", "file"]).groupBy("repo", "target").agg(F.min_by("file", "k").alias("resolved"))
    return imports.join(hit, ["repo", "target"], "left")


def references(extracted: DataFrame) -> DataFrame:
    """(repo, src, dst): the entities that each symbol refers to, through its imports or in its own file.

    An imported name is the entity exported under it, else the file it comes from; a namespace is that file, and what is called on
    it the entity of that name.  References to itself are left out.
    """
    e = table_of(extracted, "entities")
    refs = e.select("repo", "path", F.col("id").alias("src"), F.explode("refs").alias("local"))
    known = e.select("repo", F.col("id").alias("dst"))
    bound = resolved_imports(extracted).filter("resolved IS NOT NULL").select("repo", "path", "local", "imported", "resolved").distinct()
    through = refs.join(bound, ["repo", "path", "local"]).select("repo", "src", "local", "imported", "resolved")
    wanted = F.concat(F.lit("symbol:"), "resolved", F.lit("#"), "imported")
    named = through.withColumn("dst", wanted).join(known.withColumn("there", F.lit(True)), ["repo", "dst"], "left").select("repo", "src", F.when(F.col("there"), F.col("dst")).otherwise(F.concat(F.lit("file:"), "resolved")).alias("dst"))
    calls = table_of(extracted, "calls").select("repo", "path", F.col("entity").alias("src"), F.col("root").alias("local"), "last")
    member = calls.join(bound.filter("imported = '*'"), ["repo", "path", "local"]).select("repo", "src", F.concat(F.lit("symbol:"), "resolved", F.lit("#"), "last").alias("dst")).join(known, ["repo", "dst"], "left_semi")
    own = refs.join(e.filter("type <> 'file' AND NOT contains(name, '.')").select("repo", "path", F.col("name").alias("local"), F.col("id").alias("dst")), ["repo", "path", "local"]).select("repo", "src", "dst")
    return named.unionByName(member.select("repo", "src", "dst")).unionByName(own).filter("src <> dst").distinct()


def weight(statements: Column, in_degree: Column, effects: Column) -> Column:
    """How much there is to say about a symbol: its statements, its use from elsewhere and whether it acts outside the program."""
    return F.when(effects, 6).otherwise(1) * F.log(statements + F.lit(2.0)) * (1 + 0.5 * F.log(in_degree + F.lit(1.0)))


def role(weight_: Column, minimal: float = 1.0, full: float = 3.0) -> Column:
    return F.when(weight_ < minimal, "one_line").when(weight_ < full, "short_page").otherwise("full_page")


def metrics(extracted: DataFrame, edges: DataFrame, minimal: float = 1.0, full: float = 3.0) -> DataFrame:
    """(repo, path, id, type, n_statements, side_effects, in_degree, weight, role) of every entity.

    Use from the own file and a method's use by its own class do not count.  A file with two or more symbols that have a page has a
    short page itself, else one line.
    """
    e = table_of(extracted, "entities").select("repo", "path", "id", "type", "n_statements", "side_effects").dropDuplicates(["repo", "id"])
    file = lambda c: F.regexp_extract(c, r"^(?:file:|symbol:)([^#]*)", 1)
    used = edges.filter((file("src") != file("dst")) & (F.col("src") != F.regexp_replace("dst", r"\.[^.#]*$", ""))).groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    m = e.join(used, ["repo", "id"], "left").withColumn("in_degree", F.coalesce("n", F.lit(0))).drop("n")
    m = m.withColumn("weight", F.round(weight(F.col("n_statements"), F.col("in_degree"), F.col("side_effects")), 6)).withColumn("own_role", role(F.col("weight"), minimal, full))
    pages = m.filter("type <> 'file' AND own_role <> 'one_line'").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("pages"))
    of_file = F.when(F.coalesce("pages", F.lit(0)) >= 2, "short_page").otherwise("one_line")
    return m.join(pages, ["repo", "path"], "left").select("repo", "path", "id", "type", "n_statements", "side_effects", "in_degree", "weight", F.when(F.col("type") == "file", of_file).otherwise(F.col("own_role")).alias("role"))


#: Blocks that every page has, in the order of all blocks; fixed values.
ALWAYS = ["purpose", "responsibility", "invariants", "limitations"]


def block_inclusion(m: DataFrame, depends: Column, entry: Column | None = None) -> DataFrame:
    """(repo, id, allowed, skipped): the blocks of each entity in their order, and those left out.

    `dependencies` needs something to depend on (`depends`), `workflows` a use from elsewhere or an entry point, `changeGuide` a
    full page.
    """
    from driftloom.functions.blocks import BLOCKS

    test = {"dependencies": F.coalesce(depends, F.lit(False)), "workflows": (F.col("in_degree") > 0) | (F.lit(False) if entry is None else F.coalesce(entry, F.lit(False))), "changeGuide": F.col("role") == "full_page"}
    pick = lambda want: F.array_compact(F.array(*[F.when(test.get(b, F.lit(b in ALWAYS)) == want, F.lit(b)) for b in BLOCKS]))
    return m.select("repo", "id", pick(True).alias("allowed"), pick(False).alias("skipped"))
