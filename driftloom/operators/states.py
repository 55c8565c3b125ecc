"""States of written blocks: which are stale, unwritten or tombstoned, and what a run does to them.

Tables (all keyed by `repo`):

* entities: id, type, path, name, directDeps; `present` is any table of repo and id.
* sections: sectionId, owner (its first owned id), path (of that entity; null where it is gone), heading, ord, status,
  depDocs and memberDocs (the stamps of what it was written from; null before there were stamps).
* blocks: sectionId, blockId, body, rendered, language, staleSince, staleReason, staleFacets, fingerprint (of the code
  it was written from), depDocs (of the dependency docs it names).
* stale rows: sectionId, blockId, drift, facets (an array).

A blank body is one without anything but white space; a tombstone is a staleSince that is not null.  Functions take and
give such tables; other columns pass through.  Null stamps are not equal to anything: see each function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.blocks import BLOCK_FACETS, BLOCKS
from driftloom.operators.drift import changed_facets

#: Blocks that dependents read as documentation of their dependency; fixed values.
PROPAGATING = ["purpose", "responsibility", "invariants"]
#: Characters of blocks taken per dependency, and of all dependencies of a file; fixed values.
FILE_CAP, TOTAL_CAP = 2500, 15000
#: Names shorter than this are no evidence where they stand alone; fixed value.
SHORT_NAME = 4


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(body: Column) -> Column:
    return F.coalesce(trimmed(body), F.lit("")) == ""


def _known(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("blockId").isin(*BLOCKS))


def _live(blocks: DataFrame) -> DataFrame:
    """Known blocks with text and without a tombstone: what can go stale."""
    return _known(blocks).filter(F.col("staleSince").isNull() & ~is_blank(F.col("body")))


def _stale(rows: DataFrame, drift: str, facets: Column) -> DataFrame:
    return rows.select("repo", "sectionId", "blockId", F.lit(drift).alias("drift"), facets.alias("facets"))


def facets_of(block: Column) -> Column:
    """All facets a block is written from."""
    return reduce(lambda c, b: c.when(block == b, F.array(*[F.lit(f) for f in BLOCK_FACETS[b]])), BLOCKS, F.when(F.lit(False), F.array().cast("array<string>")))


# ---------------------------------------------------------------- detectors


def code_drift(blocks: DataFrame, current: DataFrame) -> DataFrame:
    """Live blocks whose stored fingerprint differs from the current one: the facets that differ, all of the block's where none
    can be compared.  Blocks without a stored fingerprint are not stale; where only the body moved, and to the hash of the
    whole text (`legacy`, as older stamps have it), the code did not change.  `current`: sectionId, blockId, current, legacy."""
    j = _live(blocks).join(current, ["repo", "sectionId", "blockId"]).filter(F.col("fingerprint") != F.col("current"))
    changed = changed_facets(F.col("fingerprint"), F.col("current"))
    stored_body = F.str_to_map("fingerprint", F.lit(","), F.lit("="))["body"]
    only_hash = (F.size(changed) == 1) & (changed[0] == "body") & F.coalesce(stored_body == F.col("legacy"), F.lit(False))
    return _stale(j.filter(~only_hash), "facet_changed", F.when(F.size(changed) > 0, changed).otherwise(facets_of(F.col("blockId"))))


def unwritten(blocks: DataFrame, current: DataFrame) -> DataFrame:
    """Blank blocks without a tombstone whose code is there and is not the code the writer was last asked about."""
    b = _known(blocks).filter(F.col("staleSince").isNull() & is_blank(F.col("body")))
    j = b.join(current.filter("current IS NOT NULL"), ["repo", "sectionId", "blockId"]).filter(~F.col("fingerprint").eqNullSafe(F.col("current")))
    changed = F.coalesce(changed_facets(F.col("fingerprint"), F.col("current")), F.array().cast("array<string>"))
    return _stale(j, "facet_changed", F.when(F.size(changed) > 0, changed).otherwise(facets_of(F.col("blockId"))))


def language_drift(blocks: DataFrame, canonical: str | None) -> DataFrame:
    """Live blocks stamped with a language other than the canonical one; none without a canonical language or a stamp."""
    b = _live(blocks).filter(F.lit(canonical is not None) & (F.col("language") != F.lit(canonical)))
    return _stale(b, "facet_changed", F.array(F.lit("language")))


def tombstoned(blocks: DataFrame, sections: DataFrame, present: DataFrame) -> DataFrame:
    """Known blocks with text and a tombstone; where the owner is gone they count as deleted."""
    gone = sections.join(present.select("repo", F.col("id").alias("owner")), ["repo", "owner"], "left_anti").select("repo", "sectionId", F.lit(True).alias("gone"))
    b = _known(blocks).filter(F.col("staleSince").isNotNull() & ~is_blank(F.col("body"))).join(gone, ["repo", "sectionId"], "left")
    facets = F.when(F.col("gone"), F.array(F.lit("owned"))).otherwise(F.coalesce("staleFacets", facets_of(F.col("blockId"))))
    return b.select("repo", "sectionId", "blockId", F.when(F.col("gone"), "owned_entity_deleted").otherwise("tombstoned").alias("drift"), facets.alias("facets"))


def dependency_docs(edges: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(repo, path, sourcePath, doc): what the sections of each file's dependencies say, as canonical JSON.

    `edges`: repo, path, sourcePath of files.  Rendered propagating blocks are taken in order while they fit `FILE_CAP` characters
    of a dependency, one that does not fit is skipped; dependencies are taken in order of their path up to the first that
    exceeds `TOTAL_CAP`.  A file's blocks are gathered in one row, which the cap bounds.
    """
    order = F.array_position(F.array(*[F.lit(b) for b in PROPAGATING]), F.col("blockId"))
    b = blocks.filter(F.col("blockId").isin(*PROPAGATING) & F.coalesce("rendered", F.lit(False)) & ~is_blank(F.col("body"))).withColumn("o", order)
    s = sections.filter("path IS NOT NULL").select("repo", "sectionId", F.col("path").alias("sourcePath"), "heading", "ord")
    item = F.struct("ord", "sectionId", "o", F.char_length("body").alias("n"), F.coalesce("heading", F.lit("")).alias("heading"), F.struct("blockId", "body").alias("block"))
    rows = b.join(s, ["repo", "sectionId"]).groupBy("repo", "sourcePath").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kind = dict(rows.dtypes)["rows"]
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= FILE_CAP
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    taken = rows.select("repo", "sourcePath", F.aggregate("rows", start, take, lambda a: a["taken"]).alias("rows")).filter("size(rows) > 0")
    ids = F.array_distinct(F.transform("rows", lambda r: r["sectionId"]))
    mine = lambda i: F.filter("rows", lambda r: r["sectionId"] == i)
    parts = F.transform(ids, lambda i: F.struct(mine(i)[0]["heading"].alias("heading"), F.transform(mine(i), lambda r: r["block"]).alias("blocks")))
    docs = taken.select("repo", "sourcePath", parts.alias("sections")).select("repo", "sourcePath", F.to_json(F.struct("sourcePath", "sections")).alias("doc"), F.char_length(F.to_json("sections")).alias("n"))
    w = Window.partitionBy("repo", "path").orderBy("sourcePath").rowsBetween(Window.unboundedPreceding, 0)
    return edges.select("repo", "path", "sourcePath").distinct().join(docs, ["repo", "sourcePath"]).withColumn("used", F.sum("n").over(w)).filter(F.col("used") <= TOTAL_CAP).select("repo", "path", "sourcePath", "doc")


def _stamp(docs: Column) -> Column:
    """The hash of dependency docs, an array of (sourcePath, doc); of none where it is null."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.coalesce(docs, F.array().cast("array<struct<sourcePath:string,doc:string>>"))), lambda d: d["doc"]), ","), F.lit("]")), 256)


def dependency_stamps(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, sectionId, path, current): the hash of all dependency docs of the section's file."""
    f = docs.groupBy("repo", "path").agg(F.collect_list(F.struct("sourcePath", "doc")).alias("d"))
    return sections.filter("path IS NOT NULL").select("repo", "sectionId", "path").join(f, ["repo", "path"], "left").select("repo", "sectionId", "path", _stamp(F.col("d")).alias("current"))


def mention_names(entities: DataFrame) -> DataFrame:
    """(repo, sourcePath, names): the short names of a file's symbols that are long enough to be evidence."""
    short = F.regexp_extract("name", r"([^.]*)$", 1)
    e = entities.filter(F.col("id").startswith("symbol:") & F.col("path").isNotNull()).select("repo", F.col("path").alias("sourcePath"), short.alias("n")).filter(F.char_length("n") >= SHORT_NAME)
    return e.groupBy("repo", "sourcePath").agg(F.sort_array(F.collect_set("n")).alias("names"))


def mentions(body: Column, path: Column, names: Column) -> Column:
    """Whether a text names a file (its path, its name with or without extension) or one of `names`, quoted as code or as a word."""
    base = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(base, r"\.[cm]?[jt]s$", "")
    text = F.coalesce(trimmed(body), F.lit(""))
    words = F.split(text, r"[^A-Za-z0-9_]+")
    known = F.coalesce(names, F.array().cast("array<string>"))
    odd = F.exists(known, lambda n: n.rlike(r"[^A-Za-z0-9_]") & (text.contains(F.concat(F.lit("`"), n, F.lit("`"))) | text.contains(F.concat(F.lit("`"), n, F.lit("("))) | text.contains(F.concat(F.lit("`"), n, F.lit(".")))))
    return (text != "") & (text.contains(path) | text.contains(base) | text.contains(stem) | F.arrays_overlap(known, words) | odd)


def mentioned_docs(blocks: DataFrame, sections: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, sectionId, blockId, sourcePath, doc): the dependency docs that each block's text names."""
    b = blocks.join(sections.select("repo", "sectionId", "path"), ["repo", "sectionId"]).select("repo", "sectionId", "blockId", "body", "path")
    j = b.join(docs, ["repo", "path"]).join(names, ["repo", "sourcePath"], "left")
    return j.filter(mentions(F.col("body"), F.col("sourcePath"), F.col("names"))).select("repo", "sectionId", "blockId", "sourcePath", "doc")


def block_stamps(blocks: DataFrame, sections: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, sectionId, blockId, current): the hash of only the dependency docs that the block names."""
    m = mentioned_docs(blocks, sections, docs, names).groupBy("repo", "sectionId", "blockId").agg(F.collect_list(F.struct("sourcePath", "doc")).alias("d"))
    return blocks.select("repo", "sectionId", "blockId").join(m, ["repo", "sectionId", "blockId"], "left").select("repo", "sectionId", "blockId", _stamp(F.col("d")).alias("current"))


def dependency_drift(sections: DataFrame, blocks: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Live terminal blocks of sections whose dependency docs moved; a block with a stamp of its own is judged by that alone."""
    moved = sections.filter("depDocs IS NOT NULL").select("repo", "sectionId", F.col("depDocs").alias("then")).join(dependency_stamps(sections, docs), ["repo", "sectionId"]).filter("then <> current").select("repo", "sectionId")
    b = _live(blocks).filter(~F.col("blockId").isin(*PROPAGATING)).join(moved, ["repo", "sectionId"], "left_semi")
    now = block_stamps(b, sections, docs, names)
    j = b.join(now, ["repo", "sectionId", "blockId"]).filter("depDocs IS NULL OR depDocs <> current")
    return _stale(j, "facet_changed", F.array(F.lit("depDocs")))


def member_stamps(tiers: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(repo, id, current): the hash of what a tier sums up, for every tier.

    `tiers`: repo, id, type, directDeps.  A domain's members are the sections of its files, the project's those of its domains.
    Each member is hashed first, so that a tier's row holds one hash a member.
    """
    text = lambda b: F.max(F.when((F.col("blockId") == b) & (F.coalesce("body", F.lit("")) != ""), F.col("body")))
    lead = blocks.groupBy("repo", "sectionId").agg(text("purpose").alias("p"), text("responsibility").alias("r"))
    s = sections.join(lead, ["repo", "sectionId"], "left").select("repo", "owner", "path", F.coalesce("heading", F.lit("")).alias("heading"), F.concat_ws(" ", "p", "r").alias("lead"))
    dep = tiers.select("repo", "id", "type", F.explode("directDeps").alias("dep")).distinct()
    domains = dep.filter("type = 'project' AND dep LIKE 'domain:%'").join(s.select("repo", F.col("owner").alias("dep"), "lead"), ["repo", "dep"]).select("repo", "id", F.concat_ws(" - ", "dep", "lead").alias("part"))
    file = F.regexp_extract("dep", r"^(?:file:|symbol:)([^#]*)", 1)
    files = dep.filter("type <> 'project'").withColumn("path", file).filter("path <> ''").join(s, ["repo", "path"]).select("repo", "id", F.concat("path", F.lit(" - "), "heading", F.lit(": "), "lead").alias("part"))
    hashes = domains.unionByName(files).groupBy("repo", "id").agg(F.array_join(F.array_sort(F.collect_list(F.sha2("part", 256))), "\n").alias("t"))
    return tiers.select("repo", "id").join(hashes, ["repo", "id"], "left").select("repo", "id", F.sha2(F.coalesce("t", F.lit("")), 256).alias("current"))


def member_drift(sections: DataFrame, blocks: DataFrame, stamps: DataFrame) -> DataFrame:
    """Live blocks of tiers whose members say something else than when the tier was written."""
    moved = sections.filter("memberDocs IS NOT NULL").join(stamps.withColumnRenamed("id", "owner"), ["repo", "owner"]).filter("memberDocs <> current").select("repo", "sectionId")
    return _stale(_live(blocks).join(moved, ["repo", "sectionId"], "left_semi"), "facet_changed", F.array(F.lit("memberDocs")))


def tier_slugs(*passes: DataFrame) -> DataFrame:
    """(repo, slug): domains with a stale or unwritten block, '.' for the project."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("repo", "sectionId") for p in passes])
    slug = F.when(F.col("sectionId").startswith("domain:"), F.substring("sectionId", 8, 1 << 20)).when(F.col("sectionId").startswith("project:"), ".")
    return rows.select("repo", slug.alias("slug")).filter("slug IS NOT NULL").distinct()


def stale_reason(drift: Column, facets: Column) -> Column:
    """owned_entity_deleted, <facet>_changed where one facet changed, else code_changed."""
    return F.when(drift == "owned_entity_deleted", drift).when(F.size(facets) == 1, F.concat(facets[0], F.lit("_changed"))).otherwise("code_changed")


# ---------------------------------------------------------------- what a run does


def _update(blocks: DataFrame, rows: DataFrame, sets: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Blocks with the columns of `sets` set where `rows` (one per block) has the block and `when` holds; `hit` says where."""
    j = blocks.join(rows.withColumn("_hit", F.lit(True)), ["repo", "sectionId", "blockId"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    return j.withColumn("_hit", hit).select(*[F.when(F.col("_hit"), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in blocks.columns], F.col("_hit").alias("hit"))


def apply_tombstones(blocks: DataFrame, stale: DataFrame, since: Column) -> DataFrame:
    """Blocks with staleSince, staleReason and staleFacets set where `stale` (one row per block) has them."""
    return _update(blocks, stale.select("repo", "sectionId", "blockId", "drift", "facets"), {"staleSince": since, "staleReason": stale_reason(F.col("drift"), F.col("facets")), "staleFacets": F.col("facets")})


def section_status(sections: DataFrame, blocks: DataFrame, written: bool = False) -> DataFrame:
    """Sections with their status: stale where all blocks are, else normal.  A review stays needed unless new text was written."""
    b = blocks.groupBy("repo", "sectionId").agg(F.bool_and(F.col("staleSince").isNotNull()).alias("_all"))
    status = F.when(F.coalesce("_all", F.lit(False)), "stale").otherwise("normal")
    if not written:
        status = F.when(F.col("status") == "review_needed", F.col("status")).otherwise(status)
    return sections.join(b, ["repo", "sectionId"], "left").withColumn("status", status).drop("_all")


def restore_kept(blocks: DataFrame, kept: DataFrame, current: DataFrame) -> DataFrame:
    """Tombstoned blocks that a run kept lose the tombstone and take the current fingerprint where there is one."""
    rows = kept.select("repo", "sectionId", "blockId").distinct().join(current.select("repo", "sectionId", "blockId", "current"), ["repo", "sectionId", "blockId"], "left")
    none = {"staleSince": F.lit(None), "staleReason": F.lit(None), "staleFacets": F.lit(None)}
    return _update(blocks, rows, none | {"fingerprint": F.coalesce("current", "fingerprint")}, F.col("staleSince").isNotNull())


def stamp_declined(blocks: DataFrame, declined: DataFrame, current: DataFrame) -> DataFrame:
    """Blank blocks that the writer declined take the current fingerprint, so that they fall silent until the code moves."""
    rows = declined.select("repo", "sectionId", "blockId").distinct().join(current.select("repo", "sectionId", "blockId", "current"), ["repo", "sectionId", "blockId"])
    return _update(blocks, rows, {"fingerprint": F.col("current")}, is_blank(F.col("body")) & F.col("current").isNotNull())


def record_dependencies(sections: DataFrame, blocks: DataFrame, docs: DataFrame, names: DataFrame, written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections just written, and their blocks with text, take the stamps of the dependency docs they were written from."""
    mine = sections.filter("path IS NOT NULL").join(written.select("repo", "sectionId").distinct(), ["repo", "sectionId"], "left_semi")
    now = dependency_stamps(mine, docs).select("repo", "sectionId", "current")
    s = sections.join(now, ["repo", "sectionId"], "left").withColumn("depDocs", F.coalesce("current", "depDocs")).drop("current")
    b = blocks.join(mine.select("repo", "sectionId"), ["repo", "sectionId"], "left_semi").filter(~is_blank(F.col("body")))
    return s, _update(blocks, block_stamps(b, sections, docs, names), {"depDocs": F.col("current")}).drop("hit")


def backfill_dependencies(sections: DataFrame, blocks: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks with text and no stamp take one where their section's stamp is still current."""
    same = sections.filter("depDocs IS NOT NULL").select("repo", "sectionId", F.col("depDocs").alias("then")).join(dependency_stamps(sections, docs), ["repo", "sectionId"]).filter("then = current").select("repo", "sectionId")
    b = blocks.filter(F.col("depDocs").isNull() & ~is_blank(F.col("body"))).join(same, ["repo", "sectionId"], "left_semi")
    return _update(blocks, block_stamps(b, sections, docs, names), {"depDocs": F.col("current")})


def stamp_members(sections: DataFrame, stamps: DataFrame, answered: DataFrame) -> DataFrame:
    """Sections of tiers that the writer answered for take the stamp of their members; the others keep theirs and are asked again."""
    now = stamps.join(answered.select("repo", "id").distinct(), ["repo", "id"], "left_semi").select("repo", F.col("id").alias("owner"), "current")
    return sections.join(now, ["repo", "owner"], "left").withColumn("memberDocs", F.coalesce("current", "memberDocs")).drop("current")


def render_decision(blocks: DataFrame, min_score: float = 0.5, overrides: dict[str, float] | None = None) -> DataFrame:
    """Blocks with `rendered` decided: never without text (which also clears a tombstone), as before without scores, else where the
    least score reaches the block's threshold: its override, 0 for purpose and responsibility, or `min_score`."""
    score = F.least("scores.informativeness", "scores.novelty", "scores.specificity")
    least = reduce(lambda c, kv: c.when(F.col("blockId") == kv[0], F.lit(float(kv[1]))), (overrides or {}).items(), F.when(F.lit(False), F.lit(0.0)))
    threshold = least.when(F.col("blockId").isin("purpose", "responsibility"), F.lit(0.0)).otherwise(F.lit(float(min_score)))
    blank = is_blank(F.col("body"))
    out = {"rendered": F.when(blank, F.lit(False)).when(F.col("scores").isNull(), F.col("rendered")).otherwise(score >= threshold)}
    out |= {c: F.when(~blank, F.col(c)) for c in ("staleSince", "staleReason", "staleFacets")}
    return blocks.select(*[out[c].alias(c) if c in out else F.col(c) for c in blocks.columns])


def filtered_blocks(blocks: DataFrame, min_score: float = 0.5, overrides: dict[str, float] | None = None) -> DataFrame:
    """Scored blocks that are not rendered, with their least score and the override or `min_score`, also where the decision used 0."""
    threshold = reduce(lambda c, kv: c.when(F.col("blockId") == kv[0], F.lit(float(kv[1]))), (overrides or {}).items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(float(min_score)))
    b = blocks.filter(F.col("scores").isNotNull() & ~F.coalesce("rendered", F.lit(False)))
    return b.select("repo", "sectionId", "blockId", F.least("scores.informativeness", "scores.novelty", "scores.specificity").alias("finalScore"), threshold.alias("threshold"))


def in_scope(sections: DataFrame, section_ids: list[str], files: list[str], prefixes: list[str]) -> DataFrame:
    """Sections named, or whose owner's file is named or lies under a prefix; an empty scope is no filter.  A gone owner counts by
    the path in its id."""
    if not (section_ids or files or prefixes):
        return sections
    path = F.coalesce("path", F.regexp_extract("owner", r"^(?:file:|symbol:)([^#]*)", 1))
    under = reduce(lambda a, p: a | (path == p) | path.startswith(p.rstrip("/") + "/"), prefixes, F.lit(False))
    return sections.filter(F.col("sectionId").isin(section_ids) | path.isin(files) | under)


def narrow_targets(targets: DataFrame, section_ids: DataFrame, blocks: list[str]) -> DataFrame:
    """(repo, sectionId, blocks): the targets of each section that were asked for, all that were asked for where it has none."""
    asked = F.array(*[F.lit(b) for b in blocks])
    j = section_ids.select("repo", "sectionId").join(targets.select("repo", "sectionId", "blocks"), ["repo", "sectionId"], "left")
    kept = F.when(F.col("blocks").isNull(), asked).otherwise(F.array_intersect("blocks", asked))
    return j.select("repo", "sectionId", kept.alias("blocks")).filter("size(blocks) > 0")
