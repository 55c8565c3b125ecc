"""Pages, callers, leads, banners and the state of the index as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.ids import canonical_id, path_of_id
from driftloom.plans import drift, snapshots, states
from driftloom.plans.current import CUR, EDGES, SECTIONS, TRIM, _CANON, current_entities, dependency_edges, first_of, sections
from driftloom.plans.drift import _ranges
from driftloom.session import shared_folder
from driftloom.sources.tables import table, table_stream
from driftloom.streaming.change_feed import latest_snapshot, maintain

#: Term groups and the files they hold for, as globs; a null glob holds everywhere.
TERMS = [("entity", None), ("snapshot", "packages/babo-a*/**"), ("lease", "**/*.test.ts"), ("wave", "packages/babo-lumen/src/*/*.js"), ("facet", "packages/babo-vale")]


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``**`` any path, ``*`` within a segment; a plain path also holds below itself."""
    if "*" not in pattern:
        return f"^{_escaped(pattern)}(/.*)?$"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + _escaped(pattern[i]), i + 1
    return f"^{out}$"


def _escaped(s: str) -> str:
    return "".join("\\" + c if c in r"\.+?()[]{}|^$" else c for c in s)


def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that hold for each file, in the order of the settings."""
    files = current_entities(spark, sf_dir, ["path", "type"]).filter("type = 'file' AND path IS NOT NULL").select("repo", "path")
    hit = [F.when(F.lit(True) if g is None else F.col("path").rlike(glob_regex(g)), F.lit(t)) for t, g in TERMS]
    return files.select("repo", "path", F.array_join(F.array_compact(F.array(*hit)), ",").alias("terms"))


def q_doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each source file: without its extension, unless a sibling has the same stem."""
    f = current_entities(spark, sf_dir, ["path", "type"]).filter("type = 'file' AND path IS NOT NULL").select("repo", "path").distinct()
    stem = F.regexp_replace("path", r"\.[jt]s$", "")
    n = F.count(F.lit(1)).over(Window.partitionBy("repo", "stem"))
    return f.withColumn("stem", stem).withColumn("n", n).select("repo", "path", F.concat(F.lit("docs/"), F.when(F.col("n") > 1, F.col("path")).otherwise(F.col("stem")), F.lit(".md")).alias("doc_path"))


def q_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of each section's owner: from the index and as listed with the work item, existing ones only."""
    cur = current_entities(spark, sf_dir, ["directDeps"])
    e = dependency_edges(cur)
    sec = sections(spark, sf_dir, ["entityId", "callers"]).withColumn("id", canonical_id(F.col("entityId")))
    static = sec.select(F.col("repo").alias("owner"), "sectionId", F.col("id").alias("dst")).join(e, ["owner", "dst"]).select(F.col("owner").alias("repo"), "sectionId", F.col("src").alias("caller"), F.lit("static").alias("origin"))
    listed = sec.select("repo", "sectionId", "id", F.explode("callers.id").alias("c")).select("repo", "sectionId", "id", canonical_id(F.col("c")).alias("caller")).filter("caller <> '' AND caller <> id")
    listed = listed.join(cur.select("repo", F.col("id").alias("caller")), ["repo", "caller"], "left_semi").select("repo", "sectionId", "caller", F.lit("listed").alias("origin"))
    both = static.unionByName(listed).distinct()
    return both.groupBy("repo", "sectionId", "caller").agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"))


def q_drop_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages without those that strictly enclose another usage of the same entity in the same file."""
    cur = current_entities(spark, sf_dir, ["path", "type", "range", "directDeps"])
    r = _ranges(cur).select(F.col("repo").alias("owner"), F.col("id").alias("src"), "path", "so", "eo")
    u = dependency_edges(cur).join(r, ["owner", "src"])
    inner = u.select("owner", "dst", "path", F.col("src").alias("inner_src"), F.col("so").alias("a"), F.col("eo").alias("b"))
    wide = u.join(inner, ["owner", "dst", "path"]).filter((F.col("so") <= F.col("a")) & (F.col("b") <= F.col("eo")) & (F.col("eo") - F.col("so") > F.col("b") - F.col("a"))).select("owner", "dst", "src").distinct()
    return u.join(wide, ["owner", "dst", "src"], "left_anti").select("owner", "dst", "src")


def q_first_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each document's first canonical block that has one."""
    t = table(spark, sf_dir, "translate_blocks").filter("canonical AND text IS NOT NULL").select("docPath", "pair_id", F.regexp_replace("text", r"^[\s-]+|\s+$", "").alias("t")).filter("t <> ''")
    return t.groupBy("docPath").agg(F.min_by("t", F.struct("pair_id", "t")).alias("t")).select("docPath", F.left(F.split("t", r"(?<=[.!?])\s+")[0], F.lit(200)).alias("lead"))


def q_first_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot, the ids that were delivered more than once, the first and the number of their rows."""
    return table(spark, sf_dir, "entities").groupBy("repo", "snapshot_no", "id").agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first_loaded")).filter("n > 1")


def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: the newest delivery, when its last row came, and how many rows came after the next delivery began."""
    e = table(spark, sf_dir, "entities").select("repo", "snapshot_no", "snapshot_at", "loaded_at")
    s = e.groupBy("repo", "snapshot_no").agg(F.min("snapshot_at").alias("at"))
    nxt = s.withColumn("next_at", F.lead("at").over(Window.partitionBy("repo").orderBy("snapshot_no"))).select("repo", "snapshot_no", "next_at")
    j = e.join(nxt, ["repo", "snapshot_no"])
    return j.groupBy("repo").agg(F.max("snapshot_no").alias("newest"), F.max("loaded_at").alias("last_loaded"), F.count_if(F.col("loaded_at") > F.col("next_at")).alias("n_late"))


def q_stale_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One banner per section and reason with its blocks in canonical order."""
    m = states.q_stale_merged(spark, sf_dir)
    order = F.array(*[F.lit(b) for b in drift.BLOCKS])
    return m.groupBy("repo", "section", "drift").agg(F.array_join(F.array_intersect(order, F.collect_set("block")), ",").alias("blocks"))


def q_restamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints after a run that kept every block but the deleted: the current one, or the stored where none is current."""
    f = drift.q_block_fingerprint(spark, sf_dir)
    return f.select("repo", "sectionId", "block", F.coalesce("current", "stored").alias("fingerprint"), (F.col("current").isNotNull() & ~F.col("current").eqNullSafe(F.col("stored"))).alias("restamped"))


def q_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sections whose owner was removed in some delivery and is not there now, with that delivery."""
    gone = snapshots.entity_changes(spark, sf_dir).filter("change = 'removed'").groupBy("repo", "id").agg(F.max("snapshot_no").alias("removed_in"))
    return drift.q_stale_deleted(spark, sf_dir).join(sections(spark, sf_dir, ["entityId"]).select("repo", "sectionId", canonical_id(F.col("entityId")).alias("id")), ["repo", "sectionId"]).join(gone, ["repo", "id"]).select("repo", "sectionId", "block", "removed_in")


def q_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity summaries: lines and the numbers of references listed either way."""
    cur = current_entities(spark, sf_dir, ["type", "range", "directDeps", "directUsages"])
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")
    return cur.select("repo", "id", "type", F.coalesce(F.col("range.endLine") - F.col("range.startLine") + 1, F.lit(0)).cast("bigint").alias("n_lines"), n("directDeps").alias("n_deps"), n("directUsages").alias("n_usages"))


def q_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each page by level, and its title."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    marks = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6}) \S"), F.lit(1))
    return d.select("doc_id", F.regexp_extract("text", r"(?m)^# ([^\r\n]*)", 1).alias("title"), F.size(F.filter(marks, lambda m: F.length(m) == 1)).cast("bigint").alias("n_h1"), F.size(F.filter(marks, lambda m: F.length(m) == 2)).cast("bigint").alias("n_h2"))


def q_url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as URL components and back."""
    cur = current_entities(spark, sf_dir, ["type"])
    enc = F.replace(F.url_encode("id"), F.lit("+"), F.lit("%20"))
    return cur.select("repo", "id", enc.alias("component")).withColumn("round_trip", F.url_decode("component") == F.col("id"))


def q_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each entity, kept by a streaming query over the deliveries and read from its last snapshot."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    feed = table_stream(spark, sf_dir, "entities").select("repo", "id", "snapshot_no", "loaded_at", "ord", "contentHash")
    maintain(feed, f"{root}/state", f"{root}/checkpoint", ["repo", "id"], ["snapshot_no", "loaded_at", "ord", "contentHash"]).awaitTermination()
    return latest_snapshot(spark, f"{root}/state").select("repo", "id", "snapshot_no", "contentHash")


_FILES = "files AS (SELECT DISTINCT repo, path FROM cur WHERE type = 'file' AND path IS NOT NULL)"
_OWN = f"{SECTIONS}, owned AS (SELECT *, {_CANON.format(t='t')} AS id FROM (SELECT *, {TRIM.format(c='entityId')} AS t FROM sections))"
_RNG = """rng AS (SELECT repo, path, id, range.startOffset AS so, range.endOffset AS eo FROM cur WHERE range.startLine IS NOT NULL AND range.endLine IS NOT NULL AND range.startOffset IS NOT NULL AND range.endOffset IS NOT NULL AND path IS NOT NULL)"""

QUERIES = {f.__name__: f for f in (q_terms, q_doc_paths, q_callers, q_drop_enclosing, q_first_lead, q_first_duplicate, q_freshness, q_stale_banners, q_restamp, q_tombstones, q_summaries, q_outline, q_url_ids, q_stream_state)}
SQL = {
    "q_terms": f"WITH {CUR}, {_FILES} SELECT repo, path, concat_ws(',', {', '.join(('' if g is None else f"CASE WHEN regexp_matches(path, '{glob_regex(g)}') THEN ") + repr(t) + ('' if g is None else ' END') for t, g in TERMS)}) AS terms FROM files",
    "q_doc_paths": f"WITH {CUR}, {_FILES} SELECT repo, path, 'docs/' || CASE WHEN count(*) OVER (PARTITION BY repo, regexp_replace(path, '\\.[jt]s$', '')) > 1 THEN path ELSE regexp_replace(path, '\\.[jt]s$', '') END || '.md' AS doc_path FROM files",
    "q_callers": f"""WITH {EDGES}, {_OWN}, st AS (SELECT o.repo, o.sectionId, e.src AS caller, 'static' AS origin FROM owned o JOIN edges e ON e.owner = o.repo AND e.dst = o.id),
l AS (SELECT repo, sectionId, id, {_CANON.format(t="t")} AS caller FROM (SELECT repo, sectionId, id, {TRIM.format(c="c")} AS t FROM (SELECT repo, sectionId, id, unnest(list_transform(callers, lambda c: c.id)) AS c FROM owned)) WHERE t <> ''),
al AS (SELECT * FROM st UNION SELECT l.repo, l.sectionId, l.caller, 'listed' FROM l SEMI JOIN cur c ON c.repo = l.repo AND c.id = l.caller WHERE l.caller <> l.id)
SELECT repo, sectionId, caller, string_agg(origin, '+' ORDER BY origin) AS origins FROM al GROUP BY 1, 2, 3""",
    "q_drop_enclosing": f"""WITH {EDGES}, {_RNG}, u AS (SELECT e.owner, e.dst, e.src, r.path, r.so, r.eo FROM edges e JOIN rng r ON r.repo = e.owner AND r.id = e.src)
SELECT owner, dst, src FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.owner = u.owner AND v.dst = u.dst AND v.path = u.path AND u.so <= v.so AND v.eo <= u.eo AND u.eo - u.so > v.eo - v.so)""",
    "q_first_lead": """WITH t AS (SELECT docPath, pair_id, regexp_replace(text, '^[\\s-]+|\\s+$', '', 'g') AS t FROM translate_blocks WHERE canonical AND text IS NOT NULL),
f AS (SELECT docPath, arg_min(t, (pair_id, t)) AS t FROM t WHERE t <> '' GROUP BY 1) SELECT docPath, left(CASE WHEN regexp_matches(t, '[.!?]\\s') THEN regexp_extract(t, '(?s)^(.*?[.!?])\\s', 1) ELSE t END, 200) AS lead FROM f""",
    "q_first_duplicate": "SELECT repo, snapshot_no, id, count(*) AS n, min(loaded_at) AS first_loaded FROM entities GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "q_freshness": """WITH s AS (SELECT repo, snapshot_no, min(snapshot_at) AS t FROM entities GROUP BY 1, 2), x AS (SELECT *, lead(t) OVER (PARTITION BY repo ORDER BY snapshot_no) AS next_t FROM s)
SELECT e.repo, max(e.snapshot_no) AS newest, max(e.loaded_at) AS last_loaded, count(*) FILTER (e.loaded_at > x.next_t) AS n_late FROM entities e JOIN x ON x.repo = e.repo AND x.snapshot_no = e.snapshot_no GROUP BY 1""",
    "q_stale_banners": f"""WITH m AS ({states.SQL["q_stale_merged"]}) SELECT repo, section, drift, string_agg(block, ',' ORDER BY list_position([{", ".join(f"'{b}'" for b in drift.BLOCKS)}], block)) AS blocks FROM m GROUP BY 1, 2, 3""",
    "q_restamp": f"""WITH f AS ({drift.SQL["q_block_fingerprint"]}) SELECT repo, sectionId, block, coalesce(current, stored) AS fingerprint, current IS NOT NULL AND current IS DISTINCT FROM stored AS restamped FROM f""",
    "q_tombstones": f"""WITH d AS ({drift.SQL["q_stale_deleted"]}), g AS (SELECT repo, id, max(snapshot_no) AS removed_in FROM ({snapshots.SQL["p7_found"]}) WHERE change = 'removed' GROUP BY 1, 2), {_OWN}
SELECT d.repo, d.sectionId, d.block, g.removed_in FROM d JOIN owned o ON o.repo = d.repo AND o.sectionId = d.sectionId JOIN g ON g.repo = d.repo AND g.id = o.id""",
    "q_summaries": f"WITH {CUR} SELECT repo, id, type, CAST(coalesce(range.endLine - range.startLine + 1, 0) AS BIGINT) AS n_lines, coalesce(len(directDeps), 0) AS n_deps, coalesce(len(directUsages), 0) AS n_usages FROM cur",
    "q_outline": """WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^(#{1,6}) \\S', 1) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_extract(text, '(?m)^# ([^\\r\\n]*)', 1) AS title, len(list_filter(h, lambda x: length(x) = 1)) AS n_h1, len(list_filter(h, lambda x: length(x) = 2)) AS n_h2 FROM m""",
    "q_url_ids": f"WITH {CUR} SELECT repo, id, url_encode(id) AS component, url_decode(url_encode(id)) = id AS round_trip FROM cur",
    "q_stream_state": "SELECT repo, id, snapshot_no, contentHash FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY snapshot_no DESC, loaded_at DESC, ord DESC, contentHash DESC NULLS LAST) AS rn FROM entities) WHERE rn = 1",
}
