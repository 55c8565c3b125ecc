"""Domain maps: coverage, first-wins assignment, tiers, validation and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.blocks import BLOCKS
from driftloom.functions.ids import canonical_id, path_of_id
from driftloom.plans.current import CUR, DOMAINS, EDGES, SECTIONS, TRIM, _CANON, current_domains, current_entities, dependency_edges, sections
from driftloom.plans.drift import _blocks, _owned, q_stale_ast
from driftloom.plans.drift import SQL as DRIFT_SQL


def _documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file): files of the newest index."""
    return current_entities(spark, sf_dir, ["path", "type"]).filter("type = 'file'").select("repo", F.col("path").alias("file"))


def q_domain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a domain, with several, and files of the map that the index does not hold."""
    files, d = _documented(spark, sf_dir), current_domains(spark, sf_dir)
    uncovered = files.join(d.select("repo", "file").distinct(), ["repo", "file"], "left_anti").select("repo", "file", F.lit("uncovered").alias("issue"), F.lit("").alias("slugs"))
    several = d.groupBy("repo", "file").agg(F.array_sort(F.collect_set("slug")).alias("s")).filter("size(s) > 1").select("repo", "file", F.lit("double").alias("issue"), F.array_join("s", ",").alias("slugs"))
    dangling = d.join(files, ["repo", "file"], "left_anti").select("repo", "file", F.lit("dangling").alias("issue"), F.col("slug").alias("slugs"))
    return uncovered.unionByName(several).unionByName(dangling)


def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each file: the first in the order of the map."""
    return current_domains(spark, sf_dir).groupBy("repo", "file").agg(F.min_by("slug", F.struct("domain_ord", "file_ord", "slug")).alias("slug"))


def q_domain_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier entities: member files that exist, their number, and a placement hash over them; empty domains are left out."""
    members = q_first_wins(spark, sf_dir).join(_documented(spark, sf_dir), ["repo", "file"], "left_semi")
    return members.groupBy("repo", "slug").agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(F.array_sort(F.collect_list("file")), "|"), 256).alias("placement_facet"))


def q_member_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain, the sorted lines about its members' sections and a fingerprint of them."""
    s = sections(spark, sf_dir, ["entityId", "heading"]).select("repo", path_of_id(canonical_id(F.col("entityId"))).alias("file"), F.concat_ws("|", "sectionId", F.coalesce("heading", F.lit(""))).alias("line"))
    m = s.join(q_first_wins(spark, sf_dir), ["repo", "file"])
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return m.groupBy("repo", "slug").agg(F.count(F.lit(1)).alias("n_sections"), F.sha2(text, 256).alias("fingerprint"))


def q_coverage_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: files, files in a domain, and files with a section."""
    files = _documented(spark, sf_dir)
    d = current_domains(spark, sf_dir).select("repo", "file").distinct().withColumn("in_domain", F.lit(1))
    s = sections(spark, sf_dir, ["entityId"]).select("repo", path_of_id(canonical_id(F.col("entityId"))).alias("file")).distinct().withColumn("has_section", F.lit(1))
    j = files.join(d, ["repo", "file"], "left").join(s, ["repo", "file"], "left")
    return j.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.count("in_domain").alias("n_mapped"), F.count("has_section").alias("n_documented"))


def q_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: sections, sections with a stale block, and its status."""
    files = _documented(spark, sf_dir)
    s = sections(spark, sf_dir, ["entityId"]).select("repo", "sectionId", path_of_id(canonical_id(F.col("entityId"))).alias("file"))
    stale = q_stale_ast(spark, sf_dir).select("repo", "sectionId").distinct().withColumn("stale", F.lit(1))
    n = s.join(stale, ["repo", "sectionId"], "left").groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n_sections"), F.count("stale").alias("n_stale"))
    j = files.join(n, ["repo", "file"], "left").select("repo", "file", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_stale", F.lit(0)).alias("n_stale"))
    return j.withColumn("status", F.when(F.col("n_sections") == 0, "pending").when(F.col("n_stale") > 0, "stale").otherwise("documented"))


def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity issues of the sections: owner gone, dependency that is neither entity nor section, unknown or forbidden block."""
    sec = _owned(spark, sf_dir)
    cur = current_entities(spark, sf_dir, ["type"]).select("repo", "id")
    owner = sec.join(cur, ["repo", "id"], "left_anti").select("repo", "sectionId", F.lit("stale_owned_entity").alias("issue"), F.col("id").alias("detail"))
    dep = sec.select("repo", "sectionId", F.explode("dependencyEntityIds").alias("r")).select("repo", "sectionId", F.regexp_replace(canonical_id(F.col("r")), "^section:", "").alias("id")).filter("id <> ''").distinct()
    known = cur.unionByName(sec.select("repo", F.col("sectionId").alias("id"))).distinct()
    broken = dep.join(known, ["repo", "id"], "left_anti").select("repo", "sectionId", F.lit("broken_dependency").alias("issue"), F.col("id").alias("detail"))
    all_blocks = sections(spark, sf_dir, ["allowedBlocks", "targetBlocks"]).select("repo", "sectionId", "allowedBlocks", F.explode("targetBlocks").alias("block"))
    allowed = F.coalesce(F.array_contains("allowedBlocks", F.col("block")), F.lit(False))
    forbidden = all_blocks.filter(~allowed).select("repo", "sectionId", F.when(F.col("block").isin(*BLOCKS), "block_not_allowed").otherwise("unknown_block").alias("issue"), F.col("block").alias("detail")).distinct()
    return owner.unionByName(broken).unionByName(forbidden)


def q_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with and without a section, per repository and type."""
    cur = current_entities(spark, sf_dir, ["type"]).select("repo", "id", "type")
    own = sections(spark, sf_dir, ["entityId"]).select("repo", canonical_id(F.col("entityId")).alias("id")).distinct()
    a = cur.join(own, ["repo", "id"], "left_semi").withColumn("documented", F.lit(True))
    b = cur.join(own, ["repo", "id"], "left_anti").withColumn("documented", F.lit(False))
    return a.unionByName(b).groupBy("repo", "type", "documented").agg(F.count(F.lit(1)).alias("n"))


def q_resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target blocks in canonical order, narrowed to those allowed; sections left without any are marked."""
    s = sections(spark, sf_dir, ["allowedBlocks", "targetBlocks"])
    order = F.array(*[F.lit(b) for b in BLOCKS])
    allowed = F.when(F.size(F.coalesce("allowedBlocks", F.array().cast("array<string>"))) == 0, order).otherwise(F.col("allowedBlocks"))
    eff = F.filter(order, lambda b: F.array_contains(allowed, b) & F.coalesce(F.array_contains("targetBlocks", b), F.lit(False)))
    return s.select("repo", "sectionId", F.array_join(eff, ",").alias("blocks"), (F.size(eff) == 0).alias("skipped"))


def q_affected_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain: what its entities depend on outside it, and how many of its dependencies stay inside."""
    cur = current_entities(spark, sf_dir, ["path", "directDeps"])
    e = dependency_edges(cur)
    dom = q_first_wins(spark, sf_dir)
    at = cur.select("repo", "id", F.col("path").alias("file")).join(dom, ["repo", "file"]).select(F.col("repo").alias("owner"), "id", "slug")
    j = e.join(at.select("owner", F.col("id").alias("src"), F.col("slug").alias("a")), ["owner", "src"]).join(at.select("owner", F.col("id").alias("dst"), F.col("slug").alias("b")), ["owner", "dst"])
    return j.groupBy(F.col("owner").alias("repo"), F.col("a").alias("slug")).agg(F.count_if(F.col("a") == F.col("b")).alias("n_inside"), F.count_if(F.col("a") != F.col("b")).alias("n_outside"), F.countDistinct(F.when(F.col("a") != F.col("b"), F.col("b"))).alias("n_domains"))


_DOCD = f"{CUR}, {DOMAINS}, files AS (SELECT repo, path AS file FROM cur WHERE type = 'file')"
_FIRST = "first_dom AS (SELECT repo, file, arg_min(slug, (domain_ord, file_ord, slug)) AS slug FROM domains GROUP BY 1, 2)"
_OWN = f"{SECTIONS}, owned AS (SELECT *, {_CANON.format(t='t')} AS id FROM (SELECT *, {TRIM.format(c='entityId')} AS t FROM sections))"
_PATH = "regexp_extract({c}, '^(?:file:|symbol:)([^#]*)', 1)"
_ORDER = "[" + ", ".join(f"'{b}'" for b in BLOCKS) + "]"

QUERIES = {f.__name__: f for f in (q_domain_coverage, q_first_wins, q_domain_entities, q_member_evidence, q_coverage_line, q_file_nodes, q_validate, q_prepare, q_resolve_targets, q_affected_domains)}
SQL = {
    "q_domain_coverage": f"""WITH {_DOCD} SELECT f.repo, f.file, 'uncovered' AS issue, '' AS slugs FROM files f ANTI JOIN domains d ON d.repo = f.repo AND d.file = f.file
UNION ALL SELECT repo, file, 'double', string_agg(DISTINCT slug, ',' ORDER BY slug) FROM domains GROUP BY 1, 2 HAVING count(DISTINCT slug) > 1
UNION ALL SELECT d.repo, d.file, 'dangling', d.slug FROM domains d ANTI JOIN files f ON d.repo = f.repo AND d.file = f.file""",
    "q_first_wins": f"WITH {DOMAINS}, {_FIRST} SELECT repo, file, slug FROM first_dom",
    "q_domain_entities": f"WITH {_DOCD}, {_FIRST} SELECT d.repo, d.slug, count(*) AS n_files, sha256(string_agg(d.file, '|' ORDER BY d.file)) AS placement_facet FROM first_dom d SEMI JOIN files f ON f.repo = d.repo AND f.file = d.file GROUP BY 1, 2",
    "q_member_evidence": f"""WITH {DOMAINS}, {_FIRST}, {_OWN}, l AS (SELECT repo, {_PATH.format(c="id")} AS file, sectionId || '|' || coalesce(heading, '') AS line FROM owned)
SELECT l.repo, d.slug, count(*) AS n_sections, sha256(string_agg(l.line, chr(10) ORDER BY l.line)) AS fingerprint FROM l JOIN first_dom d ON d.repo = l.repo AND d.file = l.file GROUP BY 1, 2""",
    "q_coverage_line": f"""WITH {_DOCD}, {_OWN}, d AS (SELECT DISTINCT repo, file FROM domains), s AS (SELECT DISTINCT repo, {_PATH.format(c="id")} AS file FROM owned)
SELECT f.repo, count(*) AS n_files, count(d.file) AS n_mapped, count(s.file) AS n_documented FROM files f LEFT JOIN d ON d.repo = f.repo AND d.file = f.file LEFT JOIN s ON s.repo = f.repo AND s.file = f.file GROUP BY 1""",
    "q_file_nodes": f"""WITH {_DOCD}, {_OWN}, st AS (SELECT DISTINCT repo, sectionId FROM ({DRIFT_SQL["q_stale_ast"]})),
n AS (SELECT o.repo, {_PATH.format(c="o.id")} AS file, count(*) AS n_sections, count(st.sectionId) AS n_stale FROM owned o LEFT JOIN st ON st.repo = o.repo AND st.sectionId = o.sectionId GROUP BY 1, 2)
SELECT f.repo, f.file, coalesce(n_sections, 0) AS n_sections, coalesce(n_stale, 0) AS n_stale, CASE WHEN coalesce(n_sections, 0) = 0 THEN 'pending' WHEN n_stale > 0 THEN 'stale' ELSE 'documented' END AS status
FROM files f LEFT JOIN n ON n.repo = f.repo AND n.file = f.file""",
    "q_validate": f"""WITH {CUR}, {_OWN}, dep AS (SELECT DISTINCT repo, sectionId, regexp_replace({_CANON.format(t="t")}, '^section:', '') AS id FROM (SELECT repo, sectionId, {TRIM.format(c="r")} AS t FROM (SELECT repo, sectionId, unnest(dependencyEntityIds) AS r FROM sections)) WHERE t <> ''),
known AS (SELECT repo, id FROM cur UNION SELECT repo, sectionId FROM sections), tb AS (SELECT DISTINCT repo, sectionId, block FROM (SELECT repo, sectionId, allowedBlocks, unnest(targetBlocks) AS block FROM sections) WHERE NOT coalesce(list_contains(allowedBlocks, block), false))
SELECT o.repo, o.sectionId, 'stale_owned_entity' AS issue, o.id AS detail FROM owned o ANTI JOIN cur c ON c.repo = o.repo AND c.id = o.id
UNION ALL SELECT d.repo, d.sectionId, 'broken_dependency', d.id FROM dep d ANTI JOIN known k ON k.repo = d.repo AND k.id = d.id
UNION ALL SELECT repo, sectionId, CASE WHEN list_contains({_ORDER}, block) THEN 'block_not_allowed' ELSE 'unknown_block' END, block FROM tb""",
    "q_prepare": f"WITH {CUR}, {_OWN}, o AS (SELECT DISTINCT repo, id FROM owned) SELECT c.repo, c.type, o.id IS NOT NULL AS documented, count(*) AS n FROM cur c LEFT JOIN o ON o.repo = c.repo AND o.id = c.id GROUP BY 1, 2, 3",
    "q_resolve_targets": f"""WITH {SECTIONS}, e AS (SELECT repo, sectionId, list_filter({_ORDER}, lambda b: (coalesce(len(allowedBlocks), 0) = 0 OR list_contains(allowedBlocks, b)) AND coalesce(list_contains(targetBlocks, b), false)) AS x FROM sections)
SELECT repo, sectionId, array_to_string(x, ',') AS blocks, len(x) = 0 AS skipped FROM e""",
    "q_affected_domains": f"""WITH {EDGES}, {DOMAINS}, {_FIRST}, at_ AS (SELECT c.repo, c.id, f.slug FROM cur c JOIN first_dom f ON f.repo = c.repo AND f.file = c.path)
SELECT e.owner AS repo, a.slug, count(*) FILTER (a.slug = b.slug) AS n_inside, count(*) FILTER (a.slug <> b.slug) AS n_outside, count(DISTINCT b.slug) FILTER (a.slug <> b.slug) AS n_domains
FROM edges e JOIN at_ a ON a.repo = e.owner AND a.id = e.src JOIN at_ b ON b.repo = e.owner AND b.id = e.dst GROUP BY 1, 2""",
}
