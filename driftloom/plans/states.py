"""The states of the written sections: what is stale by every detector, what is unwritten, and what a run would set.

The tables hold work items, not block states, so states are projected from them: a block the newest item of a section asked
for has a text that names its snapshot and its first dependency, one that is only allowed is blank; an item that came more than
`LATE` after it was written is tombstoned since then; the oldest item of each section is what its dependents were written from.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.blocks import BLOCK_FACETS, BLOCKS, FACETS
from driftloom.functions.ids import canonical_id
from driftloom.operators import graphs as G
from driftloom.operators import states as S
from driftloom.operators.drift import block_fingerprint, facet_hashes, merge_passes
from driftloom.plans.current import CUR, EDGES, TRIM, _CANON, current_entities, dependency_edges, first_of
from driftloom.plans.drift import _PAST, _fp, _now, _past
from driftloom.session import cut_step
from driftloom.sources.tables import table

LATE = "INTERVAL 12 HOURS"
LANGUAGE = "en"


def _versions(spark: SparkSession, sf_dir: str, newest: bool) -> DataFrame:
    """The newest or the oldest work item of each section."""
    w = table(spark, sf_dir, "write_sections")
    order = [F.desc("created_at"), F.desc("section_row_id")] if newest else ["created_at", "section_row_id"]
    cols = ["repo", "sectionId", "snapshot_no", "heading", "created_at", "ingested_at", "section_row_id", "entityId", "allowedBlocks", "targetBlocks", "dependencyEntityIds"]
    return first_of(w.select(*cols), ["repo", "sectionId"], order).withColumn("owner", canonical_id(F.col("entityId")))


def _sections(v: DataFrame, entities: DataFrame) -> DataFrame:
    path = entities.select("repo", F.col("id").alias("owner"), "path")
    none = F.lit(None).cast("string")
    return v.join(path, ["repo", "owner"], "left").select("repo", "sectionId", "owner", "path", "heading", F.col("section_row_id").alias("ord"), F.lit("normal").alias("status"), none.alias("depDocs"), none.alias("memberDocs"))


def _blocks(v: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    asked = F.array_contains(F.coalesce("targetBlocks", empty), F.col("blockId"))
    first = F.regexp_extract(F.coalesce(F.try_element_at("dependencyEntityIds", F.lit(1)), F.lit("")), r"([^.#/]*)$", 1)
    text = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), "blockId", F.lit(" of snapshot "), F.col("snapshot_no").cast("string"), F.lit(" uses `"), first, F.lit("`."))
    late = F.col("ingested_at") > F.col("created_at") + F.expr(LATE)
    none = F.lit(None).cast("string")
    b = v.withColumn("blockId", F.explode(F.array_union(F.coalesce("targetBlocks", empty), F.coalesce("allowedBlocks", empty)))).filter(F.col("blockId").isin(*BLOCKS))
    return b.select(
        "repo", "sectionId", "blockId", F.when(asked, text).otherwise("").alias("body"), asked.alias("rendered"), none.alias("language"), F.when(late, F.col("ingested_at")).alias("staleSince"),
        F.when(late, "code_changed").alias("staleReason"), F.lit(None).cast("array<string>").alias("staleFacets"), none.alias("depDocs"),
    )


class _State:
    """The tables that the detectors read.  What several detectors share is written once to the checkpoint folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.entities = cut_step(current_entities(spark, sf_dir, ["path", "type", "name", "directDeps"]))
        self.old, self.new = cut_step(_versions(spark, sf_dir, False)), cut_step(_versions(spark, sf_dir, True))
        self.sections, self.plain = _sections(self.new, self.entities), _blocks(self.new)

    @cached_property
    def _fingerprints(self) -> DataFrame:
        """(repo, sectionId, blockId, stored, current, legacy): null where the owner is not there."""
        v = self.new.select("repo", "sectionId", "snapshot_no", F.col("owner").alias("id"))
        keys = ["repo", "sectionId"]
        stored = facet_hashes(v.join(_past(self.spark, self.sf_dir, v), ["repo", "snapshot_no", "id"]), keys)
        now = v.select(*keys, "id").join(_now(self.spark, self.sf_dir), ["repo", "id"])
        legacy = now.select(*keys, F.sha2(F.concat_ws("|", "id", F.coalesce("content", F.lit(""))), 256).alias("legacy"))
        one = lambda name: F.when(F.col("signature").isNotNull(), block_fingerprint(F.col("blockId"))).alias(name)
        b = self.plain.select(*keys, "blockId").join(stored, keys, "left").select(*keys, "blockId", one("stored"))
        return cut_step(b.join(facet_hashes(now, keys), keys, "left").select(*keys, "blockId", "stored", one("current")).join(legacy, keys, "left"))

    def blocks(self) -> DataFrame:
        return self.plain.join(self._fingerprints.select("repo", "sectionId", "blockId", F.col("stored").alias("fingerprint")), ["repo", "sectionId", "blockId"], "left")

    def current(self) -> DataFrame:
        return self._fingerprints.select("repo", "sectionId", "blockId", "current", "legacy")

    @cached_property
    def _edges(self) -> DataFrame:
        """(repo, path, sourcePath): which file depends on which."""
        files = self.entities.select(F.col("repo").alias("owner"), F.col("id").alias("node"), F.col("path").alias("grp")).filter("grp IS NOT NULL")
        return cut_step(G.quotient_edges(dependency_edges(self.entities), files).select(F.col("owner").alias("repo"), F.col("src").alias("path"), F.col("dst").alias("sourcePath")))

    @lru_cache(4)  # noqa: B019
    def docs(self, newest: bool) -> DataFrame:
        """Dependency docs of every file, from the newest or the oldest text of the sections."""
        v = self.new if newest else self.old
        return cut_step(S.dependency_docs(self._edges, _sections(v, self.entities), _blocks(v)))

    @lru_cache(4)  # noqa: B019
    def names(self) -> DataFrame:
        return S.mention_names(self.entities)

    def recorded(self) -> tuple[DataFrame, DataFrame]:
        """Sections and blocks with the stamps of the dependency docs as they were."""
        return S.record_dependencies(self.sections, self.plain, self.docs(False), self.names(), self.sections)

    def members(self, newest: bool) -> DataFrame:
        deps = F.filter(F.transform(F.coalesce("directDeps", F.array().cast("array<string>")), canonical_id), lambda x: F.coalesce(x, F.lit("")) != "")
        tiers = self.entities.filter("type IN ('domain', 'project')").select("repo", "id", "type", deps.alias("directDeps"))
        v = self.new if newest else self.old
        return S.member_stamps(tiers, _sections(v, self.entities), _blocks(v))

    def passes(self) -> dict[str, DataFrame]:
        gone = self.sections.join(self.entities.select("repo", F.col("id").alias("owner")), ["repo", "owner"], "left_anti")
        sections, blocks = self.recorded()
        tiers = self.sections.drop("memberDocs").join(self.members(False).select("repo", F.col("id").alias("owner"), F.col("current").alias("memberDocs")), ["repo", "owner"], "left")
        return {
            "code": S.code_drift(self.blocks(), self.current()),
            "deleted": S._stale(S._live(self.plain).join(gone.select("repo", "sectionId"), ["repo", "sectionId"], "left_semi"), "owned_entity_deleted", F.array(F.lit("owned"))),
            "dependencies": S.dependency_drift(sections, blocks, self.docs(True), self.names()),
            "members": S.member_drift(tiers, self.plain, self.members(True)),
        }

    @lru_cache(4)  # noqa: B019
    def merged(self) -> DataFrame:
        order = ["code", "deleted", "dependencies", "members"]
        p = self.passes()
        rows = [p[k].select("repo", F.col("sectionId").alias("section"), F.col("blockId").alias("block"), "drift", "facets") for k in order]
        return merge_passes(*rows).select("repo", F.col("section").alias("sectionId"), F.col("block").alias("blockId"), "drift", "facets")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "sectionId", "blockId", "drift", F.array_join("facets", ",").alias("facets"))


def q_dependency_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency docs of every file, by their hash and length."""
    return _State(spark, sf_dir).docs(True).select("repo", "path", "sourcePath", F.sha2("doc", 256).alias("doc_hash"), F.char_length("doc").cast("bigint").alias("n_chars"))


def q_block_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependencies that each written block's text names."""
    s = _State(spark, sf_dir)
    return S.mentioned_docs(s.plain, s.sections, s.docs(True), s.names()).select("repo", "sectionId", "blockId", "sourcePath")


def q_stale_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose dependencies' documentation moved since they were written."""
    s = _State(spark, sf_dir)
    return _flat(S.dependency_drift(*s.recorded(), s.docs(True), s.names()))


def q_stale_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of tiers whose members say something else."""
    return _flat(_State(spark, sf_dir).passes()["members"])


def q_language_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts written in another language than the canonical one."""
    t = table(spark, sf_dir, "translate_blocks").filter("canonical")
    none = F.lit(None).cast("string")
    b = t.select(F.col("docPath").alias("repo"), "sectionId", "blockId", F.col("text").alias("body"), "language", none.alias("staleSince"))
    return _flat(S.language_drift(b, LANGUAGE)).withColumnRenamed("repo", "docPath").distinct()


def q_unwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank blocks whose code moved since the writer was asked."""
    s = _State(spark, sf_dir)
    return _flat(S.unwritten(s.blocks(), s.current()))


def q_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _State(spark, sf_dir)
    return _flat(S.tombstoned(s.plain, s.sections, s.entities))


def q_stale_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors merged per block: facets united, the first drift kept."""
    return _State(spark, sf_dir).merged().select("repo", F.col("sectionId").alias("section"), F.col("blockId").alias("block"), "drift", F.array_join("facets", ",").alias("facets"))


def q_tier_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _State(spark, sf_dir)
    return S.tier_slugs(s.merged(), S.unwritten(s.blocks(), s.current()))


def q_apply_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after a run that tombstones all that is stale, at the time of the newest arrival."""
    s = _State(spark, sf_dir)
    since = table(spark, sf_dir, "write_sections").agg(F.max("ingested_at").alias("since"))
    b = S.apply_tombstones(s.plain.crossJoin(F.broadcast(since)), s.merged(), F.col("since"))  # one row
    return b.select("repo", "sectionId", "blockId", "staleSince", "staleReason", F.array_join("staleFacets", ",").alias("staleFacets"), "hit")


def q_section_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each section after that run; sections whose item came without a heading wait for review and stay so."""
    s = _State(spark, sf_dir)
    b = S.apply_tombstones(s.plain, s.merged(), F.current_timestamp().cast("timestamp_ntz"))
    waiting = s.sections.withColumn("status", F.when(F.col("heading").isNull(), "review_needed").otherwise("normal"))
    return S.section_status(waiting, b).select("repo", "sectionId", "status")


def q_restore_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after a run that kept every tombstoned text."""
    s = _State(spark, sf_dir)
    b = S.restore_kept(s.blocks(), s.plain.filter("rendered"), s.current())
    return b.select("repo", "sectionId", "blockId", "staleSince", "fingerprint", "hit")


def q_stamp_declined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after a run in which the writer declined all that was unwritten."""
    s = _State(spark, sf_dir)
    b = S.stamp_declined(s.blocks(), S.unwritten(s.blocks(), s.current()), s.current())
    return b.select("repo", "sectionId", "blockId", "fingerprint", "hit")


def q_record_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamps of dependency docs that sections and blocks took when they were written."""
    sections, blocks = _State(spark, sf_dir).recorded()
    return sections.select("repo", "sectionId", F.lit("").alias("blockId"), "depDocs").unionByName(blocks.select("repo", "sectionId", "blockId", "depDocs"))


def q_backfill_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps given later to blocks without one, where the section's is still current."""
    s = _State(spark, sf_dir)
    return S.backfill_dependencies(s.recorded()[0], s.plain, s.docs(True), s.names()).filter("hit").select("repo", "sectionId", "blockId", "depDocs")


def q_stamp_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of tiers after a run that answered for the domains but not for the project."""
    s = _State(spark, sf_dir)
    then = s.sections.drop("memberDocs").join(s.members(False).select("repo", F.col("id").alias("owner"), F.col("current").alias("memberDocs")), ["repo", "owner"], "left")
    out = S.stamp_members(then, s.members(True), s.entities.filter("type = 'domain'"))
    return out.filter("memberDocs IS NOT NULL").select("repo", "sectionId", "memberDocs")


# ---------------------------------------------------------------- SQL

_KNOWN = ", ".join(f"'{b}'" for b in BLOCKS)
_PROP = ", ".join(f"'{b}'" for b in S.PROPAGATING)
_ALL = "CASE {b} " + " ".join(f"WHEN '{b}' THEN '{','.join(fs)}'" for b, fs in BLOCK_FACETS.items()) + " END"


def _view(name: str, order: str) -> str:
    return f"""{name}_v AS (SELECT *, {_CANON.format(t="t")} AS owner FROM (SELECT *, {TRIM.format(c="entityId")} AS t, row_number() OVER (PARTITION BY repo, sectionId ORDER BY {order}) AS rn FROM write_sections) WHERE rn = 1),
{name}_s AS (SELECT v.repo, v.sectionId, v.owner, c.path, v.heading, v.section_row_id AS ord FROM {name}_v v LEFT JOIN cur c ON c.repo = v.repo AND c.id = v.owner),
{name}_b AS (SELECT repo, sectionId, b AS blockId, CASE WHEN asked THEN coalesce(heading, '') || ' ' || b || ' of snapshot ' || snapshot_no || ' uses `' || regexp_extract(coalesce(dependencyEntityIds[1], ''), '([^.#/]*)$', 1) || '`.' ELSE '' END AS body,
  asked, CASE WHEN ingested_at > created_at + {LATE} THEN ingested_at END AS since FROM (SELECT *, coalesce(list_contains(targetBlocks, b), false) AS asked FROM
  (SELECT v.*, unnest(list_distinct(list_concat(coalesce(targetBlocks, []), coalesce(allowedBlocks, [])))) AS b FROM {name}_v v)) WHERE b IN ({_KNOWN})),
{name}_r AS (SELECT b.repo, s.path AS sourcePath, s.ord, b.sectionId, list_position([{_PROP}], b.blockId) AS o, length(b.body) AS n, coalesce(s.heading, '') AS heading, b.blockId, b.body
  FROM {name}_b b JOIN {name}_s s ON s.repo = b.repo AND s.sectionId = b.sectionId WHERE b.blockId IN ({_PROP}) AND b.asked AND trim(b.body) <> '' AND s.path IS NOT NULL),
{name}_l AS (SELECT repo, sourcePath, list({{'used': n, 'taken': [{{'ord': ord, 'sectionId': sectionId, 'o': o, 'heading': heading, 'blockId': blockId, 'body': body}}]}} ORDER BY ord, sectionId, o) AS rows FROM {name}_r GROUP BY 1, 2),
{name}_k AS (SELECT repo, sourcePath, list_reduce(list_prepend({{'used': 0, 'taken': []}}, rows), lambda a, x: CASE WHEN a.used + x.used <= {S.FILE_CAP} THEN {{'used': a.used + x.used, 'taken': list_concat(a.taken, x.taken)}} ELSE a END).taken AS t FROM {name}_l),
{name}_q AS (SELECT repo, sourcePath, unnest(t) AS r FROM {name}_k),
{name}_p AS (SELECT repo, sourcePath, r.ord AS ord, r.sectionId AS sectionId, '{{"heading":' || to_json(any_value(r.heading)) || ',"blocks":[' || string_agg('{{"blockId":' || to_json(r.blockId) || ',"body":' || to_json(r.body) || '}}', ',' ORDER BY r.o) || ']}}' AS j FROM {name}_q GROUP BY 1, 2, 3, 4),
{name}_d AS (SELECT repo, sourcePath, '[' || string_agg(j, ',' ORDER BY ord, sectionId) || ']' AS sections FROM {name}_p GROUP BY 1, 2),
{name}_docs AS (SELECT repo, path, sourcePath, '{{"sourcePath":' || to_json(sourcePath) || ',"sections":' || sections || '}}' AS doc FROM (
  SELECT e.repo, e.path, e.sourcePath, d.sections, sum(length(d.sections)) OVER (PARTITION BY e.repo, e.path ORDER BY e.sourcePath ROWS UNBOUNDED PRECEDING) AS used
  FROM file_edges e JOIN {name}_d d ON d.repo = e.repo AND d.sourcePath = e.sourcePath) WHERE used <= {S.TOTAL_CAP}),
{name}_lead AS (SELECT s.repo, s.owner, s.path, coalesce(s.heading, '') AS heading, concat_ws(' ', max(b.body) FILTER (b.blockId = 'purpose' AND b.body <> ''), max(b.body) FILTER (b.blockId = 'responsibility' AND b.body <> '')) AS lead
  FROM {name}_s s LEFT JOIN {name}_b b ON b.repo = s.repo AND b.sectionId = s.sectionId GROUP BY s.repo, s.sectionId, s.owner, s.path, s.heading),
{name}_m AS (SELECT t.repo, t.id, sha256(coalesce(string_agg(sha256(x.part), chr(10) ORDER BY sha256(x.part)), '')) AS stamp FROM tiers t LEFT JOIN (
  SELECT d.repo, d.id, d.dep || ' - ' || l.lead AS part FROM tier_deps d JOIN {name}_lead l ON l.repo = d.repo AND l.owner = d.dep WHERE d.type = 'project' AND d.dep LIKE 'domain:%'
  UNION ALL SELECT d.repo, d.id, l.path || ' - ' || l.heading || ': ' || l.lead FROM tier_deps d JOIN {name}_lead l ON l.repo = d.repo AND l.path = regexp_extract(d.dep, '^(?:file:|symbol:)([^#]*)', 1) WHERE d.type <> 'project' AND l.path <> '') x
  ON x.repo = t.repo AND x.id = t.id GROUP BY 1, 2)"""


_BASE = f"""{EDGES}, {_PAST},
file_edges AS (SELECT DISTINCT e.owner AS repo, a.path AS path, b.path AS sourcePath FROM edges e JOIN cur a ON a.repo = e.owner AND a.id = e.src JOIN cur b ON b.repo = e.owner AND b.id = e.dst WHERE a.path <> b.path),
names AS (SELECT repo, path AS sourcePath, list(DISTINCT n) AS names FROM (SELECT repo, path, regexp_extract(name, '([^.]*)$', 1) AS n FROM cur WHERE starts_with(id, 'symbol:') AND path IS NOT NULL) WHERE length(n) >= {S.SHORT_NAME} GROUP BY 1, 2),
tiers AS (SELECT repo, id, type, directDeps FROM cur WHERE type IN ('domain', 'project')),
tier_deps AS (SELECT DISTINCT repo, id, type, {_CANON.format(t="t")} AS dep FROM (SELECT repo, id, type, {TRIM.format(c="r")} AS t FROM (SELECT repo, id, type, unnest(directDeps) AS r FROM tiers)) WHERE t <> ''),
{_view("a", "created_at, section_row_id")},
{_view("z", "created_at DESC, section_row_id DESC")},
fps AS (SELECT b.repo, b.sectionId, b.blockId, CASE WHEN p.id IS NOT NULL THEN {_fp("p").replace("b.block", "b.blockId")} END AS stored, CASE WHEN n.id IS NOT NULL THEN {_fp("n").replace("b.block", "b.blockId")} END AS current,
  CASE WHEN n.id IS NOT NULL THEN sha256(n.id || '|' || coalesce(n.content, '')) END AS legacy
  FROM z_b b JOIN z_v v ON v.repo = b.repo AND v.sectionId = b.sectionId LEFT JOIN past p ON p.repo = v.repo AND p.snapshot_no = v.snapshot_no AND p.id = v.owner LEFT JOIN now_ n ON n.repo = v.repo AND n.id = v.owner),
diffs AS (SELECT f.*, b.body, b.since, concat_ws(',', {", ".join(f"CASE WHEN regexp_extract(stored, '{f}=([0-9a-f]*)', 1) <> regexp_extract(current, '{f}=([0-9a-f]*)', 1) THEN '{f}' END" for f in FACETS)}) AS changed
  FROM fps f JOIN z_b b ON b.repo = f.repo AND b.sectionId = f.sectionId AND b.blockId = f.blockId),
code AS (SELECT repo, sectionId, blockId, 'facet_changed' AS drift, CASE WHEN changed <> '' THEN changed ELSE {_ALL.format(b="blockId")} END AS facets FROM diffs
  WHERE since IS NULL AND trim(body) <> '' AND stored <> current AND NOT (changed = 'body' AND coalesce(regexp_extract(stored, 'body=([0-9a-f]*)', 1) = legacy, false))),
unwritten AS (SELECT repo, sectionId, blockId, 'facet_changed' AS drift, CASE WHEN stored IS NOT NULL AND changed <> '' THEN changed ELSE {_ALL.format(b="blockId")} END AS facets FROM diffs
  WHERE since IS NULL AND trim(body) = '' AND current IS NOT NULL AND stored IS DISTINCT FROM current),
deleted AS (SELECT b.repo, b.sectionId, b.blockId, 'owned_entity_deleted' AS drift, 'owned' AS facets FROM z_b b JOIN z_s s ON s.repo = b.repo AND s.sectionId = b.sectionId
  ANTI JOIN cur c ON c.repo = s.repo AND c.id = s.owner WHERE b.since IS NULL AND trim(b.body) <> ''),
tombs AS (SELECT b.repo, b.sectionId, b.blockId, CASE WHEN c.id IS NULL THEN 'owned_entity_deleted' ELSE 'tombstoned' END AS drift, CASE WHEN c.id IS NULL THEN 'owned' ELSE {_ALL.format(b="b.blockId")} END AS facets
  FROM z_b b JOIN z_s s ON s.repo = b.repo AND s.sectionId = b.sectionId LEFT JOIN cur c ON c.repo = s.repo AND c.id = s.owner WHERE b.since IS NOT NULL AND trim(b.body) <> ''),
stamps AS (SELECT s.repo, s.sectionId, s.path, (SELECT sha256('[' || coalesce(string_agg(d.doc, ',' ORDER BY d.sourcePath), '') || ']') FROM a_docs d WHERE d.repo = s.repo AND d.path = s.path) AS then_,
  (SELECT sha256('[' || coalesce(string_agg(d.doc, ',' ORDER BY d.sourcePath), '') || ']') FROM z_docs d WHERE d.repo = s.repo AND d.path = s.path) AS now FROM z_s s WHERE s.path IS NOT NULL),
text AS (SELECT b.repo, b.sectionId, b.blockId, b.since, trim(b.body) AS body, s.path FROM z_b b JOIN z_s s ON s.repo = b.repo AND s.sectionId = b.sectionId WHERE trim(b.body) <> ''),
named AS (SELECT t.repo, t.sectionId, t.blockId, e.sourcePath FROM text t JOIN file_edges e ON e.repo = t.repo AND e.path = t.path LEFT JOIN names n ON n.repo = e.repo AND n.sourcePath = e.sourcePath
  WHERE contains(t.body, e.sourcePath) OR contains(t.body, split_part(e.sourcePath, '/', -1)) OR contains(t.body, regexp_replace(split_part(e.sourcePath, '/', -1), '\\.[cm]?[jt]s$', ''))
  OR list_has_any(coalesce(n.names, []), regexp_split_to_array(t.body, '[^A-Za-z0-9_]+'))),
block_stamps AS (SELECT t.repo, t.sectionId, t.blockId, t.since,
  (SELECT sha256('[' || coalesce(string_agg(d.doc, ',' ORDER BY d.sourcePath), '') || ']') FROM named m JOIN a_docs d ON d.repo = m.repo AND d.path = t.path AND d.sourcePath = m.sourcePath WHERE m.repo = t.repo AND m.sectionId = t.sectionId AND m.blockId = t.blockId) AS then_,
  (SELECT sha256('[' || coalesce(string_agg(d.doc, ',' ORDER BY d.sourcePath), '') || ']') FROM named m JOIN z_docs d ON d.repo = m.repo AND d.path = t.path AND d.sourcePath = m.sourcePath WHERE m.repo = t.repo AND m.sectionId = t.sectionId AND m.blockId = t.blockId) AS now
  FROM text t),
dependencies AS (SELECT b.repo, b.sectionId, b.blockId, 'facet_changed' AS drift, 'depDocs' AS facets FROM block_stamps b JOIN stamps s ON s.repo = b.repo AND s.sectionId = b.sectionId
  WHERE b.since IS NULL AND b.blockId NOT IN ({_PROP}) AND s.then_ <> s.now AND b.then_ <> b.now),
members AS (SELECT b.repo, b.sectionId, b.blockId, 'facet_changed' AS drift, 'memberDocs' AS facets FROM z_b b JOIN z_s s ON s.repo = b.repo AND s.sectionId = b.sectionId JOIN a_m a ON a.repo = s.repo AND a.id = s.owner
  JOIN z_m z ON z.repo = s.repo AND z.id = s.owner WHERE b.since IS NULL AND trim(b.body) <> '' AND a.stamp <> z.stamp),
merged AS (SELECT repo, sectionId, blockId, arg_min(drift, p) AS drift, string_agg(facets, ',' ORDER BY p) AS facets FROM (
  SELECT *, 0 AS p FROM code UNION ALL SELECT *, 1 FROM deleted UNION ALL SELECT *, 2 FROM dependencies UNION ALL SELECT *, 3 FROM members) GROUP BY 1, 2, 3)"""
_REASON = "CASE WHEN m.drift = 'owned_entity_deleted' THEN m.drift WHEN contains(m.facets, ',') THEN 'code_changed' ELSE m.facets || '_changed' END"

QUERIES = {
    f.__name__: f
    for f in (
        q_dependency_docs, q_block_mentions, q_stale_dependencies, q_stale_members, q_language_drift, q_unwritten, q_tombstoned, q_stale_merged, q_tier_slugs, q_apply_tombstones, q_section_status, q_restore_kept,
        q_stamp_declined, q_record_dependencies, q_backfill_dependencies, q_stamp_members,
    )
}
SQL = {
    "q_dependency_docs": f"WITH {_BASE} SELECT repo, path, sourcePath, sha256(doc) AS doc_hash, length(doc) AS n_chars FROM z_docs",
    "q_block_mentions": f"WITH {_BASE} SELECT m.repo, m.sectionId, m.blockId, m.sourcePath FROM named m JOIN z_s s ON s.repo = m.repo AND s.sectionId = m.sectionId SEMI JOIN z_docs d ON d.repo = m.repo AND d.path = s.path AND d.sourcePath = m.sourcePath",
    "q_stale_dependencies": f"WITH {_BASE} SELECT * FROM dependencies",
    "q_stale_members": f"WITH {_BASE} SELECT * FROM members",
    "q_language_drift": f"SELECT DISTINCT docPath, sectionId, blockId, 'facet_changed' AS drift, 'language' AS facets FROM translate_blocks WHERE canonical AND blockId IN ({_KNOWN}) AND language <> '{LANGUAGE}' AND {TRIM.format(c='text')} <> ''",
    "q_unwritten": f"WITH {_BASE} SELECT * FROM unwritten",
    "q_tombstoned": f"WITH {_BASE} SELECT * FROM tombs",
    "q_stale_merged": f"WITH {_BASE} SELECT repo, sectionId AS section, blockId AS block, drift, facets FROM merged",
    "q_tier_slugs": f"""WITH {_BASE} SELECT DISTINCT repo, CASE WHEN starts_with(sectionId, 'domain:') THEN substr(sectionId, 8) ELSE '.' END AS slug
FROM (SELECT repo, sectionId FROM merged UNION ALL SELECT repo, sectionId FROM unwritten) WHERE starts_with(sectionId, 'domain:') OR starts_with(sectionId, 'project:')""",
    "q_apply_tombstones": f"""WITH {_BASE} SELECT b.repo, b.sectionId, b.blockId, CASE WHEN m.drift IS NOT NULL THEN (SELECT max(ingested_at) FROM write_sections) ELSE b.since END AS staleSince,
  CASE WHEN m.drift IS NOT NULL THEN {_REASON} WHEN b.since IS NOT NULL THEN 'code_changed' END AS staleReason, m.facets AS staleFacets, m.drift IS NOT NULL AS hit
FROM z_b b LEFT JOIN merged m ON m.repo = b.repo AND m.sectionId = b.sectionId AND m.blockId = b.blockId""",
    "q_section_status": f"""WITH {_BASE} SELECT s.repo, s.sectionId, CASE WHEN s.heading IS NULL THEN 'review_needed' WHEN coalesce(bool_and(b.since IS NOT NULL OR m.drift IS NOT NULL) FILTER (b.blockId IS NOT NULL), false) THEN 'stale' ELSE 'normal' END AS status
FROM z_s s LEFT JOIN z_b b ON b.repo = s.repo AND b.sectionId = s.sectionId LEFT JOIN merged m ON m.repo = b.repo AND m.sectionId = b.sectionId AND m.blockId = b.blockId GROUP BY s.repo, s.sectionId, s.heading""",
    "q_restore_kept": f"""WITH {_BASE} SELECT b.repo, b.sectionId, b.blockId, CASE WHEN NOT (b.asked AND b.since IS NOT NULL) THEN b.since END AS staleSince, CASE WHEN b.asked AND b.since IS NOT NULL THEN coalesce(f.current, f.stored) ELSE f.stored END AS fingerprint,
  b.asked AND b.since IS NOT NULL AS hit FROM z_b b JOIN fps f ON f.repo = b.repo AND f.sectionId = b.sectionId AND f.blockId = b.blockId""",
    "q_stamp_declined": f"""WITH {_BASE} SELECT f.repo, f.sectionId, f.blockId, CASE WHEN u.drift IS NOT NULL THEN f.current ELSE f.stored END AS fingerprint, u.drift IS NOT NULL AS hit
FROM fps f LEFT JOIN unwritten u ON u.repo = f.repo AND u.sectionId = f.sectionId AND u.blockId = f.blockId""",
    "q_record_dependencies": f"""WITH {_BASE} SELECT s.repo, s.sectionId, '' AS blockId, t.then_ AS depDocs FROM z_s s LEFT JOIN stamps t ON t.repo = s.repo AND t.sectionId = s.sectionId
UNION ALL SELECT b.repo, b.sectionId, b.blockId, CASE WHEN s.path IS NOT NULL THEN t.then_ END FROM z_b b JOIN z_s s ON s.repo = b.repo AND s.sectionId = b.sectionId LEFT JOIN block_stamps t ON t.repo = b.repo AND t.sectionId = b.sectionId AND t.blockId = b.blockId""",
    "q_backfill_dependencies": f"WITH {_BASE} SELECT b.repo, b.sectionId, b.blockId, b.now AS depDocs FROM block_stamps b JOIN stamps s ON s.repo = b.repo AND s.sectionId = b.sectionId WHERE s.then_ = s.now",
    "q_stamp_members": f"""WITH {_BASE} SELECT s.repo, s.sectionId, CASE WHEN c.type = 'domain' THEN z.stamp ELSE a.stamp END AS memberDocs FROM z_s s JOIN cur c ON c.repo = s.repo AND c.id = s.owner
JOIN a_m a ON a.repo = s.repo AND a.id = s.owner JOIN z_m z ON z.repo = s.repo AND z.id = s.owner""",
}
