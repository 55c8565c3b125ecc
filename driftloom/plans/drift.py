"""What of the written sections is stale against the newest delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.blocks import BLOCK_FACETS, BLOCKS, FACETS
from driftloom.functions.ids import canonical_id
from driftloom.operators.drift import block_fingerprint, changed_facets, facet_hashes
from driftloom.operators.intervals import overlapping, smallest_enclosing
from driftloom.operators.upsert import merge_prefer_new, replace_by_key
from driftloom.plans.current import CUR, SECTIONS, TRIM, _CANON, current_entities, first_of, newest, sections
from driftloom.plans.snapshots import canonical_hash
from driftloom.sources.tables import table


def _facets(df: DataFrame) -> list:
    return [canonical_hash(F.col(f"facets.{f}")).alias(f) for f in FACETS]


def _merged(e: DataFrame) -> DataFrame:
    """Facets of entities by snapshot, re-deliveries merged."""
    return e.select("repo", "snapshot_no", "id", *_facets(e), canonical_hash(F.col("contentHash")).alias("content")).groupBy("repo", "snapshot_no", "id").agg(*[F.max(c).alias(c) for c in [*FACETS, "content"]])


def _past(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """Facets of the entities named by `keys` (repo, snapshot_no, id); the rest of the history is left out before it is merged."""
    return _merged(table(spark, sf_dir, "entities").join(keys.select("repo", "snapshot_no", "id").distinct(), ["repo", "snapshot_no", "id"], "left_semi"))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(newest(table(spark, sf_dir, "entities"))).drop("snapshot_no")


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir, ["entityId", "targetBlocks", "dependencyEntityIds"]).withColumn("id", canonical_id(F.col("entityId")))


def _blocks(sec: DataFrame) -> DataFrame:
    """One row per section and known block."""
    return sec.withColumn("block", F.explode(F.array_distinct("targetBlocks"))).filter(F.col("block").isin(*BLOCKS))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sectionId, block, stored, current): null where the owner is not there."""
    sec = _owned(spark, sf_dir)
    stored = facet_hashes(sec.select("repo", "sectionId", "snapshot_no", "id").join(_past(spark, sf_dir, sec), ["repo", "snapshot_no", "id"]), ["repo", "sectionId"])
    current = facet_hashes(sec.select("repo", "sectionId", "id").join(_now(spark, sf_dir), ["repo", "id"]), ["repo", "sectionId"])
    b = _blocks(sec).select("repo", "sectionId", "block")
    one = b.join(stored, ["repo", "sectionId"], "left").select("repo", "sectionId", "block", F.when(F.col("signature").isNotNull(), block_fingerprint(F.col("block"))).alias("stored"))
    return one.join(current, ["repo", "sectionId"], "left").select("repo", "sectionId", "block", "stored", F.when(F.col("signature").isNotNull(), block_fingerprint(F.col("block"))).alias("current"))


def q_block_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints(spark, sf_dir).select("repo", "sectionId", "block", "stored", "current")


def q_stale_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose facets changed since they were written."""
    f = _fingerprints(spark, sf_dir).filter("stored <> current").withColumn("facets", changed_facets(F.col("stored"), F.col("current")))
    return f.select("repo", "sectionId", "block", F.array_join("facets", ",").alias("changed"))


def q_stale_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sections whose owner is gone."""
    sec = _owned(spark, sf_dir)
    return _blocks(sec.join(_now(spark, sf_dir).select("repo", "id"), ["repo", "id"], "left_anti")).select("repo", "sectionId", "block")


def q_stale_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated blocks whose language tag is not the plain tag of its language."""
    t = table(spark, sf_dir, "translate_blocks")
    lang = F.col("language")
    return t.filter(lang.isNotNull() & (lang != F.lower(F.substring_index(lang, "-", 1)))).select("pair_id", "blockId", "language", F.lower(F.substring_index(lang, "-", 1)).alias("canonical_language")).distinct()


def q_file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint per file over the content of all its entities."""
    cur = current_entities(spark, sf_dir, ["path", "contentHash"])
    line = F.concat_ws("|", "id", F.coalesce(canonical_hash(F.col("contentHash")), F.lit("")))
    return cur.filter("path IS NOT NULL").groupBy("repo", "path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_entities"))


def q_graph_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deps, usage and placement facets computed from the index itself."""
    cur = current_entities(spark, sf_dir, ["path", "directDeps", "directUsages"])

    def joined(c: str):
        ids = F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), canonical_id), lambda x: x.isNotNull() & (x != ""))
        return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "|"), 256)

    return cur.select("repo", "id", joined("directDeps").alias("deps_facet"), joined("directUsages").alias("usage_facet"), F.sha2(F.coalesce("path", F.lit("")), 256).alias("placement_facet"))


def _ranges(cur: DataFrame) -> DataFrame:
    return cur.select("repo", "path", "id", "type", F.col("range.startLine").alias("s"), F.col("range.endLine").alias("e"), F.col("range.startOffset").alias("so"), F.col("range.endOffset").alias("eo")).filter("s IS NOT NULL AND e IS NOT NULL AND so IS NOT NULL AND eo IS NOT NULL AND path IS NOT NULL")


def q_diff_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose lines overlap those of an entity that changed since the section about it was written."""
    cur = _ranges(current_entities(spark, sf_dir, ["path", "type", "range"]))
    stale = q_stale_ast(spark, sf_dir).select("repo", F.col("sectionId").alias("id")).distinct()
    hunks = cur.join(stale, ["repo", "id"], "left_semi").filter("type <> 'file'").select("repo", "path", F.col("s").alias("hs"), F.col("e").alias("he")).distinct()
    return overlapping(hunks, cur.select("repo", "path", "id", "s", "e"), ["repo", "path"], ("hs", "he"), ("s", "e")).select("repo", "id").distinct()


def q_smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest other symbol that holds the start of each method, else its file."""
    cur = _ranges(current_entities(spark, sf_dir, ["path", "type", "range"]))
    points = cur.filter("type = 'method'").select("repo", "path", F.col("id").alias("hit_id"), F.col("so").alias("at"))
    spans = cur.filter("type NOT IN ('file', 'method')").select("repo", "path", "id", "so", "eo")
    found = smallest_enclosing(points, spans, ["repo", "path"], "at", "so", "eo", ["so", "id"]).select("repo", "hit_id", "id")
    return points.select("repo", "path", "hit_id").join(found, ["repo", "hit_id"], "left").select("repo", "hit_id", F.coalesce("id", F.concat(F.lit("file:"), "path")).alias("enclosing"))


def q_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of symbols that no strictly larger symbol of the file encloses."""
    cur = _ranges(current_entities(spark, sf_dir, ["path", "type", "range"])).filter("type <> 'file'")
    inner = cur.select("repo", "path", "id", F.col("so").alias("a"), F.col("eo").alias("b"))
    outer = cur.select("repo", "path", "so", "eo")
    enclosed = (
        inner.join(outer, ["repo", "path"]).filter((F.col("so") <= F.col("a")) & (F.col("b") <= F.col("eo")) & (F.col("eo") - F.col("so") > F.col("b") - F.col("a"))).select("repo", "id").distinct()
    )
    return inner.join(enclosed, ["repo", "id"], "left_anti").select("repo", "path", F.col("a").alias("start_offset")).distinct()


def q_incremental_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section index patched key by key with the later half of the work items, equal to the index built at once."""
    cols = ["repo", "sectionId", "created_at", "section_row_id", "heading"]
    w = table(spark, sf_dir, "write_sections").select(*cols)
    order = [F.desc("created_at"), F.desc("section_row_id")]
    late = F.col("section_row_id") % 2 == 0
    old = first_of(w.filter(~late), ["repo", "sectionId"], order)
    new = first_of(w.filter(late), ["repo", "sectionId"], order)
    both = new.join(old.select("repo", "sectionId", F.col("created_at").alias("c"), F.col("section_row_id").alias("r")), ["repo", "sectionId"], "left")
    newer = both.filter("c IS NULL OR created_at > c OR (created_at = c AND section_row_id > r)").select(*cols)
    return replace_by_key(old, newer, ["repo", "sectionId"]).select("repo", "sectionId", "section_row_id", "heading")


def q_preserve_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures merged over the two newest deliveries of each repository: a later one that is not blank wins."""
    e = table(spark, sf_dir, "entities").select("repo", "snapshot_no", "id", "signature", "loaded_at", "ord")
    numbers = e.select("repo", "snapshot_no").distinct().withColumn("back", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("snapshot_no"))) - 1)
    tagged = e.join(numbers.filter("back < 2"), ["repo", "snapshot_no"])
    one = lambda k: first_of(tagged.filter(F.col("back") == k), ["repo", "id"], ["loaded_at", "ord"]).select("repo", "id", "signature")
    return merge_prefer_new(one(1), one(0), ["repo", "id"], ["signature"])


def _hash(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c})), '^[^:]*:\\s*', ''), '')"


_PAST = f"""past AS (SELECT repo, snapshot_no, id, {", ".join(f"max({_hash('facets.' + f)}) AS {f}" for f in FACETS)}, max({_hash("contentHash")}) AS content FROM entities GROUP BY 1, 2, 3),
now_ AS (SELECT p.* FROM past p SEMI JOIN (SELECT repo, max(snapshot_no) AS snapshot_no FROM entities GROUP BY repo) l ON l.repo = p.repo AND l.snapshot_no = p.snapshot_no)"""
_OWNED = f"""{SECTIONS}, owned AS (SELECT *, {_CANON.format(t="t")} AS id FROM (SELECT *, {TRIM.format(c="entityId")} AS t FROM sections)),
blocks AS (SELECT DISTINCT repo, sectionId, id, unnest(targetBlocks) AS block FROM owned)"""


def _fp(side: str) -> str:
    h = {f: f"sha256({side}.id || '|' || coalesce({side}.{f}, ''))" for f in FACETS}
    return "CASE b.block " + " ".join(f"WHEN '{b}' THEN " + " || ',' || ".join(f"'{f}=' || {h[f]}" for f in fs) for b, fs in BLOCK_FACETS.items()) + " END"


_FPS = f"""{_PAST}, {_OWNED}, fps AS (SELECT b.repo, b.sectionId, b.block, CASE WHEN p.id IS NOT NULL THEN {_fp("p")} END AS stored, CASE WHEN n.id IS NOT NULL THEN {_fp("n")} END AS current
  FROM blocks b JOIN owned o ON o.repo = b.repo AND o.sectionId = b.sectionId LEFT JOIN past p ON p.repo = o.repo AND p.snapshot_no = o.snapshot_no AND p.id = o.id LEFT JOIN now_ n ON n.repo = o.repo AND n.id = o.id
  WHERE b.block IN ({", ".join(f"'{b}'" for b in BLOCKS)})),
stale_ast AS (SELECT repo, sectionId, block, concat_ws(',', {", ".join(f"CASE WHEN regexp_extract(stored, '{f}=([0-9a-f]*)', 1) <> regexp_extract(current, '{f}=([0-9a-f]*)', 1) THEN '{f}' END" for f in FACETS)}) AS changed FROM fps WHERE stored <> current)"""
_RANGES = f"""{CUR}, rng AS (SELECT repo, path, id, type, range.startLine AS s, range.endLine AS e, range.startOffset AS so, range.endOffset AS eo FROM cur
  WHERE range.startLine IS NOT NULL AND range.endLine IS NOT NULL AND range.startOffset IS NOT NULL AND range.endOffset IS NOT NULL AND path IS NOT NULL)"""

QUERIES = {f.__name__: f for f in (q_block_fingerprint, q_stale_ast, q_stale_deleted, q_stale_language, q_file_fingerprint, q_graph_facets, q_diff_overlap, q_smallest_enclosing, q_top_level, q_incremental_patch, q_preserve_values)}
SQL = {
    "q_block_fingerprint": f"WITH {_FPS} SELECT repo, sectionId, block, stored, current FROM fps",
    "q_stale_ast": f"WITH {_FPS} SELECT repo, sectionId, block, changed FROM stale_ast",
    "q_stale_deleted": f"WITH {_PAST}, {_OWNED} SELECT b.repo, b.sectionId, b.block FROM blocks b ANTI JOIN now_ n ON n.repo = b.repo AND n.id = b.id WHERE b.block IN ({', '.join(repr(b) for b in BLOCKS)})",
    "q_stale_language": "SELECT DISTINCT pair_id, blockId, language, lower(split_part(language, '-', 1)) AS canonical_language FROM translate_blocks WHERE language <> lower(split_part(language, '-', 1))",
    "q_file_fingerprint": f"WITH {CUR} SELECT repo, path, sha256(string_agg(id || '|' || coalesce({_hash('contentHash')}, ''), chr(10) ORDER BY id || '|' || coalesce({_hash('contentHash')}, ''))) AS fingerprint, count(*) AS n_entities FROM cur WHERE path IS NOT NULL GROUP BY 1, 2",
    "q_graph_facets": f"""WITH {CUR}, al AS (SELECT repo, id, 'd' AS k, unnest(directDeps) AS r FROM cur UNION ALL SELECT repo, id, 'u', unnest(directUsages) FROM cur),
c AS (SELECT DISTINCT repo, id, k, {_CANON.format(t="t")} AS x FROM (SELECT repo, id, k, {TRIM.format(c="r")} AS t FROM al) WHERE t <> ''),
j AS (SELECT repo, id, string_agg(x, '|' ORDER BY x) FILTER (k = 'd') AS d, string_agg(x, '|' ORDER BY x) FILTER (k = 'u') AS u FROM c GROUP BY 1, 2)
SELECT cur.repo, cur.id, sha256(coalesce(d, '')) AS deps_facet, sha256(coalesce(u, '')) AS usage_facet, sha256(coalesce(path, '')) AS placement_facet FROM cur LEFT JOIN j ON j.repo = cur.repo AND j.id = cur.id""",
    "q_diff_overlap": f"""WITH {_FPS}, {_RANGES}, h AS (SELECT DISTINCT r.repo, r.path, r.s, r.e FROM rng r SEMI JOIN stale_ast a ON a.repo = r.repo AND a.sectionId = r.id WHERE r.type <> 'file')
SELECT DISTINCT r.repo, r.id FROM h JOIN rng r ON r.repo = h.repo AND r.path = h.path AND h.s <= r.e AND r.s <= h.e""",
    "q_smallest_enclosing": f"""WITH {_RANGES}, m AS (SELECT repo, path, id AS hit_id, so AS at FROM rng WHERE type = 'method'),
f AS (SELECT m.repo, m.hit_id, arg_min(r.id, (r.eo - r.so, r.so, r.id)) AS id FROM m JOIN rng r ON r.repo = m.repo AND r.path = m.path AND r.type NOT IN ('file', 'method') AND r.so <= m.at AND m.at < r.eo GROUP BY 1, 2)
SELECT m.repo, m.hit_id, coalesce(f.id, 'file:' || m.path) AS enclosing FROM m LEFT JOIN f ON f.repo = m.repo AND f.hit_id = m.hit_id""",
    "q_top_level": f"""WITH {_RANGES} SELECT DISTINCT a.repo, a.path, a.so AS start_offset FROM rng a WHERE a.type <> 'file' AND NOT EXISTS (
  SELECT 1 FROM rng b WHERE b.type <> 'file' AND b.repo = a.repo AND b.path = a.path AND b.so <= a.so AND a.eo <= b.eo AND b.eo - b.so > a.eo - a.so)""",
    "q_incremental_patch": f"WITH {SECTIONS} SELECT repo, sectionId, section_row_id, heading FROM sections",
    "q_preserve_values": """WITH t AS (SELECT e.*, back, row_number() OVER (PARTITION BY e.repo, id, snapshot_no ORDER BY loaded_at, ord) AS rn
  FROM entities e JOIN (SELECT repo, snapshot_no, row_number() OVER (PARTITION BY repo ORDER BY snapshot_no DESC) - 1 AS back FROM (SELECT DISTINCT repo, snapshot_no FROM entities)) l USING (repo, snapshot_no)),
o AS (SELECT repo, id, signature FROM t WHERE back = 1 AND rn = 1), n AS (SELECT repo, id, signature FROM t WHERE back = 0 AND rn = 1)
SELECT repo, id, CASE WHEN n.signature IS NOT NULL AND NOT regexp_matches(n.signature, '^\\s*$') THEN n.signature ELSE o.signature END AS signature FROM o FULL JOIN n USING (repo, id)""",
}
