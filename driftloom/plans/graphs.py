"""Edges, quotient graphs, waves, reachability and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.ids import canonical_id, path_of_id
from driftloom.operators import graphs as G
from driftloom.plans.current import CUR, DOMAINS, EDGES, SECTIONS, TRIM, _CANON, current_domains, current_entities, dependency_edges, sections
from driftloom.plans.snapshots import canonical_hash
from driftloom.session import cut_step
from driftloom.sources.tables import table


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cur = current_entities(spark, sf_dir, ["path", "type", "directDeps"])
    return cur, dependency_edges(cur)


def q_entity_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, path, name and file stem read from the id grammar."""
    cur = current_entities(spark, sf_dir, ["path"])
    i = F.col("id")
    path = path_of_id(i)
    base = F.substring_index(path, "/", -1)
    return cur.select(
        "repo", "id", F.regexp_extract(i, r"^([a-z]+):", 1).alias("kind"), path.alias("id_path"), F.regexp_extract(i, r"#(.*)$", 1).alias("symbol"),
        F.substring_index(F.regexp_extract(i, r"#(.*)$", 1), ".", -1).alias("short_name"), F.regexp_replace(base, r"\.[cm]?[jt]s$", "").alias("stem"),
    )


def q_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a scope of prefixes and files, build folders left out."""
    cur = current_entities(spark, sf_dir, ["path", "type"]).filter("type = 'file'")
    p = F.col("path")
    inside = p.startswith("packages/babo-") & (p.endswith(".ts") | p.endswith(".js"))
    return cur.filter(inside & ~p.rlike(r"(^|/)(node_modules|dist|build)/") & ~p.endswith(".d.ts")).select("repo", "path")


def q_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of each entity as the reverse of the dependencies."""
    _, e = _base(spark, sf_dir)
    return e.groupBy("owner", F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("src")), "|").alias("used_by"), F.count(F.lit(1)).alias("n_used_by"))


def q_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages from other files, a method's own class left out; entities without any count 0."""
    cur, e = _base(spark, sf_dir)
    outside = e.filter((path_of_id(F.col("src")) != path_of_id(F.col("dst"))) & (F.col("src") != F.regexp_replace("dst", r"\.[^.#]*$", "")))
    n = outside.groupBy(F.col("owner").alias("repo"), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return cur.select("repo", "id").join(n, ["repo", "id"], "left").select("repo", "id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def q_resolve_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved to an entity, else to the file of their path, else unresolved; counts by outcome."""
    cur = current_entities(spark, sf_dir, ["directDeps"])
    refs = cur.select("repo", F.explode("directDeps").alias("r")).select("repo", canonical_id(F.col("r")).alias("ref")).filter("ref <> ''").distinct()
    ids = cur.select("repo", F.col("id").alias("ref"), F.col("id").alias("hit"))
    files = cur.select("repo", F.col("id").alias("file_id"), F.col("id").alias("file_hit"))
    r = refs.join(ids, ["repo", "ref"], "left").withColumn("file_id", F.concat(F.lit("file:"), path_of_id(F.col("ref")))).join(files, ["repo", "file_id"], "left")
    how = F.when(F.col("hit").isNotNull(), "entity").when(F.col("file_hit").isNotNull(), "file").otherwise("unresolved")
    return r.select("repo", "ref", how.alias("outcome"), F.coalesce("hit", "file_hit").alias("target"))


def _files(cur: DataFrame) -> DataFrame:
    return cur.select(F.col("repo").alias("owner"), F.col("id").alias("node"), F.col("path").alias("grp")).filter(F.col("grp").isNotNull())


def q_file_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur, e = _base(spark, sf_dir)
    return G.quotient_edges(e, _files(cur))


def _domain_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cur, e = _base(spark, sf_dir)
    d = current_domains(spark, sf_dir)
    first = d.groupBy(F.col("repo").alias("owner"), F.col("file").alias("path")).agg(F.min_by("slug", F.struct("domain_ord", "file_ord", "slug")).alias("grp"))
    assignment = cur.select(F.col("repo").alias("owner"), F.col("id").alias("node"), "path").join(first, ["owner", "path"]).select("owner", "node", "grp")
    return d.select(F.col("repo").alias("owner"), F.col("slug").alias("node")).distinct(), G.quotient_edges(e, assignment)


def q_domain_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain_graph(spark, sf_dir)[1]


def q_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation waves of the domains, cycles as one group."""
    return G.waves(*_domain_graph(spark, sf_dir)).withColumn("wave", F.col("wave").cast("bigint"))


def q_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of the file graph."""
    cur, e = _base(spark, sf_dir)
    f = G.quotient_edges(e, _files(cur))
    return G.strong_components(_files(cur).select("owner", F.col("grp").alias("node")).distinct(), f)


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur, e = _base(spark, sf_dir)
    f = G.quotient_edges(e, _files(cur))
    return G.components(_files(cur).select("owner", F.col("grp").alias("node")).distinct(), f)


def q_bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classes reach in at most two steps."""
    cur, e = _base(spark, sf_dir)
    r = G.reach(e, cur.filter("type = 'class'").select(F.col("repo").alias("owner"), F.col("id").alias("node")), 2)
    return r.groupBy("owner", "node").agg(F.min("depth").cast("bigint").alias("depth"))


def q_reverse_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from which a test file can be affected, to the fixpoint: all files that reach one."""
    cur, e = _base(spark, sf_dir)
    f = G.quotient_edges(e, _files(cur))
    tests = _files(cur).select("owner", F.col("grp").alias("node")).distinct().filter("node LIKE '%.test.%'")
    return G.reach(G.reverse_edges(f), tests).select("owner", "node", F.col("depth").cast("bigint").alias("depth"))


def q_one_hop_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain tiers and what they depend on directly, as one node list with the reason."""
    cur, e = _base(spark, sf_dir)
    scope = cur.filter("type IN ('domain', 'project')").select(F.col("repo").alias("owner"), F.col("id").alias("node"))
    hop = e.join(scope.withColumnRenamed("node", "src"), ["owner", "src"], "left_semi").select("owner", F.col("dst").alias("node")).distinct()
    return scope.withColumn("why", F.lit("scope")).unionByName(hop.join(scope, ["owner", "node"], "left_anti").withColumn("why", F.lit("dependency")))


def q_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections to look at after the newest delivery: 0 own a changed entity, 1 depend on one, 2 depend on such a section."""
    ent = current_entities(spark, sf_dir, ["contentHash"])
    sec = sections(spark, sf_dir, ["entityId", "dependencyEntityIds"])
    written = first_hash(spark, sf_dir, sec)
    owns = sec.select("repo", "sectionId", canonical_id(F.col("entityId")).alias("id"))
    deps = sec.select("repo", "sectionId", F.explode("dependencyEntityIds").alias("r")).select("repo", "sectionId", canonical_id(F.col("r")).alias("id")).filter("id <> ''").distinct()
    now = ent.select("repo", "id", canonical_hash(F.col("contentHash")).alias("now"))
    changed = written.join(now, ["repo", "id"]).filter("then <> now").select("repo", "id").distinct()
    direct = owns.join(changed, ["repo", "id"]).select("repo", "sectionId", F.lit(0).alias("o")).unionByName(deps.join(changed, ["repo", "id"]).select("repo", "sectionId", F.lit(1).alias("o")))
    direct = cut_step(direct.groupBy("repo", "sectionId").agg(F.min("o").alias("o")))
    arcs = deps.select(F.col("repo").alias("owner"), F.regexp_replace("id", "^section:", "").alias("src"), F.col("sectionId").alias("dst"))
    reached = G.reach(arcs, direct.select(F.col("repo").alias("owner"), F.col("sectionId").alias("node")))
    later = reached.filter("depth > 0").select(F.col("owner").alias("repo"), F.col("node").alias("sectionId"), F.lit(2).alias("o"))
    return direct.unionByName(later).select("repo", "sectionId", F.col("o").cast("bigint").alias("impact_order"))


def first_hash(spark: SparkSession, sf_dir: str, sec: DataFrame) -> DataFrame:
    """(repo, id, then): the hash of each owned entity at the snapshot its section was written against."""
    w = sec.select("repo", "snapshot_no", canonical_id(F.col("entityId")).alias("id"))
    mine = table(spark, sf_dir, "entities").select("repo", "snapshot_no", "id", "contentHash").join(w.distinct(), ["repo", "snapshot_no", "id"], "left_semi")
    e = mine.groupBy("repo", "snapshot_no", "id").agg(F.max(canonical_hash(F.col("contentHash"))).alias("then"))
    return w.join(e, ["repo", "snapshot_no", "id"]).select("repo", "id", "then")


_FILE = f"""{EDGES}, files AS (SELECT DISTINCT repo AS owner, path AS node FROM cur WHERE path IS NOT NULL),
fe AS (SELECT DISTINCT e.owner, a.path AS src, b.path AS dst FROM edges e JOIN cur a ON a.repo = e.owner AND a.id = e.src
  JOIN cur b ON b.repo = e.owner AND b.id = e.dst WHERE a.path <> b.path)"""
_DOM = f"""{EDGES}, {DOMAINS}, first_dom AS (SELECT repo AS owner, file AS path, arg_min(slug, (domain_ord, file_ord, slug)) AS slug FROM domains GROUP BY 1, 2),
asg AS (SELECT c.repo AS owner, c.id AS node, f.slug FROM cur c JOIN first_dom f ON f.owner = c.repo AND f.path = c.path),
nodes AS (SELECT DISTINCT repo AS owner, slug AS node FROM domains),
de AS (SELECT DISTINCT e.owner, a.slug AS src, b.slug AS dst FROM edges e JOIN asg a ON a.owner = e.owner AND a.node = e.src
  JOIN asg b ON b.owner = e.owner AND b.node = e.dst WHERE a.slug <> b.slug)"""
_H = "nullif(regexp_replace(lower(trim({c})), '^[^:]*:\\s*', ''), '')"

QUERIES = {f.__name__: f for f in (q_entity_paths, q_scope_filter, q_reverse_edges, q_in_degree, q_resolve_fallback, q_file_dag, q_domain_dag, q_waves, q_scc, q_components, q_bounded_reach, q_reverse_reach, q_one_hop_view, q_impact)}
SQL = {
    "q_entity_paths": f"""WITH {CUR} SELECT repo, id, regexp_extract(id, '^([a-z]+):', 1) AS kind, regexp_extract(id, '^(?:file:|symbol:)([^#]*)', 1) AS id_path,
  regexp_extract(id, '#(.*)$', 1) AS symbol, split_part(regexp_extract(id, '#(.*)$', 1), '.', -1) AS short_name,
  regexp_replace(split_part(regexp_extract(id, '^(?:file:|symbol:)([^#]*)', 1), '/', -1), '\\.[cm]?[jt]s$', '') AS stem FROM cur""",
    "q_scope_filter": f"""WITH {CUR} SELECT repo, path FROM cur WHERE type = 'file' AND starts_with(path, 'packages/babo-') AND (ends_with(path, '.ts') OR ends_with(path, '.js'))
  AND NOT regexp_matches(path, '(^|/)(node_modules|dist|build)/') AND NOT ends_with(path, '.d.ts')""",
    "q_reverse_edges": f"WITH {EDGES} SELECT owner, dst AS id, string_agg(src, '|' ORDER BY src) AS used_by, count(*) AS n_used_by FROM edges GROUP BY owner, dst",
    "q_in_degree": f"""WITH {EDGES}, n AS (SELECT owner, dst, count(*) AS n FROM edges WHERE regexp_extract(src, '^(?:file:|symbol:)([^#]*)', 1) <> regexp_extract(dst, '^(?:file:|symbol:)([^#]*)', 1)
  AND src <> regexp_replace(dst, '\\.[^.#]*$', '') GROUP BY 1, 2)
SELECT c.repo, c.id, coalesce(n.n, 0) AS in_degree FROM cur c LEFT JOIN n ON n.owner = c.repo AND n.dst = c.id""",
    "q_resolve_fallback": f"""WITH {EDGES}, refs AS (SELECT DISTINCT owner AS repo, {_CANON.format(t="t")} AS ref FROM raw_deps WHERE t <> '')
SELECT r.repo, r.ref, CASE WHEN c.id IS NOT NULL THEN 'entity' WHEN f.id IS NOT NULL THEN 'file' ELSE 'unresolved' END AS outcome, coalesce(c.id, f.id) AS target
FROM refs r LEFT JOIN cur c ON c.repo = r.repo AND c.id = r.ref LEFT JOIN cur f ON f.repo = r.repo AND f.id = 'file:' || regexp_extract(r.ref, '^(?:file:|symbol:)([^#]*)', 1)""",
    "q_file_dag": f"WITH {_FILE} SELECT owner, src, dst FROM fe",
    "q_domain_dag": f"WITH {_DOM} SELECT owner, src, dst FROM de",
    "q_waves": f"""WITH RECURSIVE {_DOM}, reach AS (SELECT owner, src, dst FROM de UNION SELECT r.owner, r.src, d.dst FROM reach r JOIN de d ON d.owner = r.owner AND d.src = r.dst),
scc AS (SELECT n.owner, n.node, least(n.node, coalesce(min(a.dst), n.node)) AS scc FROM nodes n LEFT JOIN (SELECT a.owner, a.src, a.dst FROM reach a JOIN reach b ON a.owner = b.owner AND a.src = b.dst AND a.dst = b.src) a
  ON a.owner = n.owner AND a.src = n.node GROUP BY 1, 2),
ce AS (SELECT DISTINCT d.owner, x.scc AS src, y.scc AS dst FROM de d JOIN scc x ON x.owner = d.owner AND x.node = d.src JOIN scc y ON y.owner = d.owner AND y.node = d.dst WHERE x.scc <> y.scc),
lv AS (SELECT DISTINCT owner, scc, 0 AS wave FROM scc UNION SELECT c.owner, c.src, l.wave + 1 FROM lv l JOIN ce c ON c.owner = l.owner AND c.dst = l.scc)
SELECT s.owner, s.node, s.scc, CAST(max(l.wave) AS BIGINT) AS wave FROM scc s JOIN lv l ON l.owner = s.owner AND l.scc = s.scc GROUP BY 1, 2, 3""",
    "q_scc": f"""WITH RECURSIVE {_FILE}, reach AS (SELECT owner, src, dst FROM fe UNION SELECT r.owner, r.src, d.dst FROM reach r JOIN fe d ON d.owner = r.owner AND d.src = r.dst),
both_ways AS (SELECT a.owner, a.src, a.dst FROM reach a JOIN reach b ON a.owner = b.owner AND a.src = b.dst AND a.dst = b.src)
SELECT n.owner, n.node, least(n.node, coalesce(min(b.dst), n.node)) AS scc FROM files n LEFT JOIN both_ways b ON b.owner = n.owner AND b.src = n.node GROUP BY 1, 2""",
    "q_components": f"""WITH RECURSIVE {_FILE}, ue AS (SELECT owner, src, dst FROM fe UNION SELECT owner, dst, src FROM fe),
reach AS (SELECT owner, node AS src, node AS dst FROM files UNION SELECT r.owner, r.src, u.dst FROM reach r JOIN ue u ON u.owner = r.owner AND u.src = r.dst)
SELECT owner, src AS node, min(dst) AS label FROM reach GROUP BY 1, 2""",
    "q_bounded_reach": f"""WITH {EDGES}, s AS (SELECT repo AS owner, id AS node FROM cur WHERE type = 'class'), a AS (SELECT DISTINCT e.owner, e.dst AS node FROM edges e SEMI JOIN s ON s.owner = e.owner AND s.node = e.src),
b AS (SELECT DISTINCT e.owner, e.dst AS node FROM edges e SEMI JOIN a ON a.owner = e.owner AND a.node = e.src)
SELECT owner, node, CAST(min(d) AS BIGINT) AS depth FROM (SELECT *, 0 AS d FROM s UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY 1, 2""",
    "q_reverse_reach": f"""WITH RECURSIVE {_FILE}, r AS (SELECT owner, node, 0 AS depth FROM files WHERE node LIKE '%.test.%'
  UNION SELECT f.owner, f.src, r.depth + 1 FROM r JOIN fe f ON f.owner = r.owner AND f.dst = r.node WHERE r.depth < 60)
SELECT owner, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2""",
    "q_one_hop_view": f"""WITH {EDGES}, s AS (SELECT repo AS owner, id AS node FROM cur WHERE type IN ('domain', 'project')),
h AS (SELECT DISTINCT e.owner, e.dst AS node FROM edges e SEMI JOIN s ON s.owner = e.owner AND s.node = e.src)
SELECT owner, node, 'scope' AS why FROM s UNION ALL SELECT h.owner, h.node, 'dependency' FROM h ANTI JOIN s ON s.owner = h.owner AND s.node = h.node""",
    "q_impact": f"""WITH RECURSIVE {CUR}, {SECTIONS},
own AS (SELECT repo, sectionId, snapshot_no, {_CANON.format(t="t")} AS id FROM (SELECT *, {TRIM.format(c="entityId")} AS t FROM sections)),
dep AS (SELECT DISTINCT repo, sectionId, {_CANON.format(t="t")} AS id FROM (SELECT repo, sectionId, {TRIM.format(c="r")} AS t FROM (SELECT repo, sectionId, unnest(dependencyEntityIds) AS r FROM sections)) WHERE t <> ''),
past AS (SELECT repo, snapshot_no, id, max({_H.format(c="contentHash")}) AS h FROM entities GROUP BY 1, 2, 3),
changed AS (SELECT DISTINCT o.repo, o.id FROM own o JOIN past p ON p.repo = o.repo AND p.snapshot_no = o.snapshot_no AND p.id = o.id JOIN cur c ON c.repo = o.repo AND c.id = o.id WHERE p.h <> {_H.format(c="c.contentHash")}),
direct AS (SELECT repo, sectionId, min(o) AS o FROM (SELECT o.repo, o.sectionId, 0 AS o FROM own o JOIN changed USING (repo, id) UNION ALL SELECT d.repo, d.sectionId, 1 FROM dep d JOIN changed USING (repo, id)) GROUP BY 1, 2),
r AS (SELECT repo, sectionId FROM direct UNION SELECT d.repo, d.sectionId FROM r JOIN dep d ON d.repo = r.repo AND regexp_replace(d.id, '^section:', '') = r.sectionId)
SELECT repo, sectionId, CAST(coalesce(d.o, 2) AS BIGINT) AS impact_order FROM r LEFT JOIN direct d USING (repo, sectionId)""",
}
