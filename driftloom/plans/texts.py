"""Text operators: spans, links, literals, search, translations, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.blocks import BLOCKS
from driftloom.functions.comments import strip_comments_udf
from driftloom.plans.current import CUR, current_entities, first_of
from driftloom.sources.tables import table

_SPAN = r"`([^`\n]+)`"


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "translate_blocks").filter("canonical AND text IS NOT NULL").select("pair_id", "docPath", "sectionId", "blockId", "text", "language").distinct()


def _spans(c: str):
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(_SPAN), F.lit(1))))


def q_code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct code spans of each canonical text."""
    return _canonical(spark, sf_dir).select("pair_id", F.array_join(_spans("text"), "|").alias("spans"), F.size(_spans("text")).cast("bigint").alias("n_spans"))


def q_unique_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code spans that name exactly one file over all repositories, and where they occur."""
    cur = current_entities(spark, sf_dir, ["path", "name", "type"]).filter("type NOT IN ('file', 'domain', 'project')")
    names = cur.select(F.substring_index("name", ".", -1).alias("span"), F.concat_ws(":", "repo", "path").alias("target"))
    unique = names.groupBy("span").agg(F.min("target").alias("target"), F.max("target").alias("other")).filter("target = other").select("span", "target")
    at = _canonical(spark, sf_dir).select("pair_id", F.explode(_spans("text")).alias("span"))
    return at.join(unique, "span").select("pair_id", "span", "target").distinct()


_QUOTED = r"`([A-Za-z_$][A-Za-z0-9_$]*)(?:`|\(|\.)"
_WORDS = r"([A-Za-z_$][A-Za-z0-9_$]*)"


def q_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose short name of four or more letters a claim mentions: in code quotes (as name, call or member) or as a plain word.

    Names are met by equality with the claim's words, not by searching every name in every text.
    """
    names = current_entities(spark, sf_dir, ["name", "type"]).filter("type NOT IN ('file', 'domain', 'project')").select("repo", F.substring_index("name", ".", -1).alias("name")).filter("length(name) >= 4").distinct()
    c = table(spark, sf_dir, "contradicted_claims").select("claim_id", F.concat_ws("\n", "statement", "evidence").alias("t"))
    quoted = F.regexp_extract_all("t", F.lit(_QUOTED), F.lit(1))
    said = c.select("claim_id", quoted.alias("q"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_WORDS), F.lit(1)))).alias("name")).select("claim_id", "name", F.array_contains("q", F.col("name")).alias("quoted"))
    said = said.filter("length(name) >= 4").groupBy("claim_id", "name").agg(F.bool_or("quoted").alias("quoted"))
    return said.join(names, "name").groupBy("claim_id", "name").agg(F.countDistinct("repo").alias("n_repos"), F.bool_or("quoted").alias("quoted"))


def q_unknown_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-quoted identifiers of the canonical texts that no repository has, and how many texts use them."""
    names = current_entities(spark, sf_dir, ["name"]).select(F.substring_index("name", ".", -1).alias("name")).distinct()
    said = _canonical(spark, sf_dir).select("pair_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_QUOTED), F.lit(1)))).alias("name"))
    return said.join(names, "name", "left_anti").groupBy("name").agg(F.countDistinct("pair_id").alias("n_texts"))


def q_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the sources that holds a fixed string, with the 1-based line and column of its first occurrence."""
    s = table(spark, sf_dir, "source_files").filter("contains(source, '.register(')").select("file_id", F.posexplode(F.split("source", "\n")).alias("p", "line"))
    return s.filter("contains(line, '.register(')").select("file_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.instr("line", ".register(").cast("bigint").alias("column_no")).distinct()


def q_literal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String literals of four or more characters in single quotes: files and occurrences."""
    s = table(spark, sf_dir, "source_files").select("file_id", F.explode(F.regexp_extract_all("source", F.lit(r"'([A-Za-z0-9_./-]{4,})'"), F.lit(1))).alias("literal"))
    return s.groupBy("literal").agg(F.countDistinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_hits"))


def q_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported functions, classes and constants at the left margin, first of each name per file."""
    s = table(spark, sf_dir, "source_files").filter("source IS NOT NULL AND (path LIKE '%.ts' OR path LIKE '%.js')").select("file_id", "path", "source").distinct()
    pat = r"(?m)^export (?:async )?(?:function|class|const) ([A-Za-z_$][A-Za-z0-9_$]*)"
    return s.select("file_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(pat), F.lit(1)))).alias("name")).select("file_id", F.concat(F.lit("symbol:"), "path", F.lit("#"), "name").alias("id"))


def q_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import specifiers per file: relative, scheme or package."""
    s = table(spark, sf_dir, "source_files").filter("source IS NOT NULL AND (path LIKE '%.ts' OR path LIKE '%.js')").select("file_id", F.explode(F.regexp_extract_all("source", F.lit(r"(?m)^import [^'\"\n]*['\"]([^'\"\n]+)['\"]"), F.lit(1))).alias("specifier"))
    kind = F.when(F.col("specifier").rlike(r"^[./]"), "internal").when(F.col("specifier").rlike("^[a-z]+:"), "builtin").otherwise("package")
    return s.distinct().withColumn("kind", kind)


def q_strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and hash of each script source without its comments."""
    s = table(spark, sf_dir, "source_files").filter("source IS NOT NULL AND (path LIKE '%.ts' OR path LIKE '%.js')")
    return s.select("file_id", strip_comments_udf("source").alias("body")).select("file_id", F.char_length("body").cast("bigint").alias("n_chars"), F.sha2("body", 256).alias("body_facet")).distinct()


def q_first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 200 characters of each document's first sentence, and its first paragraph's length."""
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    lead = F.split(t, r"(?<=[.!?])\s+")[0]
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.left(lead, F.lit(200)).alias("lead"), F.char_length(F.split(t, r"\n{2,}")[0]).cast("bigint").alias("paragraph_chars"))


def q_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading anchors: lower case, letters, digits and hyphens."""
    h = table(spark, sf_dir, "write_sections").filter("heading IS NOT NULL").select("heading").distinct()
    a = F.regexp_replace(F.regexp_replace(F.lower(F.trim("heading")), r"[^a-z0-9а-яё\s-]", ""), r"\s+", "-")
    return h.select("heading", a.alias("anchor"))


def q_translation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair: whether the translation has the code spans of its source, and what is missing or unexpected."""
    t = table(spark, sf_dir, "translate_blocks").filter("text IS NOT NULL").select("pair_id", "canonical", "text").distinct()
    side = lambda flag, name: t.filter(F.col("canonical") == flag).groupBy("pair_id").agg(F.min("text").alias(name))
    j = side(True, "a").join(side(False, "b"), "pair_id", "left")
    missing, extra = F.array_except(_spans("a"), _spans("b")), F.array_except(_spans("b"), _spans("a"))
    status = F.when(F.col("b").isNull(), "missing").when((F.size(missing) > 0) | (F.size(extra) > 0), "spans differ").otherwise("current")
    return j.select("pair_id", status.alias("status"), F.coalesce(F.array_join(missing, "|"), F.lit("")).alias("missing"), F.coalesce(F.array_join(extra, "|"), F.lit("")).alias("unexpected"), F.sha2(F.regexp_replace("a", r"^\s+|\s+$", ""), 256).alias("source_fingerprint"))


def q_json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are JSON objects once an outer fence is taken off, with their sections counted."""
    c = F.regexp_extract(F.regexp_replace("response.content", r"^\s+|\s+$", ""), r"(?s)^(?:```[a-z]*\s*)?(\{.*\})\s*(?:```)?$", 1)
    v = F.get_json_object("body", "$.sections")
    keys = F.json_object_keys(v)
    return table(spark, sf_dir, "llm_stages").select("stage_id", c.alias("body")).filter("body <> ''").select("stage_id", keys.alias("k")).filter("k IS NOT NULL").select("stage_id", F.size("k").cast("bigint").alias("n_sections")).distinct()


def q_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a file's sections: the file first at depth 1, methods under their class at depth 2, the rest at 1, by position."""
    cur = current_entities(spark, sf_dir, ["path", "name", "type", "range"]).filter("type IN ('file', 'class', 'function', 'method')")
    cls = cur.filter("type = 'class'").select("repo", "path", F.col("name").alias("cls")).distinct()
    j = cur.withColumn("cls", F.when(F.col("type") == "method", F.regexp_replace("name", r"\.[^.]*$", ""))).join(cls.withColumn("has", F.lit(True)), ["repo", "path", "cls"], "left")
    nested = (F.col("type") == "method") & F.col("has").isNotNull()
    heading = F.when(F.col("type") == "file", F.substring_index("path", "/", -1)).when(nested, F.substring_index("name", ".", -1)).otherwise(F.col("name"))
    w = Window.partitionBy("repo", "path").orderBy(F.when(F.col("type") == "file", 0).otherwise(1), F.col("range.startOffset").asc_nulls_first(), "id")
    return j.select("repo", "path", "id", heading.alias("heading"), F.when(nested, 2).otherwise(1).cast("bigint").alias("depth"), F.row_number().over(w).cast("bigint").alias("position"))


def q_render_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's page: its blocks in canonical order under their headings."""
    t = _canonical(spark, sf_dir)
    rank = F.array_position(F.array(*[F.lit(b) for b in BLOCKS]), F.col("blockId"))
    one = first_of(t.withColumn("rank", rank), ["docPath", "sectionId", "blockId"], ["pair_id", "text"])
    body = F.concat(F.lit("## "), "blockId", F.lit("\n\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    lines = F.array_sort(F.collect_list(F.struct("sectionId", "rank", body.alias("body"))))
    return one.groupBy("docPath").agg(lines.alias("l")).select("docPath", F.array_join(F.transform("l", lambda x: x["body"]), "\n\n").alias("page"))


def q_doc_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site routes: the extension goes, an overview is its folder's index."""
    d = table(spark, sf_dir, "documents").filter("doc_path IS NOT NULL").select("doc_path").distinct()
    bare = F.regexp_replace("doc_path", r"(?:\.[a-z]{2})?\.md$", "")
    return d.select("doc_path", F.regexp_replace(bare, r"(^|/)overview$", "$1index").alias("route"))


_SQL_SPANS = "list_sort(list_distinct(regexp_extract_all({c}, '`([^`\\n]+)`', 1)))"
_CANONICAL = "can AS (SELECT DISTINCT pair_id, docPath, sectionId, blockId, text, language FROM translate_blocks WHERE canonical AND text IS NOT NULL)"
_TRIMMED = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

QUERIES = {f.__name__: f for f in (q_code_spans, q_unique_links, q_mentions, q_unknown_symbols, q_search_literal, q_literal_files, q_exports, q_imports, q_strip_comments, q_first_sentence, q_anchor, q_translation_status, q_json_answers, q_layout, q_render_doc, q_doc_routes)}
SQL = {
    "q_code_spans": f"WITH {_CANONICAL} SELECT pair_id, array_to_string({_SQL_SPANS.format(c='text')}, '|') AS spans, len({_SQL_SPANS.format(c='text')}) AS n_spans FROM can",
    "q_unique_links": f"""WITH {CUR}, {_CANONICAL}, n AS (SELECT split_part(name, '.', -1) AS span, min(repo || ':' || path) AS target FROM cur WHERE type NOT IN ('file', 'domain', 'project') GROUP BY 1 HAVING count(DISTINCT repo || ':' || path) = 1)
SELECT DISTINCT s.pair_id, s.span, n.target FROM (SELECT pair_id, unnest({_SQL_SPANS.format(c='text')}) AS span FROM can) s JOIN n ON n.span = s.span""",
    "q_mentions": f"""WITH {CUR}, n AS (SELECT DISTINCT repo, split_part(name, '.', -1) AS name FROM cur WHERE type NOT IN ('file', 'domain', 'project') AND length(split_part(name, '.', -1)) >= 4),
t AS (SELECT claim_id, concat_ws(chr(10), statement, evidence) AS t FROM contradicted_claims),
s AS (SELECT claim_id, t, unnest(regexp_extract_all(t, '{_WORDS}', 1)) AS name FROM t),
q AS (SELECT claim_id, name, bool_or(list_contains(regexp_extract_all(t, '{_QUOTED}', 1), name)) AS quoted FROM s WHERE length(name) >= 4 GROUP BY 1, 2)
SELECT q.claim_id, q.name, count(DISTINCT n.repo) AS n_repos, bool_or(q.quoted) AS quoted FROM q JOIN n ON n.name = q.name GROUP BY 1, 2""",
    "q_unknown_symbols": f"""WITH {CUR}, {_CANONICAL}, n AS (SELECT DISTINCT split_part(name, '.', -1) AS name FROM cur),
s AS (SELECT DISTINCT pair_id, unnest(regexp_extract_all(text, '{_QUOTED}', 1)) AS name FROM can)
SELECT s.name, count(DISTINCT s.pair_id) AS n_texts FROM s ANTI JOIN n ON n.name = s.name GROUP BY 1""",
    "q_search_literal": """WITH l AS (SELECT file_id, string_split(source, chr(10)) AS x FROM source_files WHERE contains(source, '.register(')),
p AS (SELECT file_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM l)
SELECT DISTINCT file_id, CAST(i AS BIGINT) AS line_no, CAST(instr(line, '.register(') AS BIGINT) AS column_no FROM p WHERE contains(line, '.register(')""",
    "q_literal_files": "SELECT literal, count(DISTINCT file_id) AS n_files, count(*) AS n_hits FROM (SELECT file_id, unnest(regexp_extract_all(source, '''([A-Za-z0-9_./-]{4,})''', 1)) AS literal FROM source_files) GROUP BY 1",
    "q_exports": """SELECT DISTINCT file_id, 'symbol:' || path || '#' || name AS id FROM (SELECT file_id, path, unnest(regexp_extract_all(source, '(?m)^export (?:async )?(?:function|class|const) ([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS name
FROM source_files WHERE path LIKE '%.ts' OR path LIKE '%.js')""",
    "q_imports": """SELECT DISTINCT file_id, specifier, CASE WHEN regexp_matches(specifier, '^[./]') THEN 'internal' WHEN regexp_matches(specifier, '^[a-z]+:') THEN 'builtin' ELSE 'package' END AS kind
FROM (SELECT file_id, unnest(regexp_extract_all(source, '(?m)^import [^''"\\n]*[''"]([^''"\\n]+)[''"]', 1)) AS specifier FROM source_files WHERE path LIKE '%.ts' OR path LIKE '%.js')""",
    "q_first_sentence": f"""WITH t AS (SELECT doc_id, {_TRIMMED.format(c='text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, left(CASE WHEN regexp_matches(t, '[.!?]\\s') THEN regexp_extract(t, '(?s)^(.*?[.!?])\\s', 1) ELSE t END, 200) AS lead, CAST(length(regexp_split_to_array(t, '\\n{{2,}}')[1]) AS BIGINT) AS paragraph_chars FROM t""",
    "q_anchor": "SELECT DISTINCT heading, regexp_replace(regexp_replace(lower(trim(heading)), '[^a-z0-9а-яё\\s-]', '', 'g'), '\\s+', '-', 'g') AS anchor FROM write_sections WHERE heading IS NOT NULL",
    "q_translation_status": f"""WITH a AS (SELECT pair_id, min(text) AS a FROM translate_blocks WHERE canonical AND text IS NOT NULL GROUP BY 1), b AS (SELECT pair_id, min(text) AS b FROM translate_blocks WHERE NOT canonical AND text IS NOT NULL GROUP BY 1),
s AS (SELECT a.pair_id, a, b, {_SQL_SPANS.format(c='a')} AS sa, {_SQL_SPANS.format(c='b')} AS sb FROM a LEFT JOIN b ON a.pair_id = b.pair_id),
d AS (SELECT *, list_filter(sa, lambda x: NOT list_contains(sb, x)) AS m, list_filter(sb, lambda x: NOT list_contains(sa, x)) AS u FROM s)
SELECT pair_id, CASE WHEN b IS NULL THEN 'missing' WHEN len(m) > 0 OR len(u) > 0 THEN 'spans differ' ELSE 'current' END AS status, CASE WHEN b IS NULL THEN '' ELSE array_to_string(m, '|') END AS missing,
  coalesce(array_to_string(u, '|'), '') AS unexpected, sha256({_TRIMMED.format(c='a')}) AS source_fingerprint FROM d""",
    "q_layout": f"""WITH {CUR}, c AS (SELECT * FROM cur WHERE type IN ('file', 'class', 'function', 'method')), k AS (SELECT DISTINCT repo, path, name FROM c WHERE type = 'class'),
j AS (SELECT c.*, c.type = 'method' AND k.name IS NOT NULL AS nested FROM c LEFT JOIN k ON k.repo = c.repo AND k.path = c.path AND c.type = 'method' AND k.name = regexp_replace(c.name, '\\.[^.]*$', ''))
SELECT repo, path, id, CASE WHEN type = 'file' THEN split_part(path, '/', -1) WHEN nested THEN split_part(name, '.', -1) ELSE name END AS heading, CAST(CASE WHEN nested THEN 2 ELSE 1 END AS BIGINT) AS depth,
  CAST(row_number() OVER (PARTITION BY repo, path ORDER BY CASE WHEN type = 'file' THEN 0 ELSE 1 END, range.startOffset NULLS FIRST, id) AS BIGINT) AS position FROM j""",
    "q_render_doc": f"""WITH {_CANONICAL}, o AS (SELECT *, row_number() OVER (PARTITION BY docPath, sectionId, blockId ORDER BY pair_id, text) AS rn, list_position([{", ".join(f"'{b}'" for b in BLOCKS)}], blockId) AS r FROM can)
SELECT docPath, string_agg('## ' || blockId || chr(10) || chr(10) || {_TRIMMED.format(c='text')}, chr(10) || chr(10) ORDER BY sectionId, r) AS page FROM o WHERE rn = 1 GROUP BY 1""",
    "q_doc_routes": "SELECT DISTINCT doc_path, regexp_replace(regexp_replace(doc_path, '(?:\\.[a-z]{2})?\\.md$', ''), '(^|/)overview$', '\\1index') AS route FROM documents WHERE doc_path IS NOT NULL",
}
