import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.functions.comments import strip_comments
from driftloom.functions.diffs import parse_diff
from driftloom.functions.model_calls import complete, complete_rows, parse_object
from driftloom.operators import graphs as G
from driftloom.operators.drift import changed_facets, merge_passes
from driftloom.operators.folds import greedy_bins, prefix_cap, skip_cap
from driftloom.operators.intervals import overlapping, smallest_enclosing
from driftloom.operators.upsert import merge_prefer_new, replace_by_key
from driftloom.sources.config import load_settings, settings_fingerprint
from driftloom.sources.doc_state import block_rows, changed_only, duplicate_sections, read_states, write_snapshot
from driftloom.streaming.change_feed import latest_snapshot, maintain


def graph(spark, n, arcs):
    nodes = spark.createDataFrame([("g", f"n{i:02d}") for i in range(n)], "owner string, node string")
    edges = spark.createDataFrame([("g", f"n{a:02d}", f"n{b:02d}") for a, b in arcs], "owner string, src string, dst string")
    return nodes, edges


def reach_of(n, arcs):
    to = {i: {b for a, b in arcs if a == i} for i in range(n)}
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for y in to[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[i] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_cycles_and_waves(spark, seed):
    rng = random.Random(seed)
    n = 14
    arcs = sorted({(rng.randrange(n - 2), rng.randrange(n - 2)) for _ in range(15)} - {(i, i) for i in range(n)})
    nodes, edges = graph(spark, n, arcs)
    r = reach_of(n, arcs)
    scc = {i: min(j for j in range(n) if j in r[i] and i in r[j]) for i in range(n)}
    assert {x.node: x.scc for x in G.strong_components(nodes, edges).collect()} == {f"n{i:02d}": f"n{k:02d}" for i, k in scc.items()}
    level = {}

    def wave(k):
        if k not in level:
            level[k] = max([wave(scc[b]) + 1 for a, b in arcs if scc[a] == k and scc[b] != k], default=0)
        return level[k]

    assert {x.node: x.wave for x in G.waves(nodes, edges).collect()} == {f"n{i:02d}": wave(scc[i]) for i in range(n)}
    u = reach_of(n, arcs + [(b, a) for a, b in arcs])
    assert {x.node: x.label for x in G.components(nodes, edges).collect()} == {f"n{i:02d}": f"n{min(u[i]):02d}" for i in range(n)}


def test_reach_depths_and_empty_graph(spark):
    nodes, edges = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3)])
    start = nodes.filter("node = 'n00'")
    assert {(x.node, x.depth) for x in G.reach(edges, start).collect()} == {("n00", 0), ("n01", 1), ("n02", 2), ("n03", 3)}
    assert {(x.node, x.depth) for x in G.reach(edges, start, 1).collect()} == {("n00", 0), ("n01", 1)}
    assert G.strong_components(nodes.limit(0), edges.limit(0)).count() == 0
    assert {x.wave for x in G.waves(nodes, edges.limit(0)).collect()} == {0}


def test_intervals(spark):
    a = spark.createDataFrame([("p", 5, 9), ("p", 1990, 4100), ("q", 1, 1)], "path string, s int, e int")
    b = spark.createDataFrame([("p", 9, 12), ("p", 10, 11), ("p", 4100, 9000), ("q", 2, 3)], "path string, x int, y int")
    got = {(r.s, r.x) for r in overlapping(a, b, ["path"], ("s", "e"), ("x", "y")).collect()}
    assert got == {(5, 9), (1990, 4100)}
    assert overlapping(a, b, ["path"], ("s", "e"), ("x", "y")).count() == 2
    pts = spark.createDataFrame([("p", 10, "a"), ("p", 99, "b")], "path string, at int, hit string")
    spans = spark.createDataFrame([("p", "big", 0, 5000), ("p", "small", 8, 12), ("p", "end", 5, 10), ("p", "tie", 8, 12)], "path string, id string, so int, eo int")
    assert {(r.hit, r.id) for r in smallest_enclosing(pts, spans, ["path"], "at", "so", "eo", ["so", "id"]).collect()} == {("a", "small"), ("b", "big")}


def test_folds(spark):
    df = spark.createDataFrame([("r", 1, 4), ("r", 2, 9), ("r", 3, 5), ("r", 4, 1), ("s", 1, 20)], "run string, n long, size long")
    assert {(r.run, r.n) for r in prefix_cap(df, ["run"], "n", "size", 10).collect()} == {("r", 1)}
    assert {(r.run, r.n) for r in skip_cap(df, ["run"], "n", "size", "n", 10).collect()} == {("r", 1), ("r", 3), ("r", 4)}
    assert {(r.run, r.n, r.bin) for r in greedy_bins(df, ["run"], "n", "size", "n", 10).collect()} == {("r", 1, 0), ("r", 2, 1), ("r", 3, 2), ("r", 4, 2), ("s", 1, 0)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, " "), (3, "C"), (4, None)], "k int, v string")
    assert {tuple(r) for r in merge_prefer_new(old, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "C"), (4, None)}
    assert {tuple(r) for r in replace_by_key(old, new, ["k"], old.filter("k = 1")).collect()} == {(2, " "), (3, "C"), (4, None)}
    assert {tuple(r) for r in changed_only(new, old, "k", "v").collect()} == {(2, " "), (3, "C"), (4, None)}


def test_facets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("body=1,deps=2", "body=3,usage=9"), ("body=1", "body=1"), (None, "body=1")], "a string, b string")
    assert [r[0] for r in df.select(changed_facets(F.col("a"), F.col("b"))).collect()] == [["body"], [], None]
    one = spark.createDataFrame([("r", "s", "purpose", "x", ["body"])], "repo string, section string, block string, drift string, facets array<string>")
    two = spark.createDataFrame([("r", "s", "purpose", "y", ["deps", "body"])], one.schema)
    assert merge_passes(one, two).select("drift", "facets").collect()[0] == ("x", ["body", "deps"])


def test_diff(spark):
    text = ["diff --git a/x b/x", "+++ b/x", "@@ -1 +2 @@", "@@ -1,3 +4,2 @@ f", "diff --git a/y b/y", "+++ /dev/null", "@@ -1,2 +0,0 @@"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "diff_id string, line_no int, line string")
    assert {tuple(r)[1:] for r in parse_diff(df).collect()} == {("x", 2, 2), ("x", 4, 5), ("y", 0, 0)}


def test_comments():
    assert strip_comments("a = 1; // x\n/* y */ b = '//z'; c = /\\/*x/.test(s) / 2 // q\n\n\n\nd") == "a = 1;\n b = '//z'; c = /\\/*x/.test(s) / 2\n\nd"
    assert strip_comments(None) is None
    assert strip_comments("`/* no */`") == "`/* no */`"


@given(st.text(alphabet="ab/*'\"` \n\\", max_size=40))
@settings(max_examples=200, deadline=None)
def test_comment_stripper_ends(s):
    strip_comments(s)


def test_settings():
    s = load_settings('{"languages": ["de"], "headings": {"a": 1, "b": 2}}', '{"headings": {"b": 3}, "min_score": 0.25}')
    assert s.languages == ("de",) and s.headings == {"a": 1, "b": 3} and s.min_score == 0.25
    assert settings_fingerprint(s) == settings_fingerprint(load_settings('{"min_score": 0.25, "headings": {"b": 3, "a": 1}, "languages": ["de"]}'))
    with pytest.raises(ValueError):
        load_settings('{"lenguages": []}')


def test_states(spark, tmp_path):
    state = '{"version": 4, "docPath": "%s", "sectionOrder": ["s2", "s1"], "sections": {"s1": {"heading": "H", "owns": ["file:a"], "blocks": {"purpose": {"body": "x"}}}, "s2": {"blocks": {"deps": {}}}}}'
    (tmp_path / "a.json").write_text(state % "a.md")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.json").write_text(state % "b.md")
    (tmp_path / "b" / "b.generation-debug.json").write_text('{"version": 9}')
    states = read_states(spark, str(tmp_path))
    assert {(r.docPath, r.section_id, r.block, r.body, r.stale) for r in block_rows(states).collect()} == {(d, s, b, t, False) for d in ("a.md", "b.md") for s, b, t in (("s1", "purpose", "x"), ("s2", "deps", ""))}
    assert duplicate_sections(states).count() == 2
    (tmp_path / "old.json").write_text('{"version": 3, "docPath": "c"}')
    with pytest.raises(Exception, match="state version 3"):
        read_states(spark, str(tmp_path)).collect()
    assert spark.read.parquet(write_snapshot(spark.range(3), str(tmp_path / "out"))).count() == 3


def test_model_calls(spark):
    answers = iter(["nonsense", "```json\n{\"a\": \"x\\d\"}\n```"])
    assert complete(lambda p: next(answers), "q") == ('{"a":"x\\\\d"}', None, 2)
    assert complete(lambda p: "[]", "q", 2)[1:] == ("answer: not an object", 2)
    with pytest.raises(ValueError):
        parse_object("[1]")
    df = spark.createDataFrame([(1, "p"), (2, None)], "k long, prompt string")
    assert {(r.k, r.answer, r.n_calls) for r in complete_rows(df, "k", lambda p: '{"n": %d}' % len(p)).collect()} == {(1, '{"n":1}', 1), (2, '{"n":0}', 1)}


def test_change_feed(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    schema = "k int, v string, at int"

    def feed(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        maintain(stream, str(root), str(tmp_path / "ck"), ["k"], ["at"]).awaitTermination(60)
        return {tuple(r) for r in latest_snapshot(spark, str(root)).select("k", "v", "at").collect()}

    assert latest_snapshot(spark, str(root)) is None
    feed([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "p1")
    assert run() == {(1, "b", 2), (2, "x", 1)}
    feed([(1, "late", 1), (2, "y", 3)], "p2")
    assert run() == {(1, "b", 2), (2, "y", 3)}


def test_links_and_pages():
    from driftloom.functions.markdown import linkify, site_page

    t = "Use `a` and `a` or `b`.\n```ts\n`a`\n```\n[`a`](x) `b`"
    assert linkify(t, {"a": "A.md", "b": "B.md"}) == "Use [`a`](A.md) and `a` or [`b`](B.md).\n```ts\n`a`\n```\n[`a`](x) [`b`](B.md)"
    assert linkify(None, {}) is None and site_page(None) is None
    assert site_page('# T "q"\n\ntext\n# Other\n```\n# code\n```') == '---\ntitle: "T \\"q\\""\n---\ntext\n## Other\n```\n# code\n```'
    assert site_page("no title") == "no title"


def test_relative_paths(spark):
    from pyspark.sql import functions as F

    from driftloom.plans.links import relative_href

    rows = [("a/b/c.md", "a/b/d.md", "d.md"), ("a/b/c.md", "a/x.md", "../x.md"), ("c.md", "a/x.md", "a/x.md"), ("a/c.md", "b/c/x.md", "../b/c/x.md"), ("a/b.md", "a/b.md/c.md", "b.md/c.md")]
    df = spark.createDataFrame(rows, "s string, t string, want string")
    assert [r.h for r in df.select(relative_href(F.col("s"), F.col("t")).alias("h")).collect()] == [r[2] for r in rows]


def test_globs():
    import re

    from driftloom.plans.pages import glob_regex

    hits = {("src/**", "src/a/b.ts"): True, ("src/*", "src/a/b.ts"): False, ("**/*.test.ts", "a.test.ts"): True, ("**/*.test.ts", "x/y/a.test.ts"): True, ("src/a", "src/a/b"): True, ("src/a", "src/ab"): False, ("a+b/*", "a+b/c"): True}
    for (g, p), want in hits.items():
        assert bool(re.search(glob_regex(g), p)) == want, (g, p)
