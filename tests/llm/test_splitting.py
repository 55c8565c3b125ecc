import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm.splitting import p3_chunks, p3_found, p3_pieces, prose_levels, source_levels, split, split_files, statement_starts

SRC = """#!/usr/bin/env node
// head
import a from 'a'; // trailing note

/* about f */
// more
function f() {
  // inside
  return `
function fake() {}
`;
}; export const b = 1
// before c
c()
/** last */
@dec class D {}
// tail
"""


def test_statement_starts_with_their_comments():
    s = statement_starts(SRC, "ts")
    assert [SRC[x : x + 12] for x in s] == ["// head\nimpo", "/* about f *", "export const", "// before c\n", "/** last */\n"]


def test_starts_after_a_failure():
    t = "let a = 1\nfoo( {\n  bar\nlet b = 2\n  let c\nfunction d() {}\n"
    assert [t[x : x + 6] for x in statement_starts(t, "js")] == ["let a ", "foo( {", "let b ", "let c\n", "functi"] or [t[x : x + 6] for x in statement_starts(t, "js")][:3] == ["let a ", "foo( {", "let b "]
    assert statement_starts("", "js") == [] and statement_starts("// x", "js") == []


@given(st.text(alphabet="ab .\n#é😀", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_overlap_and_fit(text, limit, overlap):
    if not text:
        return
    p = split(len(text), limit, overlap, prose_levels(text))
    assert p[0][0] == p[0][1] == 0 and p[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(p, p[1:])) and all(e - s <= limit and e > c and c - s == min(overlap, c) for s, c, e, _ in p)


def test_cuts_at_the_coarsest_boundary():
    src = "function a() {\n  return 1\n}\n" * 20
    p = split(len(src), 100, 10, source_levels(src, statement_starts(src, "js")))
    assert {x[3] for x in p[1:]} == {0} and all(src[c:].startswith("function") for _, c, _, _ in p)
    with pytest.raises(ValueError):
        split(10, 5, 5, prose_levels("x" * 10))


def test_operator(spark, data):
    limits = spark.createDataFrame([("source_file", "js", "char", 50, 5), ("source_file", "js", "char", 50, 5), ("document", "any", "token", 9, 0)], "item_kind string, applies_to string, unit string, max_size int, overlap int")
    rows = [(1, "a.js", "let a = 1\n" * 8, 1), (2, "b.js", "x", 1), (3, "c.js", None, 1), (4, "d.js", "", 1), (5, "e.ts", "let a = 1\n" * 80, 1), (6, "f.js", "x" * 500, 1), (7, None, "x" * 500, 1)]
    df = spark.createDataFrame(rows, "file_id long, path string, source string, part int")
    got = {r.file_id: r for r in split_files(df, limits).collect()}
    assert set(got) == {1, 6} and got[1].boundaries == list(range(10, 80, 10)) and got[6].boundaries == []
    assert {p.boundary for p in got[6].pieces} == {"start", "character"}
    assert split_files(df.limit(0), limits).count() == 0 and split_files(df, limits.limit(0)).count() == 0
    assert p3_found(spark, data).filter("start_offset <= 0").count() == 0
    assert p3_pieces(spark, data).filter("end_offset <= content_start").count() == 0


def test_chunks_of_an_earlier_run(spark, data, tmp_path):
    src = "let a = 1\n" * 500  # 5000 characters, over the limit of js
    files = spark.createDataFrame([(1, "r", "a.js", src), (2, "r", "b.js", "let b")], "file_id long, repo string, path string, source string")
    cover = [(1, "r1", 1, 1, [("a.js", 0, 2000)]), (2, "r1", 1, 2, [("a.js", 1990, 3995)]), (3, "r1", 1, 3, [("a.js", 4100, 5000)]), (4, "r2", 1, 1, [("a.js", 0, 5000)]), (5, "r2", 1, 2, None), (6, "r2", 2, 1, [("b.js", 0, 5)])]
    chunks = spark.createDataFrame(cover, "chunk_id long, run_id string, file_id long, part int, coverage array<struct<path string, startOffset int, endOffset int>>")
    files.write.parquet(f"{tmp_path}/source_files.parquet")
    chunks.write.parquet(f"{tmp_path}/writer_chunks.parquet")
    spark.read.parquet(f"{data}/size_limits.parquet").write.parquet(f"{tmp_path}/size_limits.parquet")
    got = {r.chunk_id: (r.at_boundary, r.n_repeated, r.n_left_out, r.n_over) for r in p3_chunks(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 0, 0, 0), 2: (True, 10, 0, 0), 3: (True, 0, 105, 0), 4: (True, 0, 0, 1000)}
    assert p3_found(spark, str(tmp_path)).count() == 499
    assert p3_chunks(spark, data).count() > 0
