from driftloom.llm.truncation import field_limits, length_spikes, p1_found, truncated_values
from oracle import check
from driftloom.llm import truncation

SCHEMA = "t string, feed string, id long, text string, n int"


def values(spark, rows):
    return spark.createDataFrame([("t", f, i, x, 0) for i, (f, x) in enumerate(rows)], SCHEMA)


def test_limits_in_characters_and_bytes(spark):
    rows = [("a", "w" * 40 + "ä" * (i % 7) + ".") for i in range(60)] + [("a", "q" * 200) for _ in range(9)] + [("b", "й" * 50) for _ in range(9)] + [("b", "s" * i + ".") for i in range(30)]
    got = {(r.feed, r.unit, r.length) for r in length_spikes(values(spark, rows), ["t", "feed"], "text").collect()}
    assert got == {("a", "chars", 200), ("a", "bytes", 200), ("b", "chars", 50), ("b", "bytes", 100)}


def test_style_counts_at_a_limit_only(spark):
    at = "- one thing here\n- " + "x" * 11
    rows = [("a", at)] * 8 + [("a", "- one thing here\n- other")] + [("a", "A whole one.")] + [("a", None), ("a", " ")]
    got = [(r.at_limit, r.cut) for r in truncated_values(values(spark, rows), "feed", "t", "id", "text").orderBy("id").collect()]
    assert got == [("chars", "item")] * 8 + [(None, None)] * 3


def test_limit_that_many_uncut_values_exceed(spark):
    at = "- one thing here\n- " + "x" * 181
    rows = [("a", at)] * 20 + [("a", "w" * i + ".") for i in range(100, 400)] + [("a", "{}")] * 60
    assert {(r.unit, r.length) for r in field_limits(values(spark, rows), ["t", "feed"], "text").collect()} == {("chars", 200), ("bytes", 200)}
    got = truncated_values(values(spark, rows), "feed", "t", "id", "text")
    assert [(r.at_limit, r.cut) for r in got.filter("id < 20").collect()] == [("chars", "item")] * 20 and got.filter("id >= 20 AND cut IS NOT NULL").count() == 0


def test_empty_table_and_queries(spark, data):
    assert truncated_values(values(spark, []), "feed", "t", "id", "text").count() == 0
    assert p1_found(spark, data).columns == ["table_name", "record_id"]
    for name in truncation.SQL:
        check(spark, truncation.QUERIES[name], truncation.SQL[name], data.replace("sf0.001", "sf0.01"))


def test_both_routes(spark):
    rows = [("a", "The parser reads it and " + "x" * 176)] * 20 + [("a", "w" * i + ".") for i in range(100, 400)] + [("a", "The parser rea"), ("a", '{"a": "' + "y" * 191 + '"}')]
    got = truncated_values(values(spark, rows), "feed", "t", "id", "text")
    assert [(r.route, r.cut) for r in got.filter("cut IS NOT NULL").orderBy("id").collect()] == [("limit", "sentence")] * 20 + [("transfer", "sentence")]
    assert [r.at_limit for r in got.filter("id = 321").collect()] == ["chars"]
