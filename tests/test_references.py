import pytest
from pyspark.sql import functions as F

from driftloom.functions.ids import canonical_id, canonical_path, strip_blank
from driftloom.operators.orphans import orphan_references, orphan_report

REFS = "a string, b int, who string"


def orphans(spark, refs, keys, **kw):
    r = spark.createDataFrame(refs, REFS)
    k = spark.createDataFrame(keys, "a string, b int")
    return sorted(((x.a, x.b, x.who, x.null_mask) for x in orphan_references(r, k, ["a", "b"], **kw).collect()), key=str)


ROWS = [("x", 1, "hit"), ("x", 2, "gone"), (None, 1, "half"), (None, 9, "half gone"), ("x", None, "other half"), (None, None, "none"), ("x", 2, "gone")]
KEYS = [("x", 1), ("x", 1), ("y", 5), (None, 7)]


def test_simple_match_takes_whole_keys_only(spark):
    assert orphans(spark, ROWS, KEYS) == [("x", 2, "gone", "11")] * 2


def test_partial_match_compares_what_is_there(spark):
    assert orphans(spark, ROWS, KEYS, match="partial") == sorted([("x", 2, "gone", "11")] * 2 + [(None, 9, "half gone", "01")], key=str)


def test_full_match_refuses_mixed_references(spark):
    got = orphans(spark, ROWS, KEYS, match="full")
    assert {x[2] for x in got} == {"gone", "half", "half gone", "other half"}


def test_salted_equals_plain_on_a_hot_key(spark):
    rows = [("hot", 1, f"w{i}") for i in range(200)] + [("hot", 2, "gone")]
    assert orphans(spark, rows, [("hot", 1)], salt=8) == orphans(spark, rows, [("hot", 1)]) == [("hot", 2, "gone", "11")]


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_empty_tables(spark, match):
    assert orphans(spark, [], KEYS, match=match) == []
    assert ("x", 1, "hit", "11") in orphans(spark, ROWS, [], match=match)


def test_reserved_names_and_rules(spark):
    r = spark.createDataFrame([("x", 1)], "a string, null_mask int")
    with pytest.raises(ValueError):
        orphan_references(r, r, ["a"])
    with pytest.raises(ValueError):
        orphan_references(r.select("a"), r, ["a"], match="some")


def test_report_counts(spark):
    r = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "t string, k int")
    gone = r.filter("k = 2")
    assert {tuple(x) for x in orphan_report(gone, r, ["t"]).collect()} == {("t", 2, 1, 0.5), ("u", 1, 0, 0.0)}


def test_canonical_ids(spark):
    given = ["  file:./a\\b.ts ", "symbol:.\\x\\y.ts#A.b\\c", "symbol:./././q.ts#N", "domain:./d", " ", None, "file:a/./b.ts", "​file:x.ts﻿", "File:./x"]
    want = ["file:a/b.ts", "symbol:x/y.ts#A.b\\c", "symbol:q.ts#N", "domain:./d", "", None, "file:a/./b.ts", "file:x.ts", "File:./x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    assert [r.y for r in df.select("i", canonical_id(F.col("x")).alias("y")).orderBy("i").collect()] == want
    p = spark.createDataFrame([(" ./a\\b ",)], "x string").select(canonical_path(strip_blank(F.col("x"))).alias("y")).first().y
    assert p == "a/b"
