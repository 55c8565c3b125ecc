"""A third of all rows under one value, in small."""

import random

from driftloom.llm.leaks import leaked_passages
from driftloom.llm.packing import packed, token_sizes
from driftloom.llm.spans import shared_spans, text_classes
from driftloom.llm.truncation import length_spikes


def _text(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(99)) for _ in range(n))


def test_one_item_in_a_third_of_all_documents(spark):
    rng = random.Random(2)
    item = _text(rng, 20)
    docs = [(i, _text(rng, 15) + " " + item + " " + _text(rng, 5)) for i in range(120)] + [(i, _text(rng, 40)) for i in range(120, 360)]
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, _text(rng, 20))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.filter("run_words >= 12").collect()) == list(range(120))


def test_copies_and_a_common_head_in_a_third_of_all_documents(spark):
    rng = random.Random(3)
    head, copy = _text(rng, 40)[:220], _text(rng, 80)
    docs = [(i, copy) for i in range(60)] + [(100 + i, head + _text(rng, 60)) for i in range(60)] + [(300 + i, _text(rng, 60)) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, text string")
    classes = text_classes(df)
    assert classes.filter("class_id = 0").count() == 60
    assert shared_spans(df, classes).count() == 0  # a head of 220 characters is no span of 300
    long_head = head + head[::-1][:100]
    docs = [(100 + i, long_head + _text(rng, 60)) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, text string")
    pairs = {(r.id_a, r.id_b) for r in shared_spans(df, text_classes(df), pairs_only=True).collect()}
    assert len(pairs) == 60 * 59 // 2


def test_equal_items_fill_containers(spark):
    df = spark.createDataFrame([(i, "one two three four", "page") for i in range(300)], "doc_id long, text string, kind string")
    p = packed(token_sizes(df, [64]), segments_per_1k=256, block_items=128).groupBy("container_no").count().collect()
    assert sum(r["count"] for r in p) == 300 and max(r["count"] for r in p) == 16 and len(p) <= 22


def test_one_feed_with_most_values(spark):
    rows = [("t", "hot", "x" * 30) for _ in range(500)] + [("t", "hot", "y" * i) for i in range(1, 25)] + [("t", "cold", "z" * i) for i in range(1, 25)]
    got = {(r.feed, r.unit, r.length, r.n) for r in length_spikes(spark.createDataFrame(rows, "t string, feed string, text string"), ["t", "feed"], "text").collect()}
    assert got == {("hot", "chars", 30, 500), ("hot", "bytes", 30, 500)}
