import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check

from driftloom.llm import leaks
from driftloom.llm.leaks import ItemBlock, align, leaked_passages, words_of


def brute(docs, items, run):
    grams = lambda t: {tuple(w[i : i + run]) for w in [words_of(t)] for i in range(len(w) - run + 1)}
    return {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}


def test_found_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(3, 40))) for i in range(25)] + [(90, None), (91, ""), (92, items_0 := text(30)), (93, items_0)]
    docs = [(i, text(80)) for i in range(40)]
    for i in range(40, 80):
        w = words_of(rng.choice(items[:25])[1])
        a = rng.randrange(max(1, len(w) - 8))
        docs.append((i, text(10) + " -- " + "_".join(w[a : a + rng.randrange(5, 16)]).upper() + "! " + text(10)))
    docs += [(200, None), (201, ""), (202, items_0), (203, items_0)]
    for block in (100_000, 150):
        got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4, 8, block)
        assert {(r.doc_id, r.item_id) for r in got.filter("run_words >= 8").collect()} == brute(docs, items, 8)


def test_edited_copies_score_high(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank while two crows watch from above"
    edited = item.replace("lazy", "sleepy").replace("crows", "big crows")
    docs = spark.createDataFrame([(1, "before " + edited + " after"), (2, "nothing of that kind here at all")], "doc_id long, text string")
    got = leaked_passages(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and got[0].similarity >= 0.8


def best_score(item, doc):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(doc, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_edited_copy_beside_an_exact_one(spark):
    item = [f"w{i}" for i in range(35)]
    edited = ["changed" if i in (11, 23) else w for i, w in enumerate(item)]
    spread = [w for i, x in enumerate(item) for w in ([x, "more"] if i % 3 == 2 else [x])]  # no 5-gram of the item is left
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(edited)), (3, " ".join(spread))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in leaked_passages(docs, items, near=0.8).filter("similarity >= 0.8").collect()}
    assert got == {1: 1.0, 2: 0.914, 3: 0.842}


def test_near_copies_equal_plain_smith_waterman(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randrange(5, 40))) for i in range(12)]
    docs = []
    for i in range(90):
        copy = []
        for w in rng.choice(items)[1]:
            how = rng.random()
            copy += [] if how < 0.04 else [rng.choice(vocab)] if how < 0.08 else [w, *text(rng.randrange(1, 3))] if how < 0.2 else [w]
        docs.append((i, text(rng.randrange(60)) + copy + text(rng.randrange(60))))
    want = {(d, i): s * 1000 // (2 * len(x)) for d, t in docs for i, x in items if (s := best_score(x, t)) >= 1.6 * len(x)}
    joined = lambda rows: [(k, " ".join(w)) for k, w in rows]
    got = leaked_passages(spark.createDataFrame(joined(docs), "doc_id long, text string"), spark.createDataFrame(joined(items), "item_id long, text string"), near=0.8)
    assert len(want) > 30 and {(r.doc_id, r.item_id): round(r.similarity * 1000) for r in got.filter("similarity >= 0.8").collect()} == want


@pytest.mark.parametrize("share,least", [(0.1, 0.98), (0.15, 0.95), (0.2, 0.9)])
def test_recall_of_replaced_words(spark, share, least):
    """Items of 80 words with a share of their words replaced, in documents of like words; unrelated documents beside them."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: text(80) for i in range(40)}
    docs = {}
    for i in range(40):
        for k in range(3):
            docs[i * 10 + k] = text(60) + [rng.choice(vocab) if rng.random() < share else w for w in items[i]] + text(60)
        docs[5000 + i] = text(200)
    joined = lambda rows: [(k, " ".join(w)) for k, w in rows.items()]
    got = leaked_passages(spark.createDataFrame(joined(docs), "doc_id long, text string"), spark.createDataFrame(joined(items), "item_id long, text string"), near=0.8)
    hits = {(r.doc_id, r.item_id) for r in got.filter(f"matched >= {leaks.EDITED_WORDS} AND identity >= {leaks.IDENTITY}").collect()}
    right = {(d, d // 10) for d in docs if d < 5000}
    assert len(hits & right) >= least * len(right) and len(hits & right) >= 0.98 * len(hits)


def test_insertions_and_parts_of_items(spark):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(80)]
    other = lambda n: [f"o{rng.randrange(9999)}" for _ in range(n)]
    docs = {1: other(30) + item[:40] + other(25) + item[40:] + other(9), 2: item[:40] + other(40) + item[40:], 3: other(50) + item[:48] + other(50)}
    got = leaked_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: (r.matched, r.run_words) for r in got.collect()} == {1: (80, 40), 2: (80, 40), 3: (48, 48)}
    assert {r.doc_id: r.identity for r in got.collect()}[3] == 1.0


def test_long_items_are_whole_in_similarity(spark):
    item = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:300]))], "doc_id long, text string")
    got = {r.doc_id: r for r in leaked_passages(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got[1].similarity == 1.0 and got[2].similarity < 0.4 and got[2].identity == 1.0 and got[2].matched == 300


def test_many_items_take_two_passes(spark):
    """A hundred thousand items are one block."""
    rng = random.Random(6)
    items = [(i, " ".join(f"v{rng.randrange(30_000)}" for _ in range(14))) for i in range(100_000)]
    docs = spark.createDataFrame([(i, "x " + items[i * 997][1] + " y") for i in range(50)], "doc_id long, text string")
    got = leaked_passages(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.filter("run_words >= 12").collect()} == {(i, i * 997) for i in range(50)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_long_items_are_cut_with_overlap():
    b = ItemBlock([(1, " ".join(f"a{i}" for i in range(100)))], 4, 8, 32)
    covered = {tuple(ids[i : i + 8]) for _, ids in b.parts for i in range(len(ids) - 7)}
    assert len(covered) == 93


@given(st.lists(st.integers(1, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_alignment_equals_plain_smith_waterman(item, doc):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    r = np.zeros_like(h)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(doc, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            r[i, j] = r[i - 1, j - 1] + 1 if x == y else 0
    s, matched, run = align(np.asarray(item, np.int32), np.asarray([doc], np.int32))
    assert 0 <= 3 * matched[0] - s[0] <= len(item) + len(doc) and (s[0] > 0) == (matched[0] > 0)
    assert (s[0], run[0]) == (h.max(), r.max())


def test_empty_and_sql(spark, data):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaked_passages(none, items).count() == 0
    assert leaked_passages(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items.limit(0)).count() == 0
    check(spark, leaks.p9_found, leaks.SQL["p9_found"], data)
