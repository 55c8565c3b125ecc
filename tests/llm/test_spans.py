import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.llm.spans import _Powers, chosen_positions, p10_found, p10_shared, shared_spans, text_classes, window_hashes
from driftloom.session import cut_lineage

SPAN, PREFIX = 30, 10


def brute(docs, n):
    where = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    return {(a, b) for s in where.values() for a in s for b in s if a < b}


def found(spark, docs, **kw):
    df = spark.createDataFrame(docs, "id long, text string")
    classes = cut_lineage(text_classes(df))
    reps = {r.id: r.class_id for r in classes.collect()}
    got = {(r.id_a, r.id_b) for r in shared_spans(df, classes, SPAN, PREFIX, **kw).collect()}
    return {tuple(sorted((x, y))) for x in reps for y in reps if x != y and ((reps[x], reps[y]) in got or (reps[x] == reps[y] and len(dict(docs)[x]) >= SPAN))}


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh ä😀") for _ in range(k))
    shared = [word(rng.randrange(25, 60)) for _ in range(6)] + ["x" * 45, "ab" * 30]
    docs = []
    for i in range(n):
        t = word(rng.randrange(0, 50))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            t += s[rng.randrange(3) :] + word(rng.randrange(20))
        docs.append((i, t))
    return docs + [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, "")]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        assert found(spark, docs, step=4) == brute(docs, SPAN)


def test_hot_prefixes_are_split(spark):
    docs = corpus(5, 30)
    head = "".join(random.Random(9).choice("qrstuv") for _ in range(24))
    docs += [(200 + i, f"{i}-{head}{i * 7919}{'y' * (i % 9)}") for i in range(40)]
    assert found(spark, docs, split_over=3, step=4) == found(spark, docs, split_over=10_000, step=4) == brute(docs, SPAN)


def test_shared_characters(spark):
    docs = [(1, "q" * 5 + "the long and winding road that leads nowhere" + "z"), (2, "the long and winding road that leads nowhere" * 2), (3, "short")]
    df = spark.createDataFrame(docs, "id long, text string")
    s = shared_spans(df, text_classes(df), SPAN, PREFIX).filter("id_a = 1")
    marked = {k for r in s.collect() for k in range(r.start_a, r.end_a)}
    assert marked == set(range(5, 49))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=50), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_chosen_positions(values, w):
    h = np.asarray(values, np.uint64)
    n = len(h)
    spans = [(0, n)] if n <= w else [(i, i + w) for i in range(n - w + 1)]
    want = {max(j for j in range(a, b) if h[j] == h[a:b].min()) for a, b in spans}
    assert set(chosen_positions(h, w).tolist()) == want


def test_hashes_depend_on_the_window_only():
    codes = np.frombuffer(("abcde" * 3 + "xabcde").encode("utf-32-le"), np.uint32)
    h = window_hashes(codes, 5, _Powers())
    assert h[0] == h[5] == h[10] == h[16] and len(set(h[:5].tolist())) == 5


def test_queries(spark, data):
    assert p10_found(spark, data).filter(F.col("doc_id_a") >= F.col("doc_id_b")).count() == 0
    assert p10_shared(spark, data).filter("share <= 0 OR share > 1").count() == 0
    empty = spark.createDataFrame([], "id long, text string")
    assert shared_spans(empty, text_classes(empty)).count() == 0
