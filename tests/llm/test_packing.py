import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm.packing import VOCABULARY, encoder, pack, packed, pieces, p8_containers, token_sizes
from driftloom.sources.tables import table

pytest.importorskip("tiktoken")


@pytest.mark.parametrize("text", ["word " * 900, "\U0001f600" * 300, "абв где " * 200, "a" * 3000, "\n" * 2000, "漢字" * 300, "x\n\n\n  y  " * 300])
def test_pieces_cover_and_fit(text):
    enc = encoder(VOCABULARY)
    for cap in (16, 64):
        p = pieces(text, enc.encode_ordinary(text), cap, enc)
        assert p[0][0] == 0 and p[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(p, p[1:]))
        assert all(n <= cap and n == len(enc.encode_ordinary(text[a:b])) for a, b, n in p)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_limits_hold_and_little_is_unused(seed):
    rng = np.random.default_rng(seed)
    n = 600
    sizes = np.stack([rng.integers(1, 400, n), np.ones(n), np.zeros(n)], axis=1).astype(float)
    sizes[:, 2] = np.where(rng.random(n) < 0.3, sizes[:, 0], 0)
    limits = np.asarray([512.0, 8.0, 400.0])
    out = pack(sizes, limits)
    load = np.zeros((out.max() + 1, 3))
    np.add.at(load, out, sizes)
    assert (load <= limits + 1e-6).all() and set(out.tolist()) == set(range(out.max() + 1))
    assert 1 - sizes[:, 0].sum() / 512 / len(load) < 0.05


def test_pack_nothing():
    assert len(pack(np.zeros((0, 3)), np.ones(3))) == 0


def test_every_document_is_placed_once(spark, data):
    docs = table(spark, data, "documents")
    p = p8_containers(spark, data).cache()
    n = docs.filter("length(text) > 0").count()
    assert [r.n for r in p.groupBy("capacity").agg(F.countDistinct("doc_id").alias("n")).collect()] == [n, n]
    load = p.groupBy("capacity", "container_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.min("piece").alias("m"))
    assert load.filter("t > capacity OR k > 16 * capacity / 1024").count() == 0
    dense = load.groupBy("capacity").agg(F.max("container_no").alias("x"), F.count("*").alias("k")).collect()
    assert all(r.x + 1 == r.k for r in dense)
    cover = p.groupBy("capacity", "doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("c")).join(docs.select("doc_id", "n_chars"), "doc_id")
    assert cover.filter("c <> n_chars").count() == 0
    whole = p.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    assert whole.filter("k > 1 AND t <= capacity - 8").count() == 0


def test_odd_tables(spark):
    schema = "doc_id long, text string, kind string, capacity string"
    rows = [(1, None, "page", "c"), (2, "", "page", "c"), (3, "hello world", None, "c"), (4, "hello world", "answer", "c"), (5, "same " * 50, "answer", "c")]
    df = spark.createDataFrame(rows, schema)
    got = packed(token_sizes(df, [16])).collect()
    assert {r.doc_id for r in got} == {3, 4, 5} and all(r.n_tokens <= 16 for r in got)
    assert packed(token_sizes(df.limit(0), [16])).count() == 0


def test_a_giant_document_is_spread(spark):
    rows = [(512, 1, "page", k, 0, 1, 500) for k in range(20_000)] + [(512, 2, "page", 0, 0, 1, 12)]
    items = spark.createDataFrame(rows, "capacity int, doc_id long, kind string, piece int, start_char int, end_char int, n_tokens int")
    got = packed(items, block_items=1000, loss_kinds=())
    assert got.count() == 20_001 and got.select("container_no").distinct().count() <= 20_001
    assert got.groupBy("container_no").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 512
