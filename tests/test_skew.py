"""A third of all rows under one key, in small."""

import random

from pyspark.sql import functions as F

from driftloom.operators import graphs as G
from driftloom.operators.orphans import orphan_references
from driftloom.operators.snapshot_diff import snapshot_changes


def test_one_parent_for_a_third_of_all_references(spark):
    rng = random.Random(0)
    keys = [("p", i) for i in range(40)]
    refs = [("p", 7, i) for i in range(400)] + [("p", rng.randrange(80), i) for i in range(800)]
    r, k = spark.createDataFrame(refs, "a string, b int, n int"), spark.createDataFrame(keys, "a string, b int")
    for salt in (1, 16):
        got = sorted((x.b, x.n) for x in orphan_references(r, k, ["a", "b"], "partial", salt).collect())
        assert got == sorted((b, n) for _, b, n in refs if b >= 40)


def test_one_owner_with_a_third_of_all_records(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for o, n in (("hot", 900), *((f"o{i}", 45) for i in range(40))):
        old = {f"{o}/{i}": rng.randrange(5) for i in range(n)}
        new = dict(old)
        for k in rng.sample(sorted(old), n // 9):
            if rng.random() < 0.5:
                new[k] = old[k] + 1
                want.add((o, 2, k, "changed"))
            else:
                del new[k]
                want.add((o, 2, k, "removed"))
        for i in range(n // 15):
            new[f"{o}/new{i}"] = 0
            want.add((o, 2, f"{o}/new{i}", "added"))
        rows += [(o, 1, k, str(v)) for k, v in old.items()] + [(o, 2, k, str(v)) for k, v in new.items()]
    df = spark.createDataFrame(rows, "o string, s int, k string, v string")
    got = {tuple(r) for r in snapshot_changes(df, "o", "s", "k", {"v": F.col("v")}, cells=48, rows_per_bucket=64).collect()}
    assert got == want


def test_a_hub_in_a_graph(spark):
    arcs = [("g", "hub", f"n{i:03d}") for i in range(150)] + [("g", f"n{i:03d}", "hub") for i in range(0, 150, 2)] + [("g", "z1", "z2")]
    edges = spark.createDataFrame(arcs, "owner string, src string, dst string")
    nodes = spark.createDataFrame(sorted({(o, x) for o, a, b in arcs for x in (a, b)}), "owner string, node string")
    scc = {r.node: r.scc for r in G.strong_components(nodes, edges).collect()}
    assert all(scc[f"n{i:03d}"] == ("hub" if i % 2 == 0 else f"n{i:03d}") for i in range(150)) and scc["z1"] == "z1"
    assert {r.wave for r in G.waves(nodes, edges).filter("node = 'hub'").collect()} == {1}
