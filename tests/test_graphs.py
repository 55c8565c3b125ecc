import random

from pyspark.sql import functions as F

from driftloom.operators import graphs as G

EDGES, NODES = "owner string, src string, dst string", "owner string, node string"


def brute(n, edges):
    """Components and waves of a small graph by closure."""
    reach = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[a] | reach[b]
            changed, reach[a] = changed or new != reach[a], new
    scc = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
    deps = {scc[i]: {scc[b] for a, b in edges if scc[a] == scc[i] and scc[b] != scc[i]} for i in range(n)}
    wave = {}

    def level(c):
        if c not in wave:
            wave[c] = max((level(d) + 1 for d in deps[c]), default=0)
        return wave[c]

    return {i: (scc[i], level(scc[i])) for i in range(n)}


def name(i):
    return f"n{i:05d}"


def test_components_and_waves_equal_brute_force(spark):
    rng = random.Random(2)
    graphs = {f"g{k}": (14, [(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randrange(6, 26))]) for k in range(8)}
    edges = spark.createDataFrame([(g, name(a), name(b)) for g, (_, es) in graphs.items() for a, b in es], EDGES)
    nodes = spark.createDataFrame([(g, name(i)) for g, (n, _) in graphs.items() for i in range(n)], NODES)
    want = {(g, name(i), name(c), w) for g, (n, es) in graphs.items() for i, (c, w) in brute(n, [e for e in es if e[0] != e[1]]).items()}
    assert {tuple(r) for r in G.waves(nodes, edges).select("owner", "node", "scc", "wave").collect()} == want


def test_long_paths_take_few_steps(spark, monkeypatch):
    n, steps = 600, []
    real = G.cut_step
    monkeypatch.setattr(G, "cut_step", lambda df: steps.append(1) or real(df))
    order = list(range(n))
    random.Random(1).shuffle(order)
    for ids in (order,):
        edges = spark.createDataFrame([("g", name(a), name(b)) for a, b in zip(ids, ids[1:])], EDGES)
        nodes = spark.createDataFrame([("g", name(i)) for i in ids], NODES)
        steps.clear()
        got = G.waves(nodes, edges).agg(F.max("wave"), F.count_distinct("scc")).first()
        assert tuple(got) == (n - 1, n) and len(steps) < 60, len(steps)
        steps.clear()
        assert G.components(nodes, edges).select("label").distinct().count() == 1 and len(steps) < 30, len(steps)
    short = order[:40]
    ring = spark.createDataFrame([("g", name(a), name(b)) for a, b in zip(short, short[1:] + short[:1])], EDGES)
    steps.clear()
    assert G.strong_components(spark.createDataFrame([("g", name(i)) for i in short], NODES), ring).select("scc").distinct().count() == 1 and len(steps) < 90, len(steps)
