import random

import numpy as np
from pyspark.sql import functions as F

from driftloom.operators.snapshot_diff import _cell_hash, _pair_hash, peel, snapshot_changes, xxhash64_long
from driftloom.plans.snapshots import canonical_hash


def brute(rows):
    by = {}
    for o, s, k, v, w in rows:
        slot = by.setdefault(o, {}).setdefault(s, {}).setdefault(k, [None, None])
        for i, x in enumerate((v, w)):
            if x is not None and (slot[i] is None or False):
                slot[i] = x
    out = set()
    for o, snaps in by.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            for k in snaps[a].keys() | snaps[b].keys():
                if k not in snaps[a]:
                    out.add((o, b, k, "added"))
                elif k not in snaps[b]:
                    out.add((o, b, k, "removed"))
                elif any(x is not None and y is not None and x != y for x, y in zip(snaps[a][k], snaps[b][k])):
                    out.add((o, b, k, "changed"))
    return out


def changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "o string, s int, k string, v string, w string, owner int") if rows and len(rows[0]) == 6 else spark.createDataFrame(rows, "o string, s int, k string, v string, w string")
    return {tuple(r) for r in snapshot_changes(df, "o", "s", "k", {"v": F.col("v"), "w": F.col("w")}, **kw).collect()}


def history(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for o in ("big", "small", "once"):
        state = {f"{o}{i}": (str(rng.randrange(9)), None) for i in range(n if o == "big" else 5)}
        for s in [1, 2, 4, 5][: 1 if o == "once" else 4]:
            rows += [(o, s, k, v, w) for k, (v, w) in state.items()]
            for k in rng.sample(sorted(state), len(state) // 6):
                state.pop(k) if rng.random() < 0.3 else state.__setitem__(k, (rng.choice([None, "x", "y"]), rng.choice([None, "z"])))
            state[f"{o}new{s}"] = ("n", "m")
    return rows


def test_equals_brute_force(spark):
    rows = history(1)
    assert changes(spark, rows) == brute(rows)


def test_small_tables_are_enlarged_until_they_peel(spark):
    rows = history(2, 60)
    assert changes(spark, rows, cells=6, rows_per_bucket=64) == brute(rows)


def test_buckets_that_never_peel_are_compared_as_records(spark):
    rows = history(3, 40)
    assert changes(spark, rows, cells=3, rows_per_bucket=1000, max_rounds=1) == brute(rows)


def test_repeats_nulls_and_clashing_columns(spark):
    rows = [("o", 1, "a", "1", None), ("o", 1, "a", "1", None), ("o", 1, None, "1", None), ("o", 2, "a", None, "2"), ("o", 2, None, "2", None), ("o", 2, "b", None, None)]
    assert changes(spark, rows) == {("o", 2, None, "changed"), ("o", 2, "b", "added")}
    assert changes(spark, [(*r, 7) for r in rows]) == {("o", 2, None, "changed"), ("o", 2, "b", "added")}


def test_empty(spark):
    assert changes(spark, []) == set()


def test_hash_is_the_engines(spark):
    xs = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    want = [r[0] for r in df.select(F.xxhash64("x", F.lit(1001).cast("bigint"))).collect()]
    got = _pair_hash(np.asarray(xs, np.int64).view(np.uint64), 1001).view(np.int64).tolist()
    assert got == want
    assert xxhash64_long(np.asarray([5], np.uint64), 42).view(np.int64)[0] == spark.sql("select xxhash64(5L)").first()[0]


def test_peel_recovers_differences():
    rng = np.random.default_rng(0)
    k, v = rng.integers(-(2**62), 2**62, 40), rng.integers(-(2**62), 2**62, 40)
    cells, own, cell, cnt, kx, vx, cx = 150, [], [], [], [], [], []
    table = {}
    for i in range(40):
        sign = 1 if i % 2 else -1
        for h in range(3):
            at = h * 50 + int(_cell_hash(k[i : i + 1].view(np.uint64), h)[0] % 50)
            c = table.setdefault(at, [0, 0, 0, 0])
            c[0] += sign
            c[1] ^= int(k[i])
            c[2] ^= int(v[i])
            c[3] ^= int(_pair_hash(k[i : i + 1].view(np.uint64), v[i : i + 1]).view(np.int64)[0])
    for at, c in table.items():
        own.append(0), cell.append(at), cnt.append(c[0]), kx.append(c[1]), vx.append(c[2]), cx.append(c[3])
    a = lambda x: np.asarray(x, np.int64)
    _, gk, gv, sign, failed = peel(a(own), a(cell), a(cnt), a(kx), a(vx), a(cx), 1, cells)
    assert not failed.any() and dict(zip(gk.tolist(), gv.tolist())) == dict(zip(k.tolist(), v.tolist())) and sorted(sign) == [-1] * 20 + [1] * 20


def test_spelling_of_hashes(spark):
    df = spark.createDataFrame([("sha256:AB",), (" ab ",), ("",), (None,), ("md5: ab",)], "h string")
    assert [r[0] for r in df.select(canonical_hash(F.col("h"))).collect()] == ["ab", "ab", None, None, "ab"]
