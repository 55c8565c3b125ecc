"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

Every snapshot is summed up per hash bucket of its keys in an invertible Bloom lookup table: each (key hash, value
hash) pair is added to three cells, a cell holding a count and the exclusive-or of its pairs.  Subtracting the tables
of two consecutive snapshots leaves the pairs in which they differ; those are peeled off cell by cell.  A bucket whose
table was too small to peel is built again with more cells, from the rows of the failed buckets only.  The recovered
key hashes then fetch their records from both snapshots, which are compared value by value, each value by its 64-bit hash.

Why not join the snapshots: the tables are a fixed fraction of the rows, are summed before the shuffle, and only
records that differ are compared; what does not change between deliveries is never joined with itself.

Defined results: exact repeats of a record in one snapshot count once; a key repeated with different values takes the
greatest value per column; a null key is a key like any other; a value that is null on one side does not count as
changed; the first delivery of an entity yields nothing; an empty table yields nothing; further columns are ignored.

Scale: keys of one large owner are split over as many buckets as its rows need, so a hot owner is not one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftloom.session import cut_lineage

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_HASHES = 3


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_long(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8-byte integers, the same as the engine's xxhash64 of a BIGINT column with that seed."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=np.uint64) + _P5 + np.uint64(8)
        h = h ^ (_rotl(values.astype(np.uint64) * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))


def _pair_hash(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    first = xxhash64_long(a, 42)
    return xxhash64_long(np.broadcast_to(np.asarray(b, dtype=np.int64).view(np.uint64) if isinstance(b, np.ndarray) else np.uint64(b), a.shape), first)


def peel(owner: np.ndarray, cell: np.ndarray, cnt: np.ndarray, kx: np.ndarray, vx: np.ndarray, cx: np.ndarray, n_owner: int, cells: int):
    """Peel many subtracted tables at once.

    `owner` numbers the table of each cell.  Returns (owner, key hash, value hash, sign) of the recovered pairs and
    a mask of the tables that did not peel empty.
    """
    sub = cells // _HASHES
    t_cnt = np.zeros(n_owner * cells, dtype=np.int64)
    t_k, t_v, t_c = (np.zeros(n_owner * cells, dtype=np.uint64) for _ in range(3))
    at = owner * cells + cell
    t_cnt[at], t_k[at], t_v[at], t_c[at] = cnt, kx.view(np.uint64), vx.view(np.uint64), cx.view(np.uint64)
    out: list[tuple[np.ndarray, ...]] = []
    live = np.unique(at)
    while live.size:
        one = live[np.abs(t_cnt[live]) == 1]
        if not one.size:
            break
        k, v = t_k[one], t_v[one]
        pure = one[_pair_hash(k, v.view(np.int64)) == t_c[one]]
        if not pure.size:
            break
        own, k, v, sign = pure // cells, t_k[pure], t_v[pure], np.sign(t_cnt[pure])
        _, first = np.unique(np.stack([own.astype(np.uint64), k, v, sign.astype(np.uint64)]), axis=1, return_index=True)
        own, k, v, sign = own[first], k[first], v[first], sign[first]
        check = _pair_hash(k, v.view(np.int64))
        touched = []
        for i in range(_HASHES):
            where = own * cells + i * sub + (_cell_hash(k, i) % np.int64(sub))
            np.subtract.at(t_cnt, where, sign)
            for t, x in ((t_k, k), (t_v, v), (t_c, check)):
                np.bitwise_xor.at(t, where, x)
            touched.append(where)
        out.append((own, k.view(np.int64), v.view(np.int64), sign))
        live = np.unique(np.concatenate(touched))
    left = np.flatnonzero((t_cnt != 0) | (t_k != 0) | (t_v != 0) | (t_c != 0))
    failed = np.zeros(n_owner, dtype=bool)
    failed[left // cells] = True
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, failed
    return (*(np.concatenate(x) for x in zip(*out)), failed)


def _cell_hash(k: np.ndarray, i: int) -> np.ndarray:
    """Non-negative remainder source: the upper 63 bits' non-negative value of the pair hash."""
    return (_pair_hash(k, 1000 + i) >> np.uint64(1)).view(np.int64)


def _cell_column(i: int, sub: int) -> Column:
    return (F.lit(i * sub) + F.pmod(F.shiftrightunsigned(F.xxhash64("kh", F.lit(1000 + i).cast("bigint")), 1), F.lit(sub).cast("bigint"))).cast("int")


_CELL = ["oh", "delivery", "bucket", "cell", "cnt", "kx", "vx", "cx"]


def _peeler(cells: int, tables_at_once: int = 256):
    """Peels tables from rows sorted by table; a table that spans two batches waits for its rest."""

    def peeled(cols: dict[str, np.ndarray], starts: np.ndarray):
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cols["cell"]))))
        own, k, _, _, failed = peel(owner, cols["cell"].astype(np.int64), cols["cnt"], cols["kx"], cols["vx"], cols["cx"], len(starts), cells)
        # what a failed table gave before it stuck is dropped: it is peeled again from a larger one
        good = ~failed[own] if own.size else np.zeros(0, dtype=bool)
        bad = np.flatnonzero(failed)
        at = starts[np.concatenate([own[good], bad])]
        n, m = int(good.sum()), len(bad)
        return pa.record_batch(
            {
                "oh": pa.array(cols["oh"][at]), "delivery": pa.array(cols["delivery"][at]), "bucket": pa.array(cols["bucket"][at]),
                "kh": pa.array(np.concatenate([k[good], np.zeros(m, np.int64)])), "failed": pa.array(np.arange(n + m) >= n),
            }
        )

    def run(batches):
        rest: dict[str, np.ndarray] | None = None
        for b in batches:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in _CELL}
            if rest is not None:
                cols = {c: np.concatenate([rest[c], cols[c]]) for c in _CELL}
            n = len(cols["cell"])
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            new[0] = True
            for c in _CELL[:3]:
                new[1:] |= cols[c][1:] != cols[c][:-1]
            starts = np.flatnonzero(new)
            for i in range(0, len(starts) - 1, tables_at_once):
                j = min(i + tables_at_once, len(starts) - 1)
                part = {c: cols[c][starts[i] : starts[j]] for c in _CELL}
                yield peeled(part, starts[i:j] - starts[i])
            rest = {c: cols[c][starts[-1] :] for c in _CELL}
        if rest is not None and len(rest["cell"]):
            yield peeled(rest, np.zeros(1, dtype=np.int64))

    return run


def recovered_differences(pairs: DataFrame, steps: DataFrame, cells: int, rows_per_bucket: int, max_rounds: int) -> DataFrame:
    """(oh, delivery, kh) of every pair in which consecutive snapshots differ.

    `pairs`: distinct (oh, snapshot, kh, vh), oh the owner's hash; `steps`: (oh, delivery, previous).
    """
    sizes = pairs.groupBy("oh", "snapshot").count().groupBy("oh").agg(F.max("count").alias("n"))
    buckets = sizes.select("oh", F.ceil(F.col("n") / rows_per_bucket).cast("bigint").alias("n_buckets"))
    rows = pairs.join(buckets, "oh").withColumn("bucket", F.pmod(F.xxhash64("kh", F.lit(7)), F.col("n_buckets")).cast("int")).drop("n_buckets")
    # a snapshot's table counts up in its own delivery and down in the one that follows it
    signs = steps.select(
        "oh", F.explode(F.array(F.struct(F.col("delivery").alias("snapshot"), "delivery", F.lit(1).alias("sign")), F.struct(F.col("previous").alias("snapshot"), "delivery", F.lit(-1).alias("sign")))).alias("s")
    ).select("oh", "s.*")
    found: DataFrame | None = None
    todo: DataFrame | None = None
    for _ in range(max_rounds):
        sub = -(-cells // _HASHES)
        base = rows if todo is None else rows.join(todo.select("oh", "bucket").distinct(), ["oh", "bucket"], "left_semi")
        single = (
            base.select("oh", "snapshot", "bucket", "kh", "vh", F.xxhash64("kh", "vh").alias("cx"), F.explode(F.array(*[_cell_column(i, sub) for i in range(_HASHES)])).alias("cell"))
            .groupBy("oh", "snapshot", "bucket", "cell")
            .agg(F.count(F.lit(1)).alias("cnt"), F.bit_xor("kh").alias("kx"), F.bit_xor("vh").alias("vx"), F.bit_xor("cx").alias("cx"))
        )
        signed = single.join(signs, ["oh", "snapshot"]).select("oh", "delivery", "bucket", "cell", (F.col("cnt") * F.col("sign")).alias("cnt"), "kx", "vx", "cx")
        if todo is not None:
            signed = signed.join(todo, ["oh", "delivery", "bucket"], "left_semi")
        less = (
            signed.repartition("oh", "delivery", "bucket")
            .groupBy("oh", "delivery", "bucket", "cell")
            .agg(F.sum("cnt").alias("cnt"), F.bit_xor("kx").alias("kx"), F.bit_xor("vx").alias("vx"), F.bit_xor("cx").alias("cx"))
            .filter("cnt <> 0 OR kx <> 0 OR vx <> 0 OR cx <> 0")
            .select(*_CELL)
            .sortWithinPartitions("oh", "delivery", "bucket")
        )
        kind = dict(pairs.dtypes)["snapshot"]
        got = cut_lineage(less.mapInArrow(_peeler(sub * _HASHES), f"oh bigint, delivery {kind}, bucket int, kh bigint, failed boolean"))
        done = got.filter("NOT failed").select("oh", "delivery", "kh")
        found = done if found is None else found.unionByName(done)
        todo = got.filter("failed").select("oh", "delivery", "bucket")
        if todo.isEmpty():
            return found.distinct()
        cells *= 4
    # tables that never peel (hash collisions): every key of the bucket becomes a candidate and is compared as a record
    rest = rows.join(todo, ["oh", "bucket"]).join(steps, ["oh", "delivery"]).filter("snapshot = delivery OR snapshot = previous")
    return found.unionByName(rest.select("oh", "delivery", "kh")).distinct()


def snapshot_changes(
    df: DataFrame, owner: str, snapshot: str, key: str, values: dict[str, Column], cells: int = 192, rows_per_bucket: int = 512, max_rounds: int = 6
) -> DataFrame:
    """(owner, snapshot, key, change) with change one of added, removed, changed, for every delivery after an owner's first.

    `values` names the compared columns with their canonical form; `cells` is the size of a bucket's first table.
    """
    names = list(values)
    vs = [f"v{i}" for i in range(len(names))]
    hashed = df.select(
        F.col(owner).alias("owner"), F.xxhash64(F.col(owner)).alias("oh"), F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("kh"),
        *[F.when(values[n].isNotNull(), F.xxhash64(values[n])).alias(v) for v, n in zip(vs, names)],
    )
    pairs = hashed.select("oh", "snapshot", "kh", F.xxhash64(*[F.coalesce(v, F.lit(0)) for v in vs]).alias("vh")).distinct()
    pairs = cut_lineage(pairs)  # read once more for sizes and for enlarged buckets
    order = Window.partitionBy("oh").orderBy("snapshot")
    steps = (
        pairs.select("oh", "snapshot").distinct()
        .select("oh", F.col("snapshot").alias("delivery"), F.lag("snapshot").over(order).alias("previous"))
        .filter("previous IS NOT NULL")
    )
    differing = recovered_differences(pairs, steps, cells, rows_per_bucket, max_rounds).join(steps, ["oh", "delivery"])
    wanted = differing.select(
        "oh", "delivery", "kh",
        F.explode(F.array(F.struct(F.col("delivery").alias("snapshot"), F.lit(True).alias("new")), F.struct(F.col("previous").alias("snapshot"), F.lit(False).alias("new")))).alias("s"),
    ).select("oh", "delivery", "kh", "s.snapshot", "s.new")
    records = hashed.join(wanted, ["oh", "snapshot", "kh"])
    sides = records.groupBy("owner", "delivery", "key").agg(
        F.bool_or("new").alias("in_new"),
        F.bool_or(~F.col("new")).alias("in_old"),
        *[F.max(F.when(F.col("new"), F.col(v))).alias(f"n_{v}") for v in vs],
        *[F.max(F.when(~F.col("new"), F.col(v))).alias(f"o_{v}") for v in vs],
    )
    differs = F.lit(False)
    for v in vs:
        differs = differs | F.coalesce(F.col(f"n_{v}") != F.col(f"o_{v}"), F.lit(False))
    change = F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "removed").when(differs, "changed")
    return sides.select(F.col("owner").alias(owner), F.col("delivery").alias(snapshot), F.col("key").alias(key), change.alias("change")).filter("change IS NOT NULL")
