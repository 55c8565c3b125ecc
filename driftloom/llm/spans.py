"""Long exact spans shared between records, by suffix trees partitioned by prefix.

A suffix tree over every position of the corpus cannot be moved; one over chosen positions can.  Positions are chosen
by their text alone: of every `min_span - prefix + 1` consecutive windows of `prefix` characters, the one with the
smallest hash (its rightmost occurrence).  Two texts that share `min_span` characters therefore choose at least one
common position inside them, and the suffixes of the chosen positions, extended to the left, give every shared span.

Suffixes are partitioned by their first `prefix` characters; a prefix that only one text has is dropped before any
text is moved.  Where more than `split_over` suffixes start alike, the partition is split by longer prefixes: by
windows of nearly `min_span` characters around the position, at every split of that length into left and right.  Each
suffix then is in several smaller partitions, and any two that share a span are together in at least one.  A task takes
the partitions one after another; inside one, suffixes that branch off early enough to the right are paired by their
left context, so the deep nodes of the partition's tree give the maximal repeats.

Copies of a text are one class; only its first record takes part, and results are carried over to the members.

Defined results: null and empty texts share nothing; texts shorter than `min_span` share nothing, copies included;
spans are in code points; repeated rows of one id count once; an empty table gives an empty result.

Scale: about 2 / (min_span - prefix + 2) of the positions are chosen; they travel as a hash and an offset.  Texts are
shuffled once, by id, to cut the contexts of repeated prefixes out of them.  The pairs themselves are the output.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.session import cut_lineage
from driftloom.sources.tables import table

MIN_SPAN, PREFIX, SPLIT_OVER, STEP = 300, 100, 48, 20
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Powers:
    def __init__(self):
        self.up, self.down = _powers(_B, 1), _powers(_BINV, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_B, n), _powers(_BINV, n)
        return self.up[:n], self.down[:n]


def window_hashes(codes: np.ndarray, k: int, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of every window of k code points, the same for equal windows at any position."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def chosen_positions(h: np.ndarray, w: int) -> np.ndarray:
    """Of every w consecutive windows the position of the smallest hash, rightmost of equals; all windows if fewer."""
    n = len(h)
    if n <= w:
        return np.asarray([n - 1 - int(np.argmin(h[::-1]))], np.int64) if n else np.zeros(0, np.int64)
    pad = -n % w
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    right = np.minimum.accumulate(full, axis=1).ravel()
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(left[: n - w + 1], right[w - 1 : n])
    # a position is chosen when it equals the minimum of a window whose later part holds no equal value
    cand = np.flatnonzero((low[np.clip(np.arange(n), 0, n - w)] == h) | (low[np.clip(np.arange(n) - w + 1, 0, n - w)] == h) | _is_low(low, h, w))
    return _rightmost(cand, h, low, w)


def _is_low(low: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Whether h[i] is the minimum of any window that holds it: the greatest of the minima over those windows equals it."""
    n, m = len(h), len(low)
    pad = -m % w
    # the windows that hold i start at i-w+1 .. i; their greatest minimum by the same block trick
    full = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1 + pad, np.uint64)])
    full = np.concatenate([full, np.zeros(-len(full) % w, np.uint64)]).reshape(-1, w)
    right = np.maximum.accumulate(full, axis=1).ravel()
    left = np.maximum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    high = np.maximum(left[:n], right[w - 1 : n + w - 1])
    return high == h


def _rightmost(cand: np.ndarray, h: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """Drops candidates that in every window have an equal one to their right."""
    if len(cand) < 2:
        return cand
    keep = np.ones(len(cand), bool)
    same = (h[cand[1:]] == h[cand[:-1]]) & (np.diff(cand) < w)
    for i in np.flatnonzero(same).tolist():
        # the windows that hold cand[i] but not its equal neighbour start at or before cand[i+1] - w
        last = int(cand[i + 1]) - w
        first = max(0, int(cand[i]) - w + 1)
        keep[i] = last >= first and bool((low[first : last + 1] == h[cand[i]]).any())
    return cand[keep]


def _anchors(prefix: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            ids, keys, at = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                h = window_hashes(codes, prefix, powers)
                p = chosen_positions(h, window)
                ids.append(np.full(len(p), i, np.int64))
                keys.append(h[p].view(np.int64))
                at.append(p.astype(np.int32))
            if ids:
                yield pa.record_batch({"id": pa.array(np.concatenate(ids)), "pre": pa.array(np.concatenate(keys)), "pos": pa.array(np.concatenate(at))})

    return run


_ANCHORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("pre", T.LongType()), T.StructField("pos", T.IntegerType())])


def _contexts(min_span: int, prefix: int, split_over: int, step: int):
    """Cuts each position's left and right context out of its text and names the partitions it belongs to."""
    import xxhash

    back = min_span - prefix
    cuts = list(range(prefix, min_span, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("grp", "id", "pos", "l", "r")}

        def table_() -> pa.RecordBatch:
            rec = pa.record_batch([pa.array(out["grp"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["pos"], pa.int32()), pa.array(out["l"], pa.string()), pa.array(out["r"], pa.string())], names=list(out))
            for v in out.values():
                v.clear()
            return rec

        for b in batches:
            for i, t, ps in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("ps").to_pylist()):
                for p in ps:
                    pos, pre, n = p["pos"], p["pre"], p["n"]
                    left, right = t[max(0, pos - back) : pos], t[pos : pos + min_span]
                    groups = [pre]
                    if n > split_over:
                        groups = []
                        for c in cuts:
                            need = max(0, min_span - c - step)
                            if len(right) >= c and len(left) >= need:
                                groups.append(xxhash.xxh64_intdigest((left[len(left) - need :] + right[:c]).encode("utf-8", "surrogatepass"), seed=c) - (1 << 63))
                    for g in groups:
                        for k, v in zip(out, (g, i, pos, left, right)):
                            out[k].append(v)
                if len(out["grp"]) >= 10_000:
                    yield table_()
        yield table_()

    return run


_CONTEXTS = T.StructType([T.StructField("grp", T.LongType()), T.StructField("id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("l", T.StringType()), T.StructField("r", T.StringType())])
_REPEATS = T.StructType([T.StructField(c, T.LongType() if c[0] == "i" else T.IntegerType()) for c in ("id_a", "start_a", "end_a", "id_b", "start_b", "end_b")])


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def group_repeats(rows: list[tuple[int, int, str, str]], min_span: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The repeats of at least `min_span` characters through the positions of one partition.

    `rows`: (id, pos, reversed left context, right context).  The suffixes are sorted; the tree's nodes are walked by
    their depth, and two suffixes of different children are paired when their left contexts agree long enough.
    """
    rows = sorted(rows, key=lambda x: x[3])
    n = len(rows)
    if n == 2:
        pairs: Iterator[tuple[int, int, int]] = iter([(0, 1, common_prefix(rows[0][3], rows[1][3]))])
    else:
        pairs = _tree_pairs(rows, min_span)
    for i, j, right in pairs:
        a, b = rows[i], rows[j]
        if a[0] == b[0]:
            continue
        left = common_prefix(a[2], b[2])
        if left + right >= min_span:
            if a[0] > b[0]:
                a, b = b, a
            yield a[0], a[1] - left, a[1] + right, b[0], b[1] - left, b[1] + right


def _tree_pairs(rows: list[tuple[int, int, str, str]], min_span: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, depth) of suffixes that part at a node of that depth and agree in the `min_span - depth` characters before."""
    n = len(rows)
    lcp = [common_prefix(rows[i][3], rows[i + 1][3]) for i in range(n - 1)]
    # leaves are joined by falling depth: at a node its children are runs of leaves, in each run buckets by left context
    parent = list(range(n))
    runs = {i: [i] for i in range(n)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(range(n - 1), key=lambda k: -lcp[k]):
        depth = lcp[i]
        a, b = root(i), root(i + 1)
        need = max(0, min_span - depth)
        small, large = (runs[a], runs[b]) if len(runs[a]) <= len(runs[b]) else (runs[b], runs[a])
        if len(small) == 1 and len(large) <= 4:
            key = rows[small[0]][2][:need]
            if len(key) == need:
                for y in large:
                    if rows[y][2].startswith(key):
                        yield small[0], y, depth
        else:
            buckets: dict[str, list[int]] = defaultdict(list)
            for x in small:
                key = rows[x][2][:need]
                if len(key) == need:
                    buckets[key].append(x)
            if buckets:
                for y in large:
                    for x in buckets.get(rows[y][2][:need], ()):
                        yield x, y, depth
        large.extend(small)
        parent[b] = a
        runs.pop(b)
        runs[a] = large


def _repeats(min_span: int, pairs_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        out: list[tuple] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> None:
            if len(group) > 1:
                for x in group_repeats(group, min_span):
                    if pairs_only:
                        # the same pair through many positions is reported once per task
                        pair = (x[0], x[3])
                        if pair in seen:
                            continue
                        if len(seen) > 300_000:
                            seen.clear()
                        seen.add(pair)
                    out.append(x)

        def table_() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            rec = pa.record_batch([pa.array(c, pa.int64() if k in (0, 3) else pa.int32()) for k, c in enumerate(cols)], names=[f.name for f in _REPEATS])
            out.clear()
            return rec

        for b in batches:
            for g, i, p, left, right in zip(*(b.column(c).to_pylist() for c in ("grp", "id", "pos", "l", "r"))):
                if g != at:
                    flush()
                    at, group = g, []
                    if len(out) > 50_000:
                        yield table_()
                group.append((i, p, left[::-1], right))
        flush()
        yield table_()

    return run


def text_classes(docs: DataFrame) -> DataFrame:
    """(id, class_id, n_class, n_chars): records with the same text have the least of their ids as class."""
    rows = docs.filter(F.col("text").isNotNull()).select("id", F.sha2("text", 256).alias("digest"), F.char_length("text").alias("n_chars")).distinct()
    first = rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return rows.join(first, "digest").select("id", "class_id", "n_class", "n_chars")


def shared_spans(docs: DataFrame, classes: DataFrame, min_span: int = MIN_SPAN, prefix: int = PREFIX, split_over: int = SPLIT_OVER, step: int = STEP, pairs_only: bool = False) -> DataFrame:
    """Repeats (id_a, start_a, end_a, id_b, start_b, end_b), id_a < id_b, between the first records of text classes.

    A repeat longer than the context around one position comes in overlapping parts whose union is the whole.
    With `pairs_only`, most repeats of a pair after its first are left out.
    """
    long_enough = docs.filter(F.char_length("text") >= min_span).select("id", "text").dropDuplicates(["id"]) if not _unique(docs) else docs.filter(F.char_length("text") >= min_span).select("id", "text")
    window = min_span - prefix + 1
    anchors = cut_lineage(long_enough.mapInArrow(_anchors(prefix, window), _ANCHORS))
    firsts = classes.filter("id = class_id AND n_class > 1").select("id").unionByName(classes.filter("n_class = 1").select("id"))
    anchors = anchors.join(firsts, "id", "left_semi")
    counts = anchors.groupBy("pre").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("pre", "n")
    needed = anchors.join(counts, "pre").groupBy("id").agg(F.collect_list(F.struct("pos", "pre", "n")).alias("ps"))
    contexts = long_enough.join(needed, "id").select("id", "text", "ps").mapInArrow(_contexts(min_span, prefix, split_over, step), _CONTEXTS)
    return contexts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_repeats(min_span, pairs_only), _REPEATS)


def _unique(docs: DataFrame) -> bool:
    """Whether the caller marked ids as unique."""
    return "unique_ids" in docs.columns


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(True).alias("unique_ids"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of documents that share a span: pairs of classes, carried over to the classes' members."""
    docs = _docs(spark, sf_dir)
    classes = cut_lineage(text_classes(docs))
    pairs = shared_spans(docs, classes, pairs_only=True).select("id_a", "id_b").distinct()
    m = classes.select("class_id", "id")
    a = pairs.join(m.select(F.col("class_id").alias("id_a"), F.col("id").alias("x")), "id_a")
    between = a.join(m.select(F.col("class_id").alias("id_b"), F.col("id").alias("y")), "id_b").select("x", "y")
    copies = classes.filter(f"n_class > 1 AND n_chars >= {MIN_SPAN}").select("class_id", "id")
    within = copies.select("class_id", F.col("id").alias("x")).join(copies.select("class_id", F.col("id").alias("y")), "class_id").filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document that shares spans: characters found elsewhere, their share of the text, and the number of its text's copies."""
    docs = _docs(spark, sf_dir)
    classes = cut_lineage(text_classes(docs))
    spans = shared_spans(docs, classes)
    sides = spans.select(F.col("id_a").alias("id"), F.col("start_a").alias("s"), F.col("end_a").alias("e")).unionByName(spans.select(F.col("id_b").alias("id"), F.col("start_b").alias("s"), F.col("end_b").alias("e"))).distinct()
    order = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = sides.withColumn("before", before).select("id", (F.col("e") - F.greatest("s", F.least("e", F.coalesce("before", F.lit(0))))).alias("n")).groupBy("id").agg(F.sum("n").alias("n_shared"))
    per_class = classes.filter("id = class_id").select("class_id", "n_class", "n_chars").join(covered.withColumnRenamed("id", "class_id"), "class_id", "left")
    shared = F.when((F.col("n_class") > 1) & (F.col("n_chars") >= MIN_SPAN), F.col("n_chars")).otherwise(F.coalesce("n_shared", F.lit(0)))
    out = classes.select("id", "class_id").join(per_class.withColumn("shared", shared).filter("shared > 0"), "class_id")
    return out.select(F.col("id").alias("doc_id"), "class_id", F.col("n_class").alias("n_copies"), F.col("shared").cast("bigint").alias("n_shared"), F.round(F.col("shared") / F.col("n_chars"), 6).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_shared": p10_shared}
SQL: dict[str, str] = {}
