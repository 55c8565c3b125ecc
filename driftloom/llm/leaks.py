"""Evaluation texts that leaked into training text.

Rare n-gram seeds join training passages to test items; Smith-Waterman alignment of the words around a seed scores exact,
edited and paraphrased copies.  The items are a stated query set: all of them are held against all documents in one pass
for the counts and one for the hits, as long as they have `block_words` words together; more are taken in blocks of that
size.  The first pass counts how often the items' n-grams occur in the whole corpus; in every window of `run` words of an
item the rarest n-gram becomes a seed, so that a document sharing any `run` consecutive words with the item holds the seed
of that window.  The second pass finds the seeds and aligns item and document words around each of them: a seed at word q
of an item of L words lies at most 3q words behind the start of the best alignment through it and 3(L - q) before its end,
since a prefix or suffix of more gaps than that would have a negative score; so a window of 3L words around each seed holds
all of it, whatever was inserted.

A hit has `similarity`, the alignment score as a share of the item's perfect score; `matched`, the words that are the same
in the best alignment; `identity`, their share of the aligned passage; and `run_words`, the longest run of words in common.
Long items are held in parts of `item_words` words: `similarity` adds up the parts, the others are those of the best part.

Where edited copies are asked for (`near`), every n-gram of an item that the corpus has is a seed, as the rarest are those
that an edit broke.  A copy of similarity `near` need not hold any seed; so the second pass also aligns every stretch of a
document that holds enough of an item's word pairs: an alignment of score S with an item of L words has at most 2L - S words
and gaps that do not match, so it spans at most 3L - S words of the document and at least S - L - 1 of them start a pair
of adjacent words that the item has too.  No copy of that similarity lacks these, so none is lost.

Words are maximal runs of letters and digits in lower case.  Defined results: null and empty texts hold no words; items
shorter than the n-gram have no seeds and are never found, items shorter than `run` take their rarest n-gram; repeated
documents and items are reported under each of their ids; an empty table on either side gives an empty result.

Scale: no text is shuffled or collected.  What is sent to every task is one block of items as arrays (at most `block_words`
words, about 50 bytes a word); corpus counts are kept for the block's own n-grams only and come to the driver as one array.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.sources.tables import table

SEED_WORDS, RUN_WORDS = 5, 12
NEAR = 0.8
#: An edited passage: at least so many words the same, which are at least this share of the words aligned.
EDITED_WORDS, IDENTITY = 20, 0.7
BLOCK_WORDS, ITEM_WORDS = 4_000_000, 512
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Word numbers of a block's vocabulary; 0 for every other word.  Forgets words of the corpus beyond a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = self.vocabulary.get(word.lower(), 0)
        return n


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams without an unknown word, and where they start."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    known = np.ones(m, bool)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = ids[k : k + m]
            known &= part > 0
            h = (h + part.astype(np.uint64)) * _BASE
            h ^= h >> np.uint64(29)
    at = np.flatnonzero(known)
    return h[at], at


def _batch_ids(texts: list[str | None], ids: _Ids, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of many texts in one array with `gap` unknown words between texts, and the start of each."""
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    pad = [0] * gap
    get = ids.__getitem__
    for i, t in enumerate(texts):
        starts[i] = len(flat)
        if t:
            flat.extend(map(get, _WORD.findall(t)))
        flat.extend(pad)
    starts[-1] = len(flat)
    return np.asarray(flat, np.int32), starts


_UNIT = 1 << 10  # score and matches of an alignment in one number; a part has fewer words than this


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman score (match 2, mismatch and gap -1) of one item against many windows, the matches of the best
    alignment (the most of equals), and the longest exact run."""
    c, width = windows.shape
    score = np.zeros((c, width + 1), np.int32)
    run = np.zeros((c, width + 1), np.int32)
    best, longest = np.zeros(c, np.int32), np.zeros(c, np.int32)
    ramp = np.arange(width, dtype=np.int32) * _UNIT
    t, gap, same = np.empty((c, width), np.int32), np.empty((c, width), np.int32), np.empty((c, width), bool)
    for w in item:
        np.equal(windows, w, out=same)
        np.subtract(score[:, :-1], _UNIT, out=t)
        np.add(t, 3 * _UNIT + 1, out=t, where=same)
        np.subtract(score[:, 1:], _UNIT, out=gap)
        np.maximum(t, gap, out=t)
        t += ramp
        np.maximum.accumulate(t, axis=1, out=t)
        t -= ramp
        t *= t >= _UNIT
        score[:, 1:] = t
        np.add(run[:, :-1], 1, out=gap)
        gap *= same
        run[:, 1:] = gap
        np.maximum(best, t.max(axis=1), out=best)
        np.maximum(longest, gap.max(axis=1), out=longest)
    return (best // _UNIT).astype(np.int32), (best % _UNIT).astype(np.int32), longest


class ItemBlock:
    """One block of items as every task holds it."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, run: int, item_words: int, near: float | None = None, least: int = 0):
        self.n, self.run, self.near, self.least = n, run, near, least
        self.vocabulary: dict[str, int] = {}
        self.parts: list[tuple[int, np.ndarray]] = []
        self.words: dict[int, int] = {}
        for item_id, text in items:
            ids = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            step = item_words - run
            for i in range(0, max(1, len(ids) - run), step):
                part = ids[i : i + item_words]
                if len(part) >= n:
                    self.parts.append((item_id, part))
                    self.words[item_id] = self.words.get(item_id, 0) + len(part)
        self.hashes = [_grams(ids, n)[0] for _, ids in self.parts]
        self.grams = np.unique(np.concatenate(self.hashes)) if self.hashes else np.zeros(0, np.uint64)
        self.seeds = self.grams
        if near is not None:
            self._index_pairs()

    def _index_pairs(self) -> None:
        """The parts that hold each pair of adjacent words; per part the pairs a near copy has and the words it spans."""
        size = np.asarray([len(ids) for _, ids in self.parts], np.int64)
        least = np.ceil(np.round(self.near * 2 * size, 6)).astype(np.int64)
        self.need, self.reach = least - size - 1, 3 * size - least
        if (self.need < 1).any():
            raise ValueError("near is too low for items of this length: their copies need not share a pair of words")
        held = [np.unique(_grams(ids, 2)[0]) for _, ids in self.parts]
        pair = np.concatenate(held) if held else np.zeros(0, np.uint64)
        part = np.repeat(np.arange(len(held)), [len(x) for x in held])
        order = np.argsort(pair, kind="stable")
        self.pairs, first = np.unique(pair[order], return_index=True)
        self.pair_parts, self.pair_starts = part[order], np.append(first, len(pair))

    def choose_seeds(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """In each window of `run` words the rarest gram that the corpus has, the first of equals; with `near` all it has."""
        absent = np.iinfo(np.int64).max  # a gram that the corpus lacks finds nothing
        known = np.full(len(self.grams), absent, np.int64)
        known[np.searchsorted(self.grams, grams)] = counts
        span = self.run - self.n + 1
        seed, part, place = [], [], []
        for p, h in enumerate(self.hashes):
            freq = known[np.searchsorted(self.grams, h)]
            q = np.arange(len(h))
            if self.near is None and len(h):
                views = np.lib.stride_tricks.sliding_window_view(freq, min(span, len(h)))
                q = np.unique(np.argmin(views, axis=1) + np.arange(len(views)))
            q = q[freq[q] < absent]
            seed.append(h[q])
            part.append(np.full(len(q), p, np.int64))
            place.append(q)
        seed, part, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((seed, np.uint64), (part, np.int64), (place, np.int64)))
        order = np.argsort(seed, kind="stable")
        self.seeds, first = np.unique(seed[order], return_index=True)
        self.seed_parts, self.seed_places, self.seed_starts = part[order], place[order], np.append(first, len(seed))


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def _seed_windows(b: ItemBlock, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, documents, first words, ends) of the windows around the seeds, windows of one document that touch joined."""
    h, at = _grams(flat, b.n)
    hit = _lookup(h, b.seeds)
    if not len(hit):
        return
    seed, pos = np.searchsorted(b.seeds, h[hit]), at[hit]
    size = b.seed_starts[seed + 1] - b.seed_starts[seed]
    which = _expand(b.seed_starts[seed], size)
    part, pos = b.seed_parts[which], np.repeat(pos, size)
    width = 3 * np.asarray([len(ids) for _, ids in b.parts], np.int64)
    first, doc = pos - 3 * b.seed_places[which], np.searchsorted(starts, pos, "right") - 1
    order = np.lexsort((first, doc, part))
    part, doc, first = part[order], doc[order], first[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + width[part[1:]])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(part)) - 1
    part, doc, end = part[begin], doc[begin], first[last] + width[part[begin]]
    first, end = np.maximum(first[begin], starts[doc]), np.minimum(end, starts[doc + 1])
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(part[i]), doc[i:j], first[i:j], end[i:j]


def _lookup(h: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table_, h), len(table_) - 1)
    return np.flatnonzero(table_[at] == h)


def _near_stretches(b: ItemBlock, flat: np.ndarray, starts: np.ndarray, chunk: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, documents, first words, ends) of the stretches of documents that may hold a near copy of the part.

    A part is held against its documents in steps of its own length, each with the reach of a copy on both sides.
    """
    h, at = _grams(flat, 2)
    hit = _lookup(h, b.pairs)
    gram, pos = np.searchsorted(b.pairs, h[hit]), at[hit]
    doc = np.searchsorted(starts, pos, "right") - 1
    n_parts = len(b.parts)
    i = 0
    while i < len(pos):
        # whole documents, as many as hold about `chunk` pairs and as the counts have room for
        room = int(np.searchsorted(doc, doc[i] + max(1, (1 << 24) // max(1, n_parts)), "left"))
        j = int(np.searchsorted(doc, doc[min(i + chunk, room) - 1], "right"))
        d0, n_docs = doc[i], doc[j - 1] - doc[i] + 1
        size = b.pair_starts[gram[i:j] + 1] - b.pair_starts[gram[i:j]]
        part = b.pair_parts[_expand(b.pair_starts[gram[i:j]], size)]
        where = np.repeat(pos[i:j], size)
        key = (np.repeat(doc[i:j], size) - d0) * n_parts + part
        enough = np.bincount(key, minlength=n_docs * n_parts) >= np.tile(b.need, n_docs)
        keep = enough[key]
        part, where, key = part[keep], where[keep], key[keep]
        order = np.argsort(key, kind="stable")
        part, where, key = part[order], where[order], key[order]
        i = j
        # a pair starts a copy if the need-th pair from it on is of the same document and part and within reach
        last = np.arange(len(key)) + b.need[part] - 1
        ok = last < len(key)
        last = np.minimum(last, len(key) - 1)
        ok &= (key[last] == key) & (where[last] - where < b.reach[part])
        part, where, docs = part[ok], where[ok], key[ok] // n_parts + d0
        for p in np.unique(part).tolist():
            mine = part == p
            step, reach = len(b.parts[p][1]), int(b.reach[p])
            places = np.unique(np.stack([docs[mine], (where[mine] - starts[docs[mine]]) // step]), axis=1)
            first = starts[places[0]] + places[1] * step - reach
            yield p, places[0], np.maximum(first, starts[places[0]]), np.minimum(first + step + 2 * reach, starts[places[0] + 1])


def _counter(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        ids = _Ids(b.vocabulary)
        total = np.zeros(len(b.grams), np.int64)
        for batch in batches:
            flat, _ = _batch_ids(batch.column(0).to_pylist(), ids, b.n)
            h, _ = _grams(flat, b.n)
            h = h[_lookup(h, b.grams)]
            total += np.bincount(np.searchsorted(b.grams, h), minlength=len(b.grams))
        some = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(b.grams[some].view(np.int64)), "n": pa.array(total[some])})

    return run


def _aligner(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        ids = _Ids(b.vocabulary)
        for batch in batches:
            flat, starts = _batch_ids(batch.column(1).to_pylist(), ids, b.n)
            found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = defaultdict(dict)
            sources = [_seed_windows(b, flat, starts)] + ([_near_stretches(b, flat, starts)] if b.near is not None else [])
            for p, docs, first, end in chain(*sources):
                item_id, item = b.parts[p]
                order = np.argsort(end - first, kind="stable")  # windows of like width together
                words, times = np.unique(item, return_counts=True)
                own, times = np.full(len(b.vocabulary) + 1, len(words)), np.append(times, 0)
                own[words] = np.arange(len(words))
                step = max(1, (1 << 16) // max(1, int((end - first).max())))
                for k in range(0, len(order), step):
                    mine = order[k : k + step]
                    where = first[mine, None] + np.arange(int((end[mine] - first[mine]).max()))
                    windows = np.where(where < end[mine][:, None], flat[np.minimum(where, len(flat) - 1)], 0)
                    if b.least:  # no alignment matches more words than the item has of those in the window
                        there = np.zeros((len(mine), len(times)), bool)
                        there[np.arange(len(mine))[:, None], own[windows]] = True
                        enough = there @ times >= min(b.least, int(np.ceil(0.8 * len(item))))
                        mine, windows = mine[enough], windows[enough]
                    for d, *hit in zip(docs[mine].tolist(), *(x.tolist() for x in align(item, windows))):
                        old = found[d, item_id].get(p, (0, 0, 0))
                        found[d, item_id][p] = (*max(old[:2], tuple(hit[:2])), max(old[2], hit[2]))
            rows: dict[str, list] = {f.name: [] for f in _HITS}
            for (d, item_id), parts in found.items():
                score, matched, _ = max(parts.values())
                aligned = 3 * matched - score  # words that match, words that do not, and gaps
                total = sum(x[0] for x in parts.values())
                hit = (d, item_id, total * 1000 // (2 * b.words[item_id]) / 1000, matched, matched * 1000 // aligned / 1000 if aligned else 0.0, max(x[2] for x in parts.values()))
                for name, v in zip(rows, hit):
                    rows[name].append(v)
            rows["doc_id"] = batch.column(0).take(pa.array(rows["doc_id"], pa.int64()))
            yield pa.record_batch([pa.array(rows[n], t) if n != "doc_id" else rows[n] for n, t in zip(rows, _HITS_ARROW)], names=list(rows))

    return run


_HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("matched", T.IntegerType()), T.StructField("identity", T.DoubleType()), T.StructField("run_words", T.IntegerType())])
_HITS_ARROW = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int32()]
_COUNTS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def leaked_passages(
    docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, run_words: int = RUN_WORDS, block_words: int = BLOCK_WORDS, item_words: int = ITEM_WORDS, near: float | None = None, least: int = 0
) -> DataFrame:
    """(doc_id, item_id, similarity, matched, identity, run_words) of every document and item with a seed in common.

    `docs` has doc_id and text, `items` item_id and text.  With `near`, every document and item of at least that similarity
    is among them, seed or not, and a similarity of `near` or more is exact.  With `least`, hits that match fewer words than
    that, and less than 0.8 of the item's or part's words, may be left out.
    """
    if not 0 < seed_words <= run_words < item_words < _UNIT:
        raise ValueError(f"need 0 < seed_words <= run_words < item_words < {_UNIT}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    items = items.select("item_id", "text").distinct()
    n_words = items.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)))).first()[0] or 0
    n_blocks = max(1, -(-int(n_words) // block_words))
    out: DataFrame | None = None
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()  # a block of the stated query set
        block = ItemBlock([tuple(r) for r in part], seed_words, run_words, item_words, near, least)
        shared = spark.sparkContext.broadcast(block)
        counts = docs.select("text").mapInArrow(_counter(shared), _COUNTS).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        block.choose_seeds(counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy())
        block.hashes, block.grams = [], np.zeros(0, np.uint64)
        hits = docs.mapInArrow(_aligner(spark.sparkContext.broadcast(block)), _HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def _hits(spark: SparkSession, sf_dir: str, near: float | None = None, least: int = 0) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"), near=near, least=least)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, least=RUN_WORDS).filter(F.col("run_words") >= RUN_WORDS).select("doc_id", "item_id").distinct()


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding an item or a passage of it as an edited copy: an aligned passage with at least 20 words of the item
    the same that make up 0.7 of the passage, or an alignment of at least 0.8 of the item's perfect score."""
    h = _hits(spark, sf_dir, NEAR, EDITED_WORDS).filter(((F.col("matched") >= EDITED_WORDS) & (F.col("identity") >= IDENTITY)) | (F.col("similarity") >= NEAR))
    return h.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("similarity", "matched", "identity", "run_words")])


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, the documents that share a run of words with it, those with an edited passage and those that hold it nearly whole."""
    h = _hits(spark, sf_dir, NEAR, RUN_WORDS).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("similarity", "matched", "identity", "run_words")])
    edited = (F.col("matched") >= EDITED_WORDS) & (F.col("identity") >= IDENTITY)
    return h.groupBy("item_id").agg(F.count_if(F.col("run_words") >= RUN_WORDS).alias("n_docs_run"), F.count_if(edited).alias("n_docs_edited"), F.count_if(F.col("similarity") >= NEAR).alias("n_docs_near"))


QUERIES = {"p9_found": p9_found, "p9_edited": p9_edited, "p9_items": p9_items}
SQL = {
    # shared runs of 12 words are shared 12-grams
    "p9_found": r"""WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
