"""Sentence alignment in bilingual documents.

A lexicon is induced per pair of languages: words of sentences that stand at about the same relative place co-occur, and
the log-likelihood ratio of their contingency table tells translations from chance; of the significant ones, those near
the best of both their words stay.  Sentence pairs are scored by the weight of the words that the lexicon pairs off one
to one, of the code spans and numbers they share, as a share of all their weight (words weigh by rarity).  Two
neighbouring sentences whose union matches a third clearly better than either alone form a merged span.  Spans are then
assigned by the Hungarian method for maximum weight, a null partner costing `null_score`.

Sentences end at . ! or ? followed by white space or the end of the text; a leading list mark belongs to its sentence.
Defined results: a pair lacking a side, a null or an empty text gives no row; of repeated deliveries of a side one is
taken (the least text); order within a text does not matter to the score; with equal scores the earlier sentences are
paired; an empty table gives an empty result; very long texts are decided per connected group of sentences that match.

Scale: co-occurrences are counted within a task before they are summed; words in more than `common` of the sentences
carry no information and take no part in the lexicon, so no word is a hot key; the lexicon is joined, not broadcast.
Texts are shuffled once, by pair.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.session import cut_lineage
from driftloom.sources.tables import table

NULL_SCORE, SIGNIFICANT, NEAR_BEST, COMMON = 0.3, 10.83, 0.4, 0.3
_LIST_MARK = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_END = re.compile(r"[.!?]+(?=\s|$)")
_TOKEN = re.compile(r"`[^`\n]+`|\d+|[^\W\d_]+")


def sentences(text: str) -> list[str]:
    out, at, n = [], 0, len(text)
    while at < n:
        m = _LIST_MARK.match(text, at)
        e = _END.search(text, m.end() if m else at)
        end = e.end() if e else n
        s = text[at:end].strip()
        if s:
            out.append(s)
        at = end
    return out


def tokens(sentence: str) -> list[str]:
    """Code spans, numbers and lower-case words, a leading list number left out."""
    m = _LIST_MARK.match(sentence)
    return [t if t[0] == "`" else t.lower() for t in _TOKEN.findall(sentence, m.end() if m else 0)]


@lru_cache(1 << 17)
def is_anchor(token: str) -> bool:
    return token[0] == "`" or token.isdigit()


def _cooccurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language pair: words of neighbouring sentence pairs, words of one side ('' on the other), sentence pairs."""
    total: Counter = Counter()

    def table_() -> pa.RecordBatch:
        keys = list(total)
        rec = pa.record_batch([pa.array([k[x] for k in keys], pa.string()) for x in range(3)] + [pa.array(list(total.values()), pa.int64())], names=["langs", "s", "t", "n"])
        total.clear()
        return rec

    for b in batches:
        by_langs: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for langs, x, y in zip(*(b.column(c).to_pylist() for c in ("langs", "src", "tgt"))):
            by_langs[langs].append((x, y))
        for langs, texts in by_langs.items():
            sv: dict[str, int] = {}
            tv: dict[str, int] = {}
            pairs: list[np.ndarray] = []
            singles: list[np.ndarray] = []
            others: list[np.ndarray] = []
            n_pairs = 0

            def flush() -> None:
                if not pairs:
                    return
                names_s, names_t = list(sv), list(tv)
                code, count = np.unique(np.concatenate(pairs), return_counts=True)
                for c, k in zip(code.tolist(), count.tolist()):
                    total[langs, names_s[c >> 32], names_t[c & 0xFFFFFFFF]] += k
                for part, names, side in ((singles, names_s, 0), (others, names_t, 1)):
                    code, count = np.unique(np.concatenate(part), return_counts=True)
                    for c, k in zip(code.tolist(), count.tolist()):
                        total[(langs, names[c], "") if side == 0 else (langs, "", names[c])] += k
                for x in (pairs, singles, others):
                    x.clear()

            for x, y in texts:
                xs = [np.unique([sv.setdefault(w, len(sv)) for w in tokens(s) if not is_anchor(w)]).astype(np.int64) for s in sentences(x)]
                ys = [np.unique([tv.setdefault(w, len(tv)) for w in tokens(s) if not is_anchor(w)]).astype(np.int64) for s in sentences(y)]
                for i, a in enumerate(xs):
                    mid = (i + 0.5) / len(xs) * len(ys) - 0.5
                    for j in range(max(0, round(mid) - 1), min(len(ys), round(mid) + 2)):
                        pairs.append(((a[:, None] << 32) | ys[j][None, :]).ravel())
                        singles.append(a)
                        others.append(ys[j])
                        n_pairs += 1
                if len(pairs) > 20_000:
                    flush()
            flush()
            total[langs, "", ""] += n_pairs
        if len(total) > 500_000:
            yield table_()
    yield table_()


_COUNTS = T.StructType([T.StructField(c, T.StringType()) for c in ("langs", "s", "t")] + [T.StructField("n", T.LongType())])


def lexicon(pairs: DataFrame, significant: float = SIGNIFICANT, near_best: float = NEAR_BEST, common: float = COMMON) -> DataFrame:
    """(langs, s, t, w): words that translate each other, with a weight that grows with their rarity.

    `pairs` has langs, src and tgt.
    """
    counts = cut_lineage(pairs.select("langs", "src", "tgt").mapInArrow(_cooccurrences, _COUNTS).groupBy("langs", "s", "t").agg(F.sum("n").alias("n")))
    total = counts.filter("s = '' AND t = ''").select("langs", F.col("n").alias("n_all"))
    left = counts.filter("s <> '' AND t = ''").select("langs", "s", F.col("n").alias("n_s"))
    right = counts.filter("s = '' AND t <> ''").select("langs", "t", F.col("n").alias("n_t"))
    both = counts.filter("s <> '' AND t <> ''").join(total, "langs").join(left, ["langs", "s"]).join(right, ["langs", "t"])
    both = both.filter((F.col("n_s") <= common * F.col("n_all")) & (F.col("n_t") <= common * F.col("n_all")) & (F.col("n") * F.col("n_all") > F.col("n_s") * F.col("n_t")))

    def term(k, row, col):
        return F.when(k > 0, k * F.log(k * F.col("n_all") / (row * col))).otherwise(0.0)

    n, a, b, m = (F.col(c).cast("double") for c in ("n", "n_s", "n_t", "n_all"))
    llr = 2 * (term(n, a, b) + term(a - n, a, m - b) + term(b - n, m - a, b) + term(m - a - b + n, m - a, m - b))
    scored = both.withColumn("llr", llr).filter(F.col("llr") >= significant)
    best = scored.withColumn("best_s", F.max("llr").over(Window.partitionBy("langs", "s"))).withColumn("best_t", F.max("llr").over(Window.partitionBy("langs", "t")))
    return best.filter((F.col("llr") >= near_best * F.col("best_s")) & (F.col("llr") >= near_best * F.col("best_t"))).select(
        "langs", "s", "t", F.log(F.lit(1.0) + F.col("n_all") / F.greatest("n_s", "n_t")).alias("w")
    )


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of greatest total gain; rows and columns may stay alone (gain 0).

    Each row in turn takes its cheapest way to a free column; a column of no gain and no cost for every row stands for staying
    alone, so that no padding to a square is needed.
    """
    n, m = gain.shape
    if n > m:
        return sorted((r, c) for c, r in hungarian(gain.T))
    if n == 1:
        c = int(np.argmax(gain[0]))
        return [(0, c)] if gain[0, c] > 0 else []
    cost = np.zeros((n, m + n))
    cost[:, :m] = -gain
    size = m + n
    u, v = np.zeros(n + 1), np.zeros(size + 1)
    match, way = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low = np.full(size, np.inf)
        done = np.zeros(size, bool)
        used = [0]
        while True:
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~done & (cur < low)
            low[better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(done, np.inf, low)))
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~done] -= delta
            done[j1] = True
            j0 = j1 + 1
            if match[j0] == 0:
                break
            used.append(j0)
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and gain[match[j] - 1, j - 1] > 0]


class _Scorer:
    """Scores of spans of one text pair."""

    def __init__(self, xs: list[list[str]], ys: list[list[str]], entries: list[dict]):
        self.trans: dict[str, dict[str, float]] = defaultdict(dict)
        known_s: dict[str, float] = {}
        known_t: dict[str, float] = {}
        there = {w for s in ys for w in s}
        for e in entries:
            a, b, k = e if isinstance(e, tuple) else (e["s"], e["t"], e["w"])
            if b not in there:
                continue
            self.trans[a][b] = k
            known_s[a] = max(known_s.get(a, 0.0), k)
            known_t[b] = max(known_t.get(b, 0.0), k)
        self.x = [self.weights(s, known_s) for s in xs]
        self.y = [self.weights(s, known_t) for s in ys]

    @staticmethod
    def weights(words: list[str], known: dict[str, float]) -> dict[str, float]:
        # a word that the lexicon does not know tells little: it may be one that this translation left out
        return {w: (6.0 if w[0] == "`" else 4.0) if is_anchor(w) else known.get(w, 0.15) for w in words}

    def common(self, a: dict[str, float], b: dict[str, float]) -> tuple[float, float]:
        """The weight of what a and b share on either side."""
        left = right = 0.0
        cand = []
        for w, k in a.items():
            if is_anchor(w):
                if w in b:
                    left += k
                    right += b[w]
            else:
                cand += [(v, w, t) for t, v in self.trans.get(w, {}).items() if t in b]
        seen_s, seen_t = set(), set()
        for v, w, t in sorted(cand, reverse=True):
            if w not in seen_s:
                seen_s.add(w)
                left += a[w]
            if t not in seen_t:
                seen_t.add(t)
                right += b[t]
        return left, right

    def score(self, a: dict[str, float], b: dict[str, float]) -> float:
        total = sum(a.values()) + sum(b.values())
        if not total:
            return 0.0
        s = sum(self.common(a, b)) / total
        here, there = {w for w in a if is_anchor(w)}, {w for w in b if is_anchor(w)}
        # code and numbers are not translated: sentences that both have some and share none say different things,
        # and where one side alone has some, the other is a part of it at most
        if here and there:
            return s * 0.3 if here.isdisjoint(there) else s
        return s * 0.6 if here or there else s


def _matrix(sc: _Scorer) -> np.ndarray:
    """The scores of all sentence pairs, reached through the words they share."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, b in enumerate(sc.y):
        for w in b:
            where[w].append(j)
    sum_y = [sum(b.values()) for b in sc.y]
    anchors_y = [{w for w in b if is_anchor(w)} for b in sc.y]
    out = np.zeros((len(sc.x), len(sc.y)))
    for i, a in enumerate(sc.x):
        left: dict[int, set[str]] = defaultdict(set)
        right: dict[int, set[str]] = defaultdict(set)
        for w in a:
            for t in (w,) if is_anchor(w) else sc.trans.get(w, ()):
                for j in where.get(t, ()):
                    left[j].add(w)
                    right[j].add(t)
        sum_x, here = sum(a.values()), {w for w in a if is_anchor(w)}
        for j in left:
            b = sc.y[j]
            s = (sum(a[w] for w in left[j]) + sum(b[t] for t in right[j])) / (sum_x + sum_y[j])
            there = anchors_y[j]
            out[i, j] = (s * 0.3 if here.isdisjoint(there) else s) if here and there else s * 0.6 if here or there else s
    return out


def align_sentences(src: str, tgt: str, entries: list[dict], null_score: float = NULL_SCORE) -> list[tuple[int, int]]:
    """(source sentence, target sentence) pairs that render the same content."""
    xs, ys = [tokens(s) for s in sentences(src)], [tokens(s) for s in sentences(tgt)]
    if not xs or not ys:
        return []
    sc = _Scorer(xs, ys, entries)
    single = _matrix(sc)
    row_units = _merge(sc.x, sc.y, single, sc.score)
    col_units = _merge(sc.y, sc.x, single.T, lambda a, b: sc.score(b, a))
    # a sentence takes part in one merge only: those of the source side first, then those of the target that are left
    xu, used_y = _units(len(xs), row_units)
    yu, _ = _units(len(ys), [m for m in col_units if m[1] not in {i for u in xu if len(u) > 1 for i in u} and m[0][0] not in used_y and m[0][1] not in used_y])
    gain = np.zeros((len(xu), len(yu)))
    for i, a in enumerate(xu):
        wa = {w: k for s in a for w, k in sc.x[s].items()}
        for j, b in enumerate(yu):
            if len(a) == 1 and len(b) == 1:
                s = single[a[0], b[0]]
            else:
                s = sc.score(wa, {w: k for t in b for w, k in sc.y[t].items()})
            # the place decides between equals
            gain[i, j] = max(0.0, s - null_score) * (len(a) + len(b)) / 2 + (1e-6 / (1 + abs(i / len(xu) - j / len(yu))) if s > null_score else 0)
    out = []
    for rows, cols in _groups(gain > 0):
        for r, c in hungarian(gain[np.ix_(rows, cols)]):
            out += [(i, j) for i in xu[rows[r]] for j in yu[cols[c]]]
    return sorted(set(out) | _attached(sc, single, out) | {(i, j) for j, i in _attached(sc, single.T, [(j, i) for i, j in out], True)})


def _attached(sc: _Scorer, single: np.ndarray, found: list[tuple[int, int]], turned: bool = False) -> set[tuple[int, int]]:
    """Sentences left alone that make an aligned pair a better match by joining it: merged spans that were moved apart."""
    xs, ys = (sc.y, sc.x) if turned else (sc.x, sc.y)

    def common(a: dict[str, float], b: dict[str, float]) -> tuple[float, float]:
        return sc.common(b, a)[::-1] if turned else sc.common(a, b)

    partners: dict[int, list[int]] = defaultdict(list)
    for i, j in found:
        partners[j].append(i)
    busy = {i for i, _ in found}
    out = set()
    for i in range(len(xs)):
        if i in busy:
            continue
        anchors = {w for w in xs[i] if is_anchor(w)}
        best, at = 0.08, -1
        for j in np.flatnonzero(single[i] > 0.15):
            y = ys[int(j)]
            there = {w for w in y if is_anchor(w)}
            own = common(xs[i], y)[0] / sum(xs[i].values())
            if own < 0.4 or anchors and there and anchors.isdisjoint(there):
                continue
            have = {w: k for r in partners[int(j)] for w, k in xs[r].items()}
            gain = (common({**have, **xs[i]}, y)[1] - common(have, y)[1]) / sum(y.values())
            if not (anchors & there).issubset(have):
                gain += 0.08  # code or a number that only this sentence explains
            if gain > best:
                best, at = gain, int(j)
        if at >= 0:
            out.add((i, at))
    return out


def _merge(xs, ys, single: np.ndarray, score) -> list[tuple[tuple[int, int], int]]:
    """((i, i + 1), j): neighbours of xs whose union matches ys[j] clearly better than either does, best first."""
    out = []
    for i in range(len(xs) - 1):
        for j in np.flatnonzero((single[i] > 0.12) & (single[i + 1] > 0.12)):
            # neither neighbour may have a better partner of its own
            if single[i].max() > single[i, j] + 1e-9 and single[i].max() > 0.6 or single[i + 1].max() > single[i + 1, j] + 1e-9 and single[i + 1].max() > 0.6:
                continue
            both = score({**xs[i], **xs[i + 1]}, ys[j])
            gain = both - max(single[i, j], single[i + 1, j])
            if gain > 0.12:
                out.append((gain, (i, i + 1), int(j)))
    return [(p, j) for _, p, j in sorted(out, key=lambda x: (-x[0], x[1]))]


def _units(n: int, merges: list[tuple[tuple[int, int], int]]) -> tuple[list[tuple[int, ...]], set[int]]:
    taken, used, spans = set(), set(), []
    for (a, b), j in merges:
        if a in taken or b in taken or j in used:
            continue
        taken |= {a, b}
        used.add(j)
        spans.append((a, b))
    return sorted(spans + [(i,) for i in range(n) if i not in taken]), used


def _groups(edge: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Connected groups of rows and columns."""
    out, seen = [], set()
    for r in range(edge.shape[0]):
        if r in seen or not edge[r].any():
            continue
        rows, cols, todo = {r}, set(), [r]
        while todo:
            x = todo.pop()
            for c in np.flatnonzero(edge[x]):
                if c not in cols:
                    cols.add(int(c))
                    for y in np.flatnonzero(edge[:, c]):
                        if int(y) not in rows:
                            rows.add(int(y))
                            todo.append(int(y))
        seen |= rows
        out.append((sorted(rows), sorted(cols)))
    return out


def _align(null_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            lists = b.column("entries")
            ends, flat = lists.offsets.to_pylist(), lists.values
            words, others, weights = (flat.field(k).to_pylist() for k in ("s", "t", "w"))
            for k, (i, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("pair_id", "src", "tgt")))):
                mine = slice(ends[k], ends[k + 1])
                out += [(i, r, c) for r, c in align_sentences(x, y, list(zip(words[mine], others[mine], weights[mine])), null_score)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["pair_id", "src_no", "tgt_no"])

    return run


def _words(side: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, words = [], [], []
            for i, lp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = {w for s in sentences(text) for w in tokens(s) if not is_anchor(w)}
                ids += [i] * len(found)
                langs += [lp] * len(found)
                words += found
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.string())], names=["pair_id", "langs", side])

    return run


def _word_schema(side: str) -> T.StructType:
    return T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("langs", T.StringType()), T.StructField(side, T.StringType())])


_ALIGNED = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("src_no", T.IntegerType()), T.StructField("tgt_no", T.IntegerType())])


def text_pairs(blocks: DataFrame) -> DataFrame:
    """(pair_id, langs, src, tgt): the canonical text and the other one of each pair that has both."""
    lang = F.lower(F.substring_index(F.regexp_replace(F.trim("language"), "_", "-"), "-", 1))
    side = F.struct("text", lang.alias("lang"))
    ok = F.col("text").isNotNull()
    g = blocks.groupBy(F.col("pair_id").cast("bigint").alias("pair_id")).agg(F.min(F.when(F.col("canonical") & ok, side)).alias("a"), F.min(F.when(~F.col("canonical") & ok, side)).alias("b"))
    return g.filter("a IS NOT NULL AND b IS NOT NULL").select("pair_id", F.concat_ws(">", F.coalesce("a.lang", F.lit("")), F.coalesce("b.lang", F.lit(""))).alias("langs"), F.col("a.text").alias("src"), F.col("b.text").alias("tgt"))


def aligned_sentences(blocks: DataFrame, null_score: float = NULL_SCORE) -> DataFrame:
    """(pair_id, src_no, tgt_no) of sentences that translate each other."""
    pairs = cut_lineage(text_pairs(blocks))
    lex = cut_lineage(lexicon(pairs))
    s = pairs.select("pair_id", "langs", "src").mapInArrow(_words("s"), _word_schema("s"))
    # what the lexicon says about the words of the source text; the words of the other text are looked up when it is scored
    entries = s.join(lex, ["langs", "s"]).groupBy("pair_id").agg(F.collect_list(F.struct("s", "t", "w")).alias("entries"))
    return pairs.join(entries, "pair_id", "left").select("pair_id", "src", "tgt", "entries").mapInArrow(_align(null_score), _ALIGNED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_sentences(table(spark, sf_dir, "translate_blocks")).distinct()


def p4_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The induced lexicon."""
    return lexicon(text_pairs(table(spark, sf_dir, "translate_blocks"))).select("langs", "s", "t", F.round("w", 6).alias("weight"))


QUERIES = {"p4_found": p4_found, "p4_lexicon": p4_lexicon}
SQL: dict[str, str] = {}
