import itertools
import random

import numpy as np
import pytest

from driftloom.llm.alignment import align_sentences, aligned_sentences, hungarian, lexicon, sentences, text_pairs, tokens


def test_sentences():
    assert sentences("One. Two! Three?\n- Four `a.b` v1.2 five.\n1. Six.\n2) Seven") == ["One.", "Two!", "Three?", "- Four `a.b` v1.2 five.", "1. Six.", "2) Seven"]
    assert sentences("") == [] and sentences(" \n ") == [] and sentences("no end") == ["no end"]
    assert tokens("1. The `X` has 5 ä-words") == ["the", "`X`", "has", "5", "ä", "words"]


@pytest.mark.parametrize("seed", range(6))
def test_hungarian_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5, 2)
    g = np.where(rng.random((n, m)) < 0.3, 0, rng.random((n, m)))
    best = 0.0
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                best = max(best, sum(g[r, c] for r, c in zip(rows, cols)))
    got = hungarian(g)
    assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got)
    assert abs(sum(g[r, c] for r, c in got) - best) < 1e-9


def bitext(n, seed=0):
    rng = random.Random(seed)
    words = {f"w{a}{b}": f"t{b}{a}" for a in "abcdefgh" for b in "klmnop"}
    rows, truth = [], set()
    for i in range(n):
        src, tgt = [], []
        for k in range(rng.randrange(3, 8)):
            s = rng.sample(sorted(words), 5)
            src.append(" ".join(s).capitalize() + ".")
            tgt.append((k, " ".join(words[w] for w in s).capitalize() + "."))
        how = i % 4
        if how == 1:
            del tgt[1]
        if how == 2:
            tgt[0], tgt[1] = tgt[1], tgt[0]
        out, j = [], 0
        if how == 3:
            out = [tgt[0][1][:-1] + " and " + tgt[1][1].lower()]
            truth |= {(i, tgt[0][0], 0), (i, tgt[1][0], 0)}
            j, tgt = 1, tgt[2:]
        for k, t in tgt:
            out.append(t)
            truth.add((i, k, j))
            j += 1
        rows += [(i, " ".join(src), True, "en", 0), (i, " ".join(out), False, "xx-YY", 0)]
    return rows, truth


def test_alignment_of_a_made_bitext(spark):
    rows, truth = bitext(160)
    df = spark.createDataFrame(rows + rows[:4], "pair_id long, text string, canonical boolean, language string, s int")
    got = {tuple(r) for r in aligned_sentences(df).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95


def test_lexicon_finds_translations(spark):
    rows, _ = bitext(200, 1)
    df = spark.createDataFrame(rows, "pair_id long, text string, canonical boolean, language string, s int")
    best = {}
    for r in lexicon(text_pairs(df)).collect():
        assert r.langs == "en>xx"
        best.setdefault(r.s, set()).add(r.t)
    assert np.mean([f"t{s[2]}{s[1]}" in t for s, t in best.items()]) > 0.9


def test_anchors_decide_without_a_lexicon():
    assert align_sentences("Call `a` now. Then call `b` twice.", "Nun `b` zweimal. Erst `a` rufen.", []) == [(0, 1), (1, 0)]
    assert align_sentences("At most 5 are kept here.", "Nur 7 bleiben.", []) == []
    assert align_sentences("", "x.", []) == []


def test_odd_tables(spark):
    schema = "pair_id long, text string, canonical boolean, language string, s int"
    df = spark.createDataFrame([(1, "A `x`.", True, "en", 0), (2, None, True, "en", 0), (2, "B.", False, "de", 0), (3, "", True, "en", 0), (3, "", False, None, 0), (4, "`q` is.", True, None, 0), (4, "`q` ist.", False, None, 0)], schema)
    assert {tuple(r) for r in aligned_sentences(df).collect()} == {(4, 0, 0)}
    assert aligned_sentences(df.limit(0)).count() == 0


def test_matrix_equals_the_scores_pair_by_pair():
    from driftloom.llm.alignment import _matrix, _Scorer

    rng = random.Random(4)
    word = lambda p: rng.choice([f"{p}{rng.randrange(6)}", "`x`", "7"])
    xs, ys = [[word("s") for _ in range(5)] for _ in range(6)], [[word("t") for _ in range(4)] for _ in range(7)]
    entries = [{"s": f"s{rng.randrange(6)}", "t": f"t{rng.randrange(6)}", "w": rng.random()} for _ in range(14)]
    sc = _Scorer(xs, ys, entries)
    want = np.asarray([[sc.score(a, b) for b in sc.y] for a in sc.x])
    assert np.allclose(_matrix(sc), want)
