"""Broken prompt and response pairs, by a multi-label linear classifier with calibrated thresholds.

A logistic model per defect is trained on hashed n-grams of the whole response and on features of the pair: how the
ending is built, how much of the prompt the response repeats and how many letters it adds, which language was asked
for and given.  Its training pairs are made from the table itself: a bounded sample of sound pairs (`train_pairs`)
whose responses are truncated at random, replaced by the prompt in the ways copies come, swapped with a response in
another language, or replaced by composed refusals (`refusals`).  Refusals among the sampled pairs are not known at first:
a first fit takes only answers of many sentences and sentences out of them for sound, and the shorter ones it holds for refusals
are left out of the second, so no written-out rule decides what a sound pair is.  Each label's threshold is the
one with the best F1 on held-out pairs, halfway between the scores beside it; held-out refusals are composed of wordings
the fit has not seen.  A pair's verdict is the first label of the fixed order whose score reaches its threshold; `empty`
is an exact test, since an empty response has nothing to classify.

Defined results: a null response, a null response struct and a blank one are `empty`; a pair without a user message can
only be empty, a refusal or truncated; null messages and null roles are skipped; repeated rows give the same verdict; an
empty table gives an empty result; extra columns are ignored; features are taken over whole texts and averaged, so the
verdict does not depend on the length.

Scale: the model is at most DIMS x 4 numbers whatever the input; scoring is one pass in Arrow batches without a shuffle; the field
limits are a small table made from a histogram of lengths.
The sample that trains it is bounded by `train_pairs`; everything else covers all rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm import refusals
from driftloom.llm.defects import DEFECTS, asked_language, copy_lead, is_empty, without_echo
from driftloom.llm.endings import cut_kind, strip
from driftloom.llm.languages import language_of
from driftloom.llm.truncation import TERMINAL, field_limits
from driftloom.sources.tables import table

DIMS = 1 << 15
TRAIN_PAIRS = 1200
#: Answers of more distinct sentences than this are no refusals for the first fit.
SEED_SENTENCES = 3
#: The labels the classifier decides, in the order in which the earlier one wins; `empty` comes before them.
LABELS = DEFECTS[1:]
_TOKEN = re.compile(r"`[^`\n]*`?|[^\W_]+(?:['’][^\W_]+)?|[.!?]")
_CODE = re.compile(r"[\w$]*(?:[a-z\d][A-Z]|[_$/.#]\w)\S*")
_KINDS = ("marker", "json", "fence", "code", "item", "row", "sentence")
_MARKS = ["", "", "", "", "…", "...", " [truncated]", " [cut]", " <+120 chars>", "\ufffd"]
_LEADS = ["", "", "", "Sure: ", "Here it is: ", "Answer: ", "Of course. ", "You asked: ", "My reply to the request reads: ", "Gern, hier: ", "Antwort: ", "Вот ответ: ", "Конечно. ", "Voici : ", "Claro: "]
_SPAN = re.compile(r"`[^`\n]+`")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@lru_cache(1 << 17)
def _slot(s: str) -> int:
    return 64 + xxhash.xxh32_intdigest(s) % (DIMS - 64)


def features(system: str | None, user: str | None, response: str | None, at_limit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values; the first 64 slots are the pair's own features, the others n-grams averaged over the response."""
    r = response or ""
    sums: dict[int, float] = {0: 1.0}
    # how it ends
    kind = cut_kind(r)
    if kind and (kind[0] != "?" or at_limit):
        sums[1] = 3.0
        kind = kind.lstrip("?")
        if kind in _KINDS:
            sums[2 + _KINDS.index(kind)] = 1.0
    # how much of the prompt it is
    lead = copy_lead(user, r)
    if lead is not None:
        sums[16] = 3.0
        sums[17] = min(lead, 400) / 40
    tokens = [_norm(w) for w in _TOKEN.findall(r)]
    words = [w for w in tokens if w[0].isalnum()]
    mine = set(words)
    theirs = {_norm(w) for w in _TOKEN.findall(user or "")}
    both = len(mine & theirs)
    sums[18], sums[19] = both / (len(mine) or 1), both / (len(theirs) or 1)
    # which language it is in
    asked, given = asked_language(system, user), language_of(without_echo(user, strip(r)))
    if asked and given:
        sums[20] = 3.0 if asked != given else -3.0
    else:
        sums[21] = 1.0
    # what it says
    for w in tokens[-4:]:
        sums[_slot("e " + w)] = 0.03
    one = np.fromiter((_slot(w) for w in tokens), np.int64, len(tokens))
    stems = np.fromiter((_slot("^" + w[:5]) for w in tokens if len(w) > 5), np.int64)
    two = _mix(one[:-1], one[1:])
    slots, counts = np.unique(np.concatenate([one, stems, two, _mix(two[:-1], one[2:])]), return_counts=True)
    idx = np.concatenate([np.fromiter(sums.keys(), np.int64, len(sums)), slots])
    return idx, np.concatenate([np.fromiter(sums.values(), np.float32, len(sums)), (counts * (4.0 / (len(tokens) or 1))).astype(np.float32)])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots of the n-grams that end a word after those of `a`."""
    return 64 + (a * 40503 + b * 30011) % (DIMS - 64)


@lru_cache(1 << 17)
def _norm(token: str) -> str:
    """A token in lower case; code, names and numbers are one token each, so that a model of wordings does not learn names."""
    if token[0] == "`" or _CODE.match(token):
        return "`"
    return "0" if token[0].isdigit() else token.replace("’", "'").lower()


def _copied(rng: random.Random, user: str) -> str:
    how = rng.randrange(6)
    t = user.upper() if how == 0 else user.lower() if how == 1 else re.sub(r"\s+", " ", user) if how == 2 else user
    if how == 3:
        return '"' + t + '"'
    if how == 4:
        return "\n".join("> " + x for x in t.split("\n"))
    return rng.choice(_LEADS) + t


def training_set(pairs: list[tuple[str | None, str | None, str | None]], seed: int = 11) -> list[tuple[int, tuple, str | None, bool]]:
    """(number of the base pair, pair, label or None, whether the label is sure): pairs held for sound and the defects made from them.

    Base pairs that are empty, cut, copies or in a language not asked for are left out; refusals among them are found by `train`.
    """
    rng = random.Random(seed)
    sound = []
    for s, u, r in pairs:
        if u and not is_empty(r) and cut_kind(r) is None and copy_lead(u, r) is None:
            asked, given = asked_language(s, u), language_of(without_echo(u, strip(r)))
            if not (asked and given and asked != given):
                sound.append((s, u, r))
    by_lang: dict[str | None, list[str]] = {}
    for p in sound:
        by_lang.setdefault(language_of(p[2]), []).append(p[2])
    langs = sorted(x for x in by_lang if x)
    out: list[tuple[int, tuple, str | None, bool]] = []
    for k, (system, user, response) in enumerate(sound):
        held = k % 4 == 0
        names = _SPAN.findall(user)[:4] or ["this file"]
        parts = [x for x in _SENTENCE.split(response) if cut_kind(x) is None and not is_empty(x)]
        sure = len(set(parts)) > SEED_SENTENCES

        def add(r: str, label: str | None, sure: bool = True) -> None:
            out.append((k, (system, user, r), label, sure))  # noqa: B023

        add(response, None, sure)
        if len(parts) > 1:
            add(rng.choice(parts), None, sure)
        if k % 3 == 0:
            add(user + "\n\n" + response, None, sure)
        if k % 2:
            said = refusals.fact(rng, names)
            want, have = asked_language(system, user), language_of(said)
            foreign = bool(want and have and want != have)
            out.append((k, (system, user if foreign else None, said), "other_language" if foreign else None, True))
        if k % 3 == 1 and sure:
            add(refusals.sentence(rng, names) + " " + response, None)
        cut = response[: rng.randrange(max(1, len(response) // 8), max(2, len(response)))] + rng.choice(_MARKS)
        if (cut_kind(cut) or "?")[0] != "?":
            add(cut, "truncated", sure)
        if k % 4 in (0, 2):  # a list without final marks is a style, but at a field limit it is cut
            style = "\n".join("- " + x.replace("\n", " ").rstrip(".!?") for x in (parts[:6] if len(parts) > 1 else [rng.choice(sound)[2], response]))
            if cut_kind(style) == "?item":
                add(style, None, sure)
                out.append((k, (system, user, style, True), "truncated", sure))
        add(_copied(rng, user), "copy")
        for _ in range(2):
            add(refusals.compose(rng, names, held), "refusal")
        asked = asked_language(system, user)
        others = [x for x in langs if x != asked]
        if asked and others:
            add(rng.choice(by_lang[rng.choice(others)]), "other_language", False)
    return out


def _fit(data: list[tuple], epochs: int, seed: int) -> np.ndarray:
    """Weights (DIMS, labels) by Adagrad; a defect says nothing about the labels after it, as the earlier one wins."""
    w = np.zeros((DIMS, len(LABELS)), dtype=np.float32)
    g = np.full((DIMS, len(LABELS)), 1e-2, dtype=np.float32)
    order = list(range(len(data)))
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            idx, val, y, known = data[i]
            p = 1 / (1 + np.exp(-np.clip(val @ w[idx], -30, 30)))
            grad = val[:, None] * ((p - y) * known)[None, :]
            g[idx] += grad * grad
            w[idx] -= 0.3 * grad / np.sqrt(g[idx])
    return w


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the best F1 between the scores of a label's positives and of its negatives; the middle of the best stretch."""
    if not len(good):
        return np.inf
    scores = np.concatenate([good, bad])
    truth = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    order = np.argsort(-scores, kind="stable")
    scores, truth = scores[order], truth[order]
    hit = np.cumsum(truth)
    f1 = 2 * hit / (np.arange(1, len(scores) + 1) + len(good))
    f1[:-1][scores[:-1] == scores[1:]] = -1  # no threshold falls between equal scores
    best = int(np.argmax(f1))
    below = scores[best + 1] if best + 1 < len(scores) else scores[best] - 2.0
    return float((scores[best] + below) / 2)


def train(samples: list[tuple[int, tuple, str | None, bool]], epochs: int = 5, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, labels) and a calibrated threshold per label."""
    data = []
    for k, pair, label, sure in samples:
        j = LABELS.index(label) if label else len(LABELS)
        y = np.asarray([i == j for i in range(len(LABELS))], dtype=np.float32)
        known = np.asarray([i <= j for i in range(len(LABELS))], dtype=np.float32)
        data.append((k, *features(*pair), y, known, sure))
    if not data:
        return np.zeros((DIMS, len(LABELS)), dtype=np.float32), np.full(len(LABELS), np.inf)
    refused = LABELS.index("refusal")
    first = _fit([x[1:5] for x in data if x[5]] or [x[1:5] for x in data], 3, seed)
    clean = [x for x in data if x[5] or float(x[2] @ first[x[1], refused]) < 0]
    w = _fit([x[1:5] for x in clean if x[0] % 4] or [x[1:5] for x in clean], epochs, seed)
    held = [x for x in clean if x[0] % 4 == 0] or clean
    cuts = []
    for j in range(len(LABELS)):
        scored = [(float(val @ w[idx, j]), y[j]) for _, idx, val, y, known, _ in held if known[j]]
        cuts.append(_threshold(np.asarray([s for s, y in scored if y]), np.asarray([s for s, y in scored if not y])))
    return w, np.asarray(cuts)


def verdict(model: tuple[np.ndarray, np.ndarray], system: str | None, user: str | None, response: str | None, at_limit: bool = False) -> str | None:
    """The first defect of the fixed order that the pair has, or None."""
    if is_empty(response):
        return "empty"
    w, cut = model
    idx, val = features(system, user, response, at_limit)
    hit = np.flatnonzero(val @ w[idx] >= cut)
    return LABELS[hit[0]] if len(hit) else None


def pair_rows(stages: DataFrame) -> DataFrame:
    """(stage_id, feed, system, user, response): the last message with the user's role and the response."""
    role = lambda m: F.lower(F.trim(m["role"]))
    ms = F.col("request.messages")
    users = F.filter(ms, lambda m: role(m) == "user")
    systems = F.filter(ms, lambda m: role(m) == "system")
    return stages.select(
        "stage_id", "feed", F.array_join(F.transform(systems, lambda m: m["content"]), "\n").alias("system"),
        F.try_element_at(users, F.lit(-1))["content"].alias("user"), F.col("response.content").alias("response"),
    )


def with_limits(pairs: DataFrame) -> DataFrame:
    """`pairs` with `at_limit`: the response has the length of a field limit of its feed and no terminal punctuation, as in problem 1."""
    lengths = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.col("length")))
    limits = field_limits(pairs, ["feed"], "response").groupBy("feed").agg(lengths("chars").alias("_chars"), lengths("bytes").alias("_bytes"))
    at = F.array_contains("_chars", F.char_length("response")) | F.array_contains("_bytes", F.octet_length("response"))
    return pairs.join(limits, "feed", "left").withColumn("at_limit", F.coalesce(at & ~F.col("response").rlike(TERMINAL), F.lit(False))).drop("_chars", "_bytes")


def fitted(pairs: DataFrame, train_pairs: int = TRAIN_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The model trained on a sample of `train_pairs` rows, chosen by their hash."""
    sample = (
        pairs.select("system", "user", "response").withColumn("h", F.xxhash64("system", "user", "response")).orderBy("h", "user", "response").limit(train_pairs).drop("h").collect()
    )  # the one bounded sample: it trains the model and nothing else
    return train(training_set([tuple(r) for r in sample]))


def defective_pairs(pairs: DataFrame, train_pairs: int = TRAIN_PAIRS, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """`pairs` (key columns, system, user, response, at_limit if known) with `defect`, the verdict of the classifier; only defects."""
    if "at_limit" not in pairs.columns:
        pairs = pairs.withColumn("at_limit", F.lit(False))
    key = [c for c in pairs.columns if c not in ("system", "user", "response", "at_limit")]
    shared = pairs.sparkSession.sparkContext.broadcast(model or fitted(pairs, train_pairs))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            verdicts = [verdict(shared.value, s, u, r, bool(at)) for s, u, r, at in zip(b["system"], b["user"], b["response"], b["at_limit"])]
            out = b[key].assign(defect=verdicts)
            yield out[out["defect"].notna()]

    schema = T.StructType([f for f in pairs.schema.fields if f.name in key] + [T.StructField("defect", T.StringType())])
    return pairs.select(*key, "system", "user", "response", "at_limit").mapInPandas(score, schema)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(with_limits(pair_rows(table(spark, sf_dir, "llm_stages")))).select("stage_id", "defect").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs per feed and defect, with their share of the feed's pairs."""
    rows = pair_rows(table(spark, sf_dir, "llm_stages"))
    bad = defective_pairs(with_limits(rows)).groupBy("feed", "defect").agg(F.count(F.lit(1)).alias("n_defective"))
    n = table(spark, sf_dir, "llm_stages").groupBy("feed").agg(F.count(F.lit(1)).alias("n_pairs"))
    return bad.join(n, "feed").withColumn("share", F.round(F.col("n_defective") / F.col("n_pairs"), 6))


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates}
SQL: dict[str, str] = {}
