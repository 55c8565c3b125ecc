"""Filling containers of fixed capacity with documents, under several limits at once.

Vector bin packing by the dot-product heuristic: a container is open at a time, and of the items that fit, the one with
the greatest weighted dot product with what is left of the container's limits goes in; when none fits, the next
container is opened.  Limits are tokens, segments, and loss-bearing tokens (those of the kinds a model is trained to
produce).  After that pass, containers with much space left over are emptied into others where their items fit, and
what remains is packed anew.  Items are never split unless they exceed the capacity; those are cut into pieces at
white space where there is any.

Tokens are those of a public byte-level tokenizer whose vocabulary file is a parameter.  Defined results: null texts are
left out, empty texts take no container; equal items are told apart by id; a text with no white space is cut between
characters; an empty table gives an empty result; container numbers are dense and do not depend on the partitioning.

Scale: tokens are counted where the text is read; only ids and sizes are shuffled.  Items are dealt by the hash of
their id into blocks of about `block_items` and each block is packed on its own, so that no task sees more than its
block whatever the input; what this costs is at most the last container of each block.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.session import cut_lineage
from driftloom.sources.tables import table

VOCABULARY = os.environ.get("DRIFTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-tokenizer pattern that belongs to the byte-level vocabulary; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOSS_KINDS = ("answer", "changelog", "block")
BLOCK_ITEMS = 4096
_LOADED: dict[str, object] = {}
_TABLES: dict[int, tuple] = {}


def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def _token_table(enc) -> tuple[np.ndarray, ...]:
    """Per token: characters it begins, whether it begins one, begins with white space, with a space and a letter, ends without white space."""
    if id(enc) not in _TABLES:
        parts = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
        _TABLES[id(enc)] = (
            np.asarray([sum(x & 0xC0 != 0x80 for x in p) for p in parts], np.int64),
            np.asarray([p[0] & 0xC0 != 0x80 for p in parts]),
            np.asarray([p[0] in b" \n\t\r" for p in parts]),
            np.asarray([len(p) > 1 and p[0] == 32 and p[1:2].isalpha() for p in parts]),
            np.asarray([not p[-1:].isspace() for p in parts]),
        )
    return _TABLES[id(enc)]


def pieces(text: str, tokens: list[int], capacity: int, enc) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive pieces of at most `capacity` tokens each, counted on the piece's own text.

    `tokens` encodes the text.  A piece ends before a token that begins with white space, or else where a character
    begins, at the latest place that the capacity allows.
    """
    ids = np.asarray(tokens, np.int64)
    n_chars, starts_char, blank, word, inside = (t[ids] for t in _token_table(enc))
    at = np.zeros(len(ids) + 1, np.int64)  # characters begun before each token
    np.cumsum(n_chars, out=at[1:])
    clean = np.ones(len(ids) + 1, bool)
    clean[1:-1] = word[1:] & inside[:-1]
    out, i, n = [], 0, len(ids)
    while i < n:
        reach = capacity
        while True:
            j = min(n, i + reach)
            if j < n:
                for good in (blank, starts_char):
                    ok = np.flatnonzero(good[i + max(1, reach // 2 if good is blank else 1) : j + 1])
                    if len(ok):
                        j = i + max(1, reach // 2 if good is blank else 1) + int(ok[-1])
                        break
                else:  # one character of more tokens than the capacity
                    j = i + 1 + int(np.argmax(starts_char[i + 1 :])) if starts_char[i + 1 :].any() else n
            start, end = int(at[i]), int(at[j])
            # cuts before a space and a letter leave all other tokens as they are; elsewhere the piece is counted anew
            m = j - i if clean[i] and clean[j] else len(enc.encode_ordinary(text[start:end]))
            if m <= capacity or reach <= 1:
                break
            reach = max(1, reach - (m - capacity))
        out.append((start, end, m))
        i = j
    return out


def _sizes(vocabulary: str, capacities: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("capacity", "doc_id", "kind", "piece", "start_char", "end_char", "n_tokens")}
            for i, t, kind in zip(*(b.column(k).to_pylist() for k in range(3))):
                tokens = enc.encode_ordinary(t)
                for c in capacities:
                    for k, (s, e, m) in enumerate([(0, len(t), len(tokens))] if len(tokens) <= c else pieces(t, tokens, c, enc)):
                        for name, v in zip(out, (c, i, kind, k, s, e, m)):
                            out[name].append(v)
            yield pa.record_batch({k: pa.array(v, pa.string() if k == "kind" else pa.int64() if k == "doc_id" else pa.int32()) for k, v in out.items()})

    return run


_ITEMS = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType() if c == "kind" else T.IntegerType()) for c in ("capacity", "doc_id", "kind", "piece", "start_char", "end_char", "n_tokens")])


def token_sizes(docs: DataFrame, capacities: list[int], vocabulary: str = VOCABULARY) -> DataFrame:
    """(capacity, doc_id, kind, piece, start_char, end_char, n_tokens) for each document, cut where it exceeds a capacity."""
    return docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text", "kind").mapInArrow(_sizes(vocabulary, capacities), _ITEMS)


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container numbers for items (rows of `sizes`) under `limits`, by the dot-product heuristic."""
    n, dims = sizes.shape
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    need = sizes / np.maximum(limits, 1)
    out, used = _fill(need)
    # containers that are less than half full are given up and their items packed where they fit best
    load = np.zeros((used, dims))
    np.add.at(load, out, need)
    loose = np.flatnonzero(np.isin(out, np.flatnonzero(load[:, 0] < 0.5)))
    if len(loose) > 1:
        left = 1 - load
        for i in loose[np.argsort(-need[loose, 0], kind="stable")]:
            home = out[i]
            fits = (left >= need[i] - 1e-12).all(axis=1)
            fits[home] = False
            fits &= load[:, 0] >= load[home, 0]
            if fits.any():
                # the tightest container that takes the item
                k = int(np.flatnonzero(fits)[np.argmin(left[fits, 0])])
                for at, sign in ((home, -1), (k, 1)):
                    load[at] += sign * need[i]
                    left[at] -= sign * need[i]
                out[i] = k
    _, out = np.unique(out, return_inverse=True)
    return out


def _fill(need: np.ndarray) -> tuple[np.ndarray, int]:
    """The heuristic over distinct sizes: equal items are interchangeable and taken in their order."""
    out = np.full(len(need), -1, np.int64)
    kinds, which, left_over = np.unique(need, axis=0, return_inverse=True, return_counts=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    first = np.concatenate([[0], np.cumsum(left_over)])  # items of a kind: order[first[k] : first[k + 1]]
    weight = need.mean(axis=0) + 1e-9  # scarce limits weigh more
    live = np.flatnonzero(left_over)
    used = 0
    while len(live):
        rest = kinds[live]
        left = np.ones(need.shape[1])
        cand = np.arange(len(live))
        while len(cand):
            cand = cand[(rest[cand] <= left + 1e-12).all(axis=1) & (left_over[live[cand]] > 0)]
            if not len(cand):
                break
            k = int(cand[np.argmax(rest[cand] @ (weight * left))])
            kind = live[k]
            left_over[kind] -= 1
            out[order[first[kind] + left_over[kind]]] = used
            left = left - rest[k]
        used += 1
        live = live[left_over[live] > 0]
    return out, used


#: Pieces per 1024 tokens of a container.
SEGMENTS = 16.0
#: So many consecutive pieces of one document stay in a block; a document of any length is spread over blocks.
PIECES = 256


def packed(items: DataFrame, segments_per_1k: float = SEGMENTS, loss_share: float = 0.75, block_items: int = BLOCK_ITEMS, loss_kinds: tuple[str, ...] = LOSS_KINDS) -> DataFrame:
    """`items` with container_no, dense per capacity.

    Limits per container: `capacity` tokens, `segments_per_1k` pieces per 1024 tokens of capacity (at least one), and
    loss-bearing tokens up to `loss_share` of the capacity (a single larger item has its container's loss limit raised).
    """
    loss = F.when(F.col("kind").isin(*loss_kinds), F.col("n_tokens")).otherwise(0)
    items = items.filter("n_tokens > 0").withColumn("n_loss", loss)
    counts = items.groupBy("capacity").agg(F.count(F.lit(1)).alias("n"))
    dealt = items.join(F.broadcast(counts), "capacity").withColumn("block", F.pmod(F.xxhash64("doc_id", F.floor(F.col("piece") / PIECES)), F.greatest(F.lit(1), F.ceil(F.col("n") / block_items)))).drop("n")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        cap = float(pdf["capacity"].iloc[0])
        limits = np.asarray([cap, max(1.0, segments_per_1k * cap / 1024), loss_share * cap])
        sizes = np.stack([pdf["n_tokens"], np.ones(len(pdf)), np.minimum(pdf["n_loss"], limits[2])], axis=1).astype(float)
        return pdf.assign(local=pack(sizes, limits))

    schema = T.StructType([*dealt.schema.fields, T.StructField("local", T.LongType())])
    local = cut_lineage(dealt.groupBy("capacity", "block").applyInPandas(one, schema))  # read twice, packed once
    # dense numbers over all blocks: a running sum over one row per block
    sizes = local.groupBy("capacity", "block").agg((F.max("local") + 1).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("capacity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("capacity", "block", before.alias("offset"))
    return local.join(offsets, ["capacity", "block"]).withColumn("container_no", F.col("offset") + F.col("local")).drop("block", "local", "offset", "n")


def _capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    rows = table(spark, sf_dir, "size_limits").filter("item_kind = 'document' AND unit = 'token'").select("max_size").distinct().collect()
    return sorted(r.max_size for r in rows)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut_lineage(token_sizes(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir)))  # read twice, tokenized once
    return packed(items).select("capacity", "doc_id", "piece", "start_char", "end_char", "n_tokens", "n_loss", "container_no")


def p8_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the fewest that any packing under the limits needs, tokens placed, and the share of unused space."""
    p = p8_containers(spark, sf_dir)
    n = p.groupBy("capacity").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))
    cap = F.col("capacity")
    least = F.greatest(F.ceil(F.col("n_tokens") / cap), F.ceil(F.col("n_pieces") / F.greatest(F.lit(1.0), F.floor(SEGMENTS * cap / 1024))))
    return n.select("capacity", "n_containers", least.alias("n_least"), "n_tokens", F.round(1 - F.col("n_tokens") / (cap * F.col("n_containers")), 6).alias("unused_share"))


QUERIES = {"p8_containers": p8_containers, "p8_unused": p8_unused}
SQL: dict[str, str] = {}
