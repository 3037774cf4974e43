"""Encoding of a corpus with a public byte-level BPE vocabulary, by batched numpy merge rounds.

A batch of texts is split into words; each distinct word is encoded once. All new words of a batch lie as symbols in
one flat array. A round looks up the rank of every neighbouring pair by binary search over the sorted pair keys,
takes the lowest rank of each word and merges all its places at once, until no word has a pair left.

Edge cases: null and empty texts give the empty list; blank texts are ordinary text; no text is special, not even one
that reads like a special token; lone surrogates can't occur in Spark strings; a text without any white space is one
long word and takes as many rounds as it has different merges, not as it has characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Default place of the vocabulary; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per task, so that a frequent word is encoded once in it.
CACHE_WORDS = 200_000
_NONE = np.iinfo(np.int64).max


def read_merges(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of all pairs that merge, the id each merges to (its rank), and the id of each single byte."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(rank)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(merged, np.int64)[order], np.array([ranks[bytes([b])] for b in range(256)], np.int64)


def encode_words(words: list[bytes], keys: np.ndarray, merged: np.ndarray, of_byte: np.ndarray) -> list[np.ndarray]:
    """The ids of each word, all words merged together round by round."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done: list[np.ndarray | None] = [None] * len(words)
    while len(symbols):
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (word[:-1] == word[1:]), merged[at], _NONE)
        rank = np.append(rank, _NONE)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, starts)
        ends = np.append(starts[1:], len(symbols))
        live = least < _NONE
        for s, e in zip(starts[~live], ends[~live]):
            done[word[s]] = symbols[s:e]
        low = np.repeat(least, ends - starts)
        hit = (rank == low) & (low < _NONE)
        # of a run of overlapping places only every second one merges, from the left
        place = np.flatnonzero(hit)
        if len(place):
            run = np.flatnonzero(np.append(True, np.diff(place) > 1))
            since = place - np.repeat(place[run], np.diff(np.append(run, len(place))))
            place = place[since % 2 == 0]
        symbols[place] = rank[place]
        keep = np.repeat(live, ends - starts)
        keep[place + 1] = False
        symbols, word = symbols[keep], word[keep]
    return [d if d is not None else np.empty(0, np.int64) for d in done]


def encoder(keys: np.ndarray, merged: np.ndarray, of_byte: np.ndarray):
    """A function from a list of texts to their ids; distinct words are encoded once and kept."""
    split, cache = regex.compile(PATTERN), {}

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        parts = [split.findall(t) if t else [] for t in texts]
        new = list({w for p in parts for w in p} - cache.keys())
        if new:
            cache.update(zip(new, encode_words([w.encode() for w in new], keys, merged, of_byte)))
        return [np.concatenate([cache[w] for w in p]) if p else np.empty(0, np.int64) for p in parts]

    return encode


def broadcast_merges(spark: SparkSession, path: str = VOCABULARY):
    """The merge table for all tasks: its size is that of the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(read_merges(path))


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids, the list of token ids of the whole text; no shuffle."""
    merges = broadcast_merges(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*merges.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return documents.select(id_col, text).mapInArrow(run, f"{id_col} long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_tokens of each document."""
    merges = broadcast_merges(documents.sparkSession, vocabulary)
    schema = documents.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*merges.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes = pa.array([len(i) for i in encode(part.column(len(keep)).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], sizes], names=[*keep, "n_tokens"])

    return documents.select(*keep, text).mapInArrow(run, schema)
