"""Byte-level BPE over whole texts in batched numpy merge rounds.

The words of a batch that were not seen before lie in one flat array of
symbols. Each round looks up all adjacent pairs at once by binary search over
the sorted pair keys of the vocabulary and merges, in every word, the pairs of
its lowest rank, until no pair of the vocabulary is left. Encoded words are
kept, so that a word costs its merges once per worker.

Defined results: null and empty texts have no ids (an empty list); the strings
of special tokens are ordinary text; no prefix of a text is cut off.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("KINELAKE_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the word pattern that the byte-level vocabulary was built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A byte-level BPE vocabulary given as ``token rank`` lines (base64, number)."""

    def __init__(self, path: str, kept_words: int = 200_000):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.kept: dict[str, np.ndarray] = {}
        self.kept_words = kept_words
        left, right, merged = self._pairs(ranks)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]
        self.last = len(self.keys) - 1

    @staticmethod
    def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merge that makes each token: its two parts once all merges of lower rank are done."""
        rows = []
        for token, rank in ranks.items():
            if len(token) < 2:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                rows.append((ranks[parts[0]], ranks[parts[1]], rank))
        return tuple(np.array(x, np.int64) for x in zip(*rows))  # type: ignore[return-value]

    def _merge(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8", "replace") for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        # words that have no more merges leave the flat array
        done_symbol, done_word = [], []
        while len(symbol) > 1:
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.last)
            rank = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.merged[at], 1 << 40)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            # the pair at the last symbol of a word is with the next word and never counts
            best = np.minimum.reduceat(np.append(rank, 1 << 40), starts)
            count = np.diff(np.append(starts, len(word)))
            mine = np.repeat(best, count)
            live = mine < 1 << 40
            hit = np.append(rank, 1 << 40)
            hit = live & (hit == mine)
            # of overlapping equal pairs (aaa) the first, third, ... merge
            idx = np.flatnonzero(hit)
            if len(idx):
                run = np.cumsum(np.diff(idx, prepend=-9) != 1)
                first = np.flatnonzero(np.diff(run, prepend=0))
                idx = idx[(np.arange(len(idx)) - np.repeat(first, np.diff(np.append(first, len(idx))))) % 2 == 0]
            symbol[idx] = mine[idx]
            keep = np.ones(len(symbol), bool)
            keep[idx + 1] = False
            out = keep & ~live
            done_symbol.append(symbol[out])
            done_word.append(word[out])
            keep &= live
            symbol, word = symbol[keep], word[keep]
        done_symbol.append(symbol)
        done_word.append(word)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.split(symbol[order].astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in self.kept})
        if fresh:
            if len(self.kept) + len(fresh) > self.kept_words:
                self.kept.clear()
                fresh = list({w for words in split for w in words})
            self.kept.update(zip(fresh, self._merge(fresh)))
        pieces = [self.kept[w] for words in split for w in words]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bounds = np.cumsum([0, *map(len, split)])
        total = np.concatenate([[0], np.cumsum(sizes)])
        return (np.concatenate(pieces) if pieces else np.empty(0, np.int32)), np.diff(total[bounds])


@functools.lru_cache(2)
def load(path: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(path)


def vocabulary(name: str = "byte_bpe_50k", root: str = TOKENIZERS) -> str:
    return os.path.join(root, f"{name}.tiktoken")


def shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary to the executors, which may not have its folder; the name by which tasks find it."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def on_worker(path: str) -> str:
    sent = SparkFiles.get(os.path.basename(path))
    return path if os.path.exists(path) or not os.path.exists(sent) else sent


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, or one row."""
    size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
    begin = 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def encode(documents: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row; other columns are left out."""
    path = shipped(documents.sparkSession, path or vocabulary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(on_worker(path))
        for batch in batches:
            keys, texts = batch.columns
            for a, b in _slices(texts):
                ids, sizes = bpe.encode(texts.slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch([keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], ["key", "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count(documents: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens) of every row."""
    path = shipped(documents.sparkSession, path or vocabulary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(on_worker(path))
        for batch in batches:
            keys, texts = batch.columns
            for a, b in _slices(texts):
                _, sizes = bpe.encode(texts.slice(a, b - a).to_pylist())
                yield pa.record_batch([keys.slice(a, b - a), pa.array(sizes, pa.int64())], ["key", "n_tokens"])

    kind = dict(documents.dtypes)[key]
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long").withColumnRenamed("key", key)


def spread(df: DataFrame, *key: Column | str) -> DataFrame:
    """Spread rows before costly work over all cores, if the scan of files has fewer splits than there are cores.

    A scan of at least as many files as cores is left as it is: large tables
    are not shuffled.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores and len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores * 3, splits), *key)
