"""The reading level of each document, by way of its sentences.

Texts are stripped of markup, logs, tables and code; what is left is split into
sentences. A multinomial logistic model with an L2 penalty over hashed character
n-grams, words and word pairs gives each sentence a distribution over the
levels; the sentences' distributions, weighted by their words, make the
document's; a temperature, fitted on documents the sentence model had not seen,
calibrates it: it makes the probabilities honest and leaves the largest share,
which is the level, the largest. Sentences of labelled documents start with the
document's label and are told anew once by the model, as documents mix levels.

The model is fitted on the driver from at most ``max_docs`` labelled documents
with at most ``max_sentences`` of their sentences, both picked by hash; every
document is then scored whole, in tasks.

Defined results: null, empty and blank texts and those with fewer than
``min_words`` words of prose have no row; lines whose letters are half or more
Chinese or Japanese are no prose here, as their words are not set apart and no
rater has labelled any, so texts of such lines alone have no row; a document is labelled by the median
of its raters (null opinions and repeated rows aside), halves go to the even
level; without labels there are no rows; a document repeated under its id
counts once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.tokens import spread
from kinelake.session import written

HASH = 1 << 16
NGRAM = 4
MIN_WORDS = 40

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]{0,300}>|<!--.*?-->", re.S)
_BLOCK = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "tr", "table", "pre"}
_DROP = re.compile("[​-‏⁠﻿­�\x00-\x08\x0e-\x1f\x7f]")
_BULLET = re.compile(r"^\s*(?:[-*•–·>]|\d{1,3}[.)])\s+")
_HEAD = re.compile(r"^\s*(?:#{1,6}\s|={2,}|-{3,}|\*{3,}|_{3,})")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"\w=\S|[{}\\|\t]|::|\(\)|;$|/\w+/\w+|0x[0-9a-f]|_\w+_|^\s*[\[(<]\d")
_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
_BROKEN = re.compile("[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_CJK = re.compile("[぀-ヿ一-鿿]")


def _mend(text: str) -> str:
    """Text that was read as another encoding once."""
    if _BROKEN.search(text):
        try:
            return text.encode("cp1252").decode("utf-8")
        except ValueError:
            pass
    return text


def is_prose(line: str) -> bool:
    """Whether a line is running text rather than a log, table, code, path or heading."""
    if _HEAD.match(line) or _CODE.search(line):
        return False
    dense = sum(map(len, line.split()))
    letters = sum(map(len, _LETTERS.findall(line)))
    return letters >= 0.7 * dense and (line.isascii() or len(_CJK.findall(line)) * 2 < max(1, letters))


def sentences(text: str | None, longest: int = 40, piece: int = 20) -> list[str]:
    """Sentences of running prose; text without ends is cut into pieces of words."""
    if not text or text.isspace():
        return []
    text = _mend(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if (m[2] or "").lower() in _BLOCK else " ", text)
    if "&" in text:
        text = html.unescape(text)
    text = _DROP.sub("", text.replace(" ", "\n").replace("\r", "\n").replace("\xa0", " "))
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        if part:
            for s in _END.split(" ".join(part)):
                words = s.split()
                if len(words) > longest:
                    out.extend(" ".join(words[i : i + piece]) for i in range(0, len(words), piece))
                elif words:
                    out.append(" ".join(words))
            part.clear()

    for line in text.split("\n"):
        bullet = _BULLET.match(line)
        if bullet:
            close()
            line = line[bullet.end() :]
        stripped = line.strip()
        if not stripped or not is_prose(stripped):
            close()
            continue
        words = stripped.split()
        if len(words) <= 3 and stripped[-1] not in ".!?…,;:" and not part and not bullet and stripped[:1].isupper():
            continue  # a heading
        part.append(stripped)
        if bullet and stripped[-1] in ".!?":
            close()
    close()
    return out


def words_in(sentence: str) -> int:
    return len(_WORD.findall(sentence))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams, words and word pairs of each text: flat indexes and where each text begins."""
    if not texts:
        return np.empty(0, np.int64), np.zeros(0, np.int64)
    padded = [f" {t.lower()} " for t in texts]
    size = np.array([len(p) for p in padded])
    c = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
        text = np.repeat(np.arange(len(texts)), size)
        mult = np.uint64(0x9E3779B97F4A7C15)
        gram = np.zeros(len(c) - NGRAM + 1, np.uint64)
        for k in range(NGRAM):
            gram = (gram + c[k : len(c) - NGRAM + 1 + k]) * mult
            gram ^= gram >> np.uint64(32)
        inside = text[: len(gram)] == text[NGRAM - 1 :]
        # words: runs of letters (anything that is no space or ASCII punctuation or digit)
        letter = (c > 127) | ((c >= 97) & (c <= 122))
        begin = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        if len(begin):
            place = np.arange(len(c))
            place = place - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, len(c))))])
            h = np.where(letter, (c + np.uint64(7)) * (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + mult), np.uint64(0))
            h ^= h >> np.uint64(29)
            word = np.add.reduceat(h * mult, begin)
            word_text = text[begin]
            pair = (word[:-1] * np.uint64(3) + word[1:]) * mult
            pair_ok = word_text[1:] == word_text[:-1]
        else:
            word, word_text, pair, pair_ok = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    bits = np.uint64(64 - int(np.log2(HASH)))
    mix = lambda x, salt: ((x ^ np.uint64(salt)) * mult) >> bits
    with np.errstate(over="ignore"):
        index = np.concatenate([mix(gram[inside], 1), mix(word, 2), mix(pair[pair_ok], 3)]).astype(np.int64)
    owner = np.concatenate([text[: len(gram)][inside], word_text, word_text[1:][pair_ok] if len(word) else word_text])
    order = np.argsort(owner, kind="stable")
    return index[order], np.searchsorted(owner[order], np.arange(len(texts)))


def _sums(weights: np.ndarray, index: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Mean weight rows of each text's features, scaled by the root of their number."""
    n = np.diff(np.append(begin, len(index)))
    out = np.zeros((len(begin), weights.shape[1]))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(weights[index], begin[some], axis=0)
    return out / np.sqrt(np.maximum(n, 1))[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(index: np.ndarray, begin: np.ndarray, target: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, l2: float = 1e-5, steps: int = 60, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic model by full-batch Adam, from ``start``; ``target`` rows are distributions.

    ``l2`` is held against the mean loss of a sentence.
    """
    k = target.shape[1]
    n = np.diff(np.append(begin, len(index)))
    scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
    w, b = (np.zeros((HASH, k), np.float32), np.log(target.mean(0) + 1e-3)) if start is None else (start[0].copy(), start[1].copy())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = _softmax(_sums(w, index, begin) + b)
        g = (p - target) / len(target)
        flat = np.repeat((g * scale[:, None]).astype(np.float32).T, n, axis=1)
        grad = np.stack([np.bincount(index, flat[j], HASH) for j in range(k)], 1).astype(np.float32) + np.float32(l2) * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= rate * g.sum(0)
    return w, b


@dataclass
class Model:
    levels: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    calibration: np.ndarray  # level scores = [share, 1] @ calibration

    def sentence(self, texts: list[str]) -> np.ndarray:
        return _softmax(_sums(self.weights, *features(texts)) + self.bias) if texts else np.zeros((0, len(self.levels)))

    def documents(self, texts: list[list[str]]) -> np.ndarray:
        """The mean distribution over the levels of each document's sentences, by words."""
        flat = [s for t in texts for s in t]
        p = self.sentence(flat) * np.array([max(1, words_in(s)) for s in flat])[:, None] if flat else np.zeros((0, len(self.levels)))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        out = np.zeros((len(texts), len(self.levels)))
        np.add.at(out, owner, p)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-9)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return _softmax(np.hstack([share, np.ones((len(share), 1))]) @ self.calibration)


def _calibrate(share: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """How sharply shares tell the level: the temperature that fits held-out labels best; the largest share stays first."""
    x = np.hstack([share, np.ones((len(share), 1))])
    scaled = [np.vstack([np.eye(k) * t, np.zeros((1, k))]) for t in np.geomspace(1, 64, 49)]
    loss = [-np.log(_softmax(x @ c)[np.arange(len(y)), y] + 1e-12).sum() for c in scaled]
    return scaled[int(np.argmin(loss))]


def _train(docs: list[list[str]], y: np.ndarray, k: int, rounds: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    flat = [s for d in docs for s in d]
    label = np.repeat(y, [len(d) for d in docs])
    if len(flat) > most:
        pick = np.sort(np.random.default_rng(3).permutation(len(flat))[:most])
        flat, label = [flat[i] for i in pick], label[pick]
    index, begin = features(flat)
    prior = np.full((len(flat), k), 0.1 / k) + np.eye(k)[label] * 0.9
    target = prior
    for r in range(rounds):
        w, b = fit(index, begin, target) if r == 0 else fit(index, begin, target, (w, b), steps=30)
        if r < rounds - 1:
            told = _softmax(_sums(w, index, begin) + b) ** 2 * np.maximum(prior, 0.15)
            target = told / told.sum(1, keepdims=True)
    return w, b


def learn(texts: list[str], labels: list[int], levels: tuple[int, ...] = (1, 2, 3, 4), rounds: int = 2, max_sentences: int = 20_000) -> Model | None:
    """The model of labelled texts: two thirds and the rest to calibrate, then all."""
    docs = [sentences(t) for t in texts]
    keep = [i for i, d in enumerate(docs) if d and labels[i] in levels]
    docs, y = [docs[i] for i in keep], np.array([levels.index(labels[i]) for i in keep], int)
    k = len(levels)
    if not docs:
        return None
    held = np.arange(len(docs)) % 3 == 0
    w, b = _train([d for d, h in zip(docs, held) if not h] or docs, y[~held] if (~held).any() else y, k, rounds, max_sentences * 2 // 3)
    share = Model(np.array(levels), w, b, np.eye(k)).documents([d for d, h in zip(docs, held) if h])
    calibration = _calibrate(share, y[held], k)
    w, b = _train(docs, y, k, rounds, max_sentences)
    return Model(np.array(levels), w, b, calibration)


def labelled(documents: DataFrame, labels: DataFrame, max_docs: int) -> tuple[list[str], list[int]]:
    """At most ``max_docs`` labelled texts, picked by hash, with the median of their raters."""
    one = labels.filter("doc_id is not null and reading_level between 1 and 4").select("doc_id", "rater", "reading_level").distinct()
    told = one.groupBy("doc_id").agg(F.percentile("reading_level", 0.5).alias("m")).withColumn("level", F.bround("m", 0).cast("int"))
    sample = told.select("doc_id", "level").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = documents.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.level for r in rows]


def reading_levels(documents: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS, max_docs: int = 1500, max_sentences: int = 20_000) -> DataFrame:
    """(doc_id, reading_level, p1..p4, words, sentences) of every document with enough prose."""
    spark = documents.sparkSession
    schema = "doc_id long, reading_level int, p1 double, p2 double, p3 double, p4 double, words int, sentences int"
    model = learn(*labelled(documents, labels, max_docs), max_sentences=max_sentences)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # HASH x levels floats, 1 MB whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, texts = batch.columns
            for a in range(0, batch.num_rows, 500):
                split = [sentences(t) for t in texts.slice(a, 500).to_pylist()]
                words = np.array([sum(map(words_in, s)) for s in split])
                keep = np.flatnonzero(words >= min_words)
                if len(keep):
                    p = m.calibrated(m.documents([split[i] for i in keep]))
                    yield pa.record_batch([ids.slice(a, 500).take(pa.array(keep)), pa.array(m.levels[p.argmax(1)].astype(np.int32)), *(pa.array(p[:, j]) for j in range(4)), pa.array(words[keep].astype(np.int32)), pa.array(np.array([len(split[i]) for i in keep], np.int32))], [c.split()[0] for c in schema.split(", ")])

    # repeated ids are found by the ids alone; only texts under these are shuffled to count once
    whole = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    again = written(documents.select("doc_id").filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        whole = spread(whole)
    else:
        whole = spread(whole.join(again, "doc_id", "left_anti").unionByName(whole.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    return whole.mapInArrow(run, schema)
