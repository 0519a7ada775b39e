"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and itself, hashed to a fixed number of
buckets; a document is the mean of its words; a linear softmax tells toxic from clean. Vectors and
softmax are trained together in numpy (full-batch Adam), on a bounded sample of labelled rows, so a
misspelling that was never seen shares most of its n-grams with the word it stands for.

As the model is linear behind the averages, a bucket counts by one number, and scoring a text is one
look-up per word, in tasks, over whole texts.

Defined cases: a null or empty text has no words and gets the score of the bias; without labelled
rows every score is 0.5, with one class only it is the share of that class; labels of one doc_id are
joined by the maximum; a null doc_id is not labelled and not held out; repeated rows score alike;
other columns are never read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import SLICE_BYTES, slices

BUCKETS = 1 << 17
DIMENSIONS = 4
NGRAMS = (3, 4, 5)
# The most labelled rows that are fitted, per class: the documented bound of the sample.
SAMPLE = {1: 2_000, 0: 4_000}
# Vocabulary of the fit: words in so many sampled documents; others are seen by n-grams in scoring.
LEAST_DOCUMENTS = 3
STEPS = 100
RATE = 0.05
# Averages of unit vectors are small; the softmax sees them times this.
GAIN = 40.0
DECAY = 1e-4
THRESHOLD = 0.7
# Neutral words that scoring adds to a text, so that one word does not decide a short text.
NEUTRAL = 10
CACHE_WORDS = 400_000
# Stripped from both ends of a word.
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_"


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(word: str) -> list[int]:
    """The buckets of a word: itself and its n-grams between its ends."""
    word = word.strip(MARKS)
    marked = f"<{word}>"
    plain = marked.isascii()
    # Bytes are cut faster; they are the same n-grams only where every character is one byte.
    base = marked.encode("ascii") if plain else marked
    grams = {base: None} | {
        base[i : i + n]: None for n in NGRAMS for i in range(len(base) - n + 1)
    }
    raw = grams if plain else [g.encode("utf-8", "surrogatepass") for g in grams]
    return [zlib.crc32(g) % BUCKETS for g in raw]


def _crc_table() -> np.ndarray:
    """What crc32 does with each value of its low byte."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``zlib.crc32`` of many short ranges of bytes."""
    value = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    sizes = ends - starts
    least, most = (int(sizes.min()), int(sizes.max())) if len(sizes) else (0, 0)
    for k in range(most):
        live = slice(None) if k < least else np.flatnonzero(sizes > k)
        low = value[live]
        value[live] = _CRC[(low ^ data[starts[live] + k]) & np.uint32(255)] ^ (low >> np.uint32(8))
    return ~value


def subwords_together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``subwords`` of many words: the number of each one's word, and its bucket."""
    marked = [f"<{w.strip(MARKS)}>" for w in words]
    raw = [m.encode("utf-8", "surrogatepass") for m in marked]
    data = np.frombuffer(b"".join(raw), np.uint8)
    # Where each character begins, and the characters of each word.
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    counts = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), counts)
    first = np.cumsum(counts) - counts
    left = counts[word] - (np.arange(len(word)) - first[word])
    # An n-gram that is the whole word counts once.
    own = np.flatnonzero(~np.isin(counts, NGRAMS))
    owners, values = [own], [np.array([zlib.crc32(raw[k]) for k in own.tolist()], np.uint32)]
    for n in NGRAMS:
        place = np.flatnonzero(left >= n)
        owners.append(word[place])
        values.append(crc32(data, at[place], at[place + n]))
    # Only words that hold a shortest n-gram twice can hold any twice; those are done alone.
    keys = np.sort(owners[1] << 32 | values[1])
    again = np.unique(keys[1:][keys[1:] == keys[:-1]] >> 32)
    owner, bucket = np.concatenate(owners), np.concatenate(values) % BUCKETS
    if len(again):
        alone = np.zeros(len(words), bool)
        alone[again] = True
        rest = ~alone[owner]
        lists = [subwords(words[k]) for k in again.tolist()]
        owner = np.concatenate([owner[rest], np.repeat(again, [*map(len, lists)])])
        bucket = np.concatenate([bucket[rest], np.concatenate(lists)])
    return owner, bucket


class Model:
    """One number per bucket, and a bias: all that scoring needs."""

    def __init__(self, weight: np.ndarray | None, bias: float):
        self.bias = bias
        self.weight = None if weight is None else weight.astype(np.float64)

    def word(self, word: str) -> float:
        """The mean over the subwords that training has seen; 0 if there are none."""
        return self.words([word])[0]

    def words(self, words: list[str]) -> list[float]:
        """The same for many words at once."""
        if self.weight is None:
            return [0.0] * len(words)
        # About a slice's characters at once: a long text may bring any number of words.
        ends, at, out = np.cumsum([len(w) for w in words]), 0, []
        while at < len(words):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            out += self._together(words[at:stop])
            at = stop
        return out

    def _together(self, words: list[str]) -> list[float]:
        owner, buckets = subwords_together(words)
        found = self.weight[buckets]
        total = np.bincount(owner, found, len(words))
        return (total / np.maximum(np.bincount(owner, found != 0, len(words)), 1)).tolist()


class _Sparse:
    """Fixed sparse rows, multiplied forwards and backwards with one dense column at a time."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, n_columns: int):
        order = np.argsort(columns, kind="stable")
        self.columns, self.weights = columns, weights.astype(np.float32)
        self.heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        self.back_rows, self.back_weights = rows[order], self.weights[order]
        ordered = columns[order]
        self.back_heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        self.touched, self.n_columns = ordered[self.back_heads], n_columns

    def forward(self, dense: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.add.reduceat(x[self.columns] * self.weights, self.heads) for x in dense]
        )

    def backward(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(dense), self.n_columns), np.float32)
        for into, x in zip(out, dense, strict=True):
            into[self.touched] = np.add.reduceat(x[self.back_rows] * self.back_weights, self.back_heads)
        return out


def fit(sample: list[tuple[str | None, int]], steps: int = STEPS, seed: int = 3) -> Model:
    """Train on (text, label) rows."""
    if not sample:
        return Model(None, 0.0)
    labels = np.array([label for _, label in sample])
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    prior = float(np.log(share / (1 - share)))
    if labels.min() == labels.max():
        return Model(None, prior)
    # Two passes over the texts: the counts of one text at a time, entries in flat arrays.
    seen: Counter = Counter()
    for text, _ in sample:
        seen.update(set(tokens(text)))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCUMENTS))}
    del seen
    entries = array("i"), array("i"), array("d")
    for d, (text, _) in enumerate(sample):
        count = Counter(tokens(text))
        total = max(1, sum(count.values()))
        for w, n in count.items():
            if w in vocabulary:
                for values, value in zip(entries, (d, vocabulary[w], n / total), strict=True):
                    values.append(value)
    if not entries[0]:
        return Model(None, prior)
    gram_rows, buckets = array("i"), array("i")
    for w, i in vocabulary.items():
        own = subwords(w)
        gram_rows.extend([i] * len(own))
        buckets.extend(own)
    gram_rows, buckets = np.array(gram_rows), np.array(buckets)
    used, buckets = np.unique(buckets, return_inverse=True)
    share_of = 1.0 / np.bincount(gram_rows)[gram_rows]
    words = _Sparse(gram_rows, buckets, share_of, len(used))
    rows, columns, weights = (np.array(x) for x in entries)
    kept, rows = np.unique(rows, return_inverse=True)
    docs = _Sparse(rows, columns, weights, len(vocabulary))
    target = labels[kept]

    rng = np.random.default_rng(seed)
    state = {
        "table": rng.normal(0, 0.3, (DIMENSIONS, len(used))).astype(np.float32),
        "out": rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32),
        "bias": np.array([[0.0, prior]], np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in state.items()}
    for step in range(1, steps + 1):
        mean = docs.forward(words.forward(state["table"])).T * GAIN
        logits = mean @ state["out"] + state["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p = (p / len(target)).astype(np.float32)
        back = docs.backward((p @ state["out"].T * GAIN).T)
        slopes = {
            "table": words.backward(back) + DECAY * state["table"],
            "out": mean.T @ p + DECAY * state["out"],
            "bias": p.sum(axis=0, keepdims=True),
        }
        for name, slope in slopes.items():
            first, second = moments[name]
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            state[name] -= rate * first / (np.sqrt(second) + 1e-8)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = GAIN * ((state["out"][:, 1] - state["out"][:, 0]) @ state["table"])
    return Model(weight, float(state["bias"][0, 1] - state["bias"][0, 0]))


def sample_of(docs: DataFrame, labels: DataFrame) -> list[tuple[str | None, int]]:
    """The bounded training sample: by class, the labelled rows of smallest hash."""
    known = (
        labels.filter(fold() != 1).filter("toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    rows: list[tuple[str | None, int]] = []
    for label, most in SAMPLE.items():
        # At most `most` ids: small enough to broadcast, whatever the tables' sizes.
        ids = known.filter(F.col("label") == label).select("doc_id")
        chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
            F.xxhash64("doc_id", "text").alias("h"), "text"
        )
        # Repeated rows of an id don't enlarge the sample.
        found = texts.orderBy("h").limit(most).collect()
        rows += [(text, label) for text in sorted((r.text for r in found), key=str)]
    return rows


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The scores of the words met so far.
        cache: dict[str, float] = {}
        for batch in slices(batches):
            out = []
            rows = [tokens(text) for text in batch.column("text").to_pylist()]
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            new = [w for w in set().union(*rows) if w not in cache]
            cache.update(zip(new, model.words(new), strict=True))
            for found in rows:
                mean = sum(map(cache.__getitem__, found)) / (len(found) + NEUTRAL)
                out.append(1 / (1 + np.exp(-np.clip(mean + model.bias, -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"]
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    model = fit(sample_of(docs, labels))
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
