"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (hashed to buckets), a window's vector the mean over its
words (short ones filled up with zeros; a word repeated at once counts once), and a softmax over two classes reads it, so an unseen misspelling is scored by the n-grams it shares. Windows of 32
words keep a few words from drowning in a long text: a text's score is that of its highest window, over the whole text.
Embeddings and softmax are trained together by Adagrad: first every window has its text's label, then each toxic text is
represented by its highest windows only. A fifth of the texts is kept aside to calibrate the log-odds.

Training uses at most 2 * per_class labelled texts of at most `class_bytes` a class, each with all its windows (a bound on rows, not
on texts). Null and empty texts have no words and get the score of an empty bag (the softmax's bias). Repeated rows score alike;
equal labelled texts count each. Texts of any length are scored whole. Without labelled texts of both classes the score is the share
of toxic ones, 0.5 if there are none. An empty table gives no rows. Other columns pass through; `score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, SpanHash, labelled_sample, mix64, pieces, text_bytes

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
WINDOW = 32
DIM = 8
RATE = 0.5
LEAST_TEXTS = 3
#: Bytes of words: letters, digits, all of other scripts, and signs that stand in for letters.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256), *b"@$*"]] = True


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, hashes, first): as word_spans has them, for runs of LETTER bytes; a word said again at once counts once."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes = SpanHash(data)(starts, ends)
    row = np.searchsorted(offsets, starts, "right")
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
    return starts[new], ends[new], hashes[new], np.searchsorted(starts[new], offsets)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of all n-grams of <word>, and of the word itself, size by size."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.full(at[-1], ord("<"), np.uint8)
    body = np.repeat(starts - at[:-1] - 1, sizes) + np.arange(at[-1])
    edge = np.zeros(at[-1], bool)
    edge[at[:-1]] = edge[at[1:] - 1] = True
    padded[~edge] = data[body[~edge]]
    padded[at[1:] - 1] = ord(">")
    spans, word = SpanHash(padded), np.repeat(np.arange(len(starts)), sizes)
    stop = at[1:][word]
    here = np.arange(at[-1])
    yield (spans(at[:-1], at[1:]) % np.uint64(BUCKETS)).astype(np.int64), np.arange(len(starts))
    for n in SIZES:
        ok = here[here + n <= stop]
        yield (spans(ok, ok + n) % np.uint64(BUCKETS)).astype(np.int64), word[ok]


@dataclass
class Model:
    """value[bucket]: what an n-gram adds to the log-odds of its words; bias."""

    value: np.ndarray
    bias: float

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(starts)), np.zeros(len(starts))
        for bucket, word in _grams(data, starts, ends):
            total += np.bincount(word, self.value[bucket], len(starts))
            count += np.bincount(word, minlength=len(starts))
        return total / np.maximum(count, 1)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text."""
        data = LOWER[data]
        starts, ends, hashes, first = _tokens(data, offsets)
        best = np.zeros(len(offsets) - 1)
        if len(starts):
            _, pick, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(self.words(data, starts[pick], ends[pick])[inverse])])
            row, a, b = windows(first)
            best = np.full(len(offsets) - 1, -np.inf)
            np.maximum.at(best, row, (sums[b] - sums[a]) / WINDOW)
            best[np.diff(first) == 0] = 0.0
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500)))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, last word + 1) of windows of WINDOW words, half of each shared with the next; the last ends the text."""
    n = np.diff(first)
    half = WINDOW // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // half) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    b = np.minimum(k * half + WINDOW, n[row])
    a = np.maximum(b - WINDOW, 0)
    return row, first[:-1][row] + a, first[:-1][row] + b


def _groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Neighbouring texts of about `most` bytes together: bounds the scratch arrays."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


class _Bags:
    """Windows as bags of distinct words, words as bags of buckets."""

    def __init__(self, texts: list[bytes]):
        words, grams, of, firsts, known = [], [], [], [np.zeros(1, np.int64)], np.zeros(0, np.uint64)
        for group in _groups(texts):
            data = LOWER[np.frombuffer(b" ".join(group), np.uint8)]
            offsets = np.cumsum([0, *(len(t) + 1 for t in group)])
            offsets[-1] -= 1
            starts, ends, hashes, first = _tokens(data, offsets)
            own, pick = np.unique(hashes, return_index=True)
            new = ~np.isin(own, known)
            for bucket, word in _grams(data, starts[pick[new]], ends[pick[new]]):
                grams.append(bucket.astype(np.int32))
                of.append(own[new][word])
            words.append(hashes)
            firsts.append(firsts[-1][-1] + first[1:])
            known = np.union1d(known, own)
        self.first = np.concatenate([firsts[0], *firsts[1:]])
        self.token = np.searchsorted(known, np.concatenate([np.zeros(0, np.uint64), *words]))
        word = np.searchsorted(known, np.concatenate([np.zeros(0, np.uint64), *of]))
        order = np.argsort(word, kind="stable")
        self.bucket = np.concatenate([np.zeros(0, np.int32), *grams])[order]
        self.at = np.searchsorted(word[order], np.arange(len(known) + 1))
        # Buckets met in few texts would only be learned by heart.
        met = np.zeros(BUCKETS, np.int64)
        for i, j in zip(self.first[:-1], self.first[1:], strict=True):
            words = np.unique(self.token[i:j])
            met[np.unique(self.bucket[_slices(self.at[words], self.at[words + 1])[0]])] += 1
        self.known = met >= LEAST_TEXTS


def _slices(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges a..b, and the range of each."""
    n = b - a
    which = np.repeat(np.arange(len(a)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + a[which], which


class Trainer:
    def __init__(self, bags: _Bags, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bags, self.rng = bags, rng
        self.e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)) * bags.known[:, None]
        self.w = np.zeros(DIM)  # the difference of the softmax's two rows
        self.b = -3.0  # fixed: a bag without evidence is not toxic
        self.ge, self.gw = np.full((BUCKETS, 1), 1e-6), np.full(DIM, 1e-6)

    def forward(self, a: np.ndarray, b: np.ndarray):
        tokens, row = _slices(a, b)
        words, inverse = np.unique(self.bags.token[tokens], return_inverse=True)
        grams, of = _slices(self.bags.at[words], self.bags.at[words + 1])
        bucket = self.bags.bucket[grams]
        size = np.bincount(of, minlength=len(words))
        x = np.add.reduceat(self.e[bucket], np.cumsum(size) - size, axis=0) / size[:, None]
        share = np.full(len(row), 1 / WINDOW)
        bag = np.stack([np.bincount(row, x[inverse, d] * share, len(a)) for d in range(DIM)], axis=1)
        return bag, bag @ self.w + self.b, (row, inverse, share, len(words), of, size, bucket)

    def step(self, a: np.ndarray, b: np.ndarray, y: np.ndarray, rate: float) -> None:
        bag, z, (row, inverse, share, n, of, size, bucket) = self.forward(a, b)
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        gw = bag.T @ g
        # All words' gradients point along w: one number each.
        word = np.bincount(inverse, g[row] * share, n) / size
        used, inv = np.unique(bucket, return_inverse=True)
        s = np.bincount(inv, word[of], len(used))
        ge = (s * self.bags.known[used])[:, None] * self.w[None, :]
        self.ge[used] += (ge**2).mean(axis=1, keepdims=True)
        self.e[used] -= rate * ge / np.sqrt(self.ge[used])
        self.gw += gw**2
        self.w -= rate * gw / np.sqrt(self.gw)

    def epochs(self, a, b, y, n: int, rate: float, batch: int = 256, least_steps: int = 120) -> None:
        for _ in range(max(n, -(-least_steps * batch // max(len(a), batch)))):
            order = self.rng.permutation(len(a))
            for i in range(0, len(a), batch):
                k = order[i : i + batch]
                self.step(a[k], b[k], y[k], rate)

    def all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(a[i : i + 2048], b[i : i + 2048])[1] for i in range(0, len(a), 2048)])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500, class_bytes: int = 8 << 20, seed: int = 0, threshold: float = 0.3) -> Model:
    rows = labelled_sample(docs, labels, label, per_class, class_bytes).collect()
    return fit(sorted(((r.text or "").encode(), r.y) for r in rows), seed, threshold)


def fit(rows: list[tuple[bytes, int]], seed: int = 0, threshold: float = 0.3) -> Model:
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    bags = _Bags([r[0] for r in rows])
    row, a, b = windows(bags.first)
    if not len(row):
        return Model(np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean()))))
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.2  # texts for calibration only
    learn = ~aside[row]
    t = Trainer(bags, seed)
    t.epochs(a[learn], b[learn], y[row][learn], 2, RATE)
    for _ in range(3):
        z = t.all(a, b)
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, row, z)
        # Toxic texts: the windows near the highest one; others: the highest, and some of the rest.
        keep = learn & np.where(y[row] == 1, z >= top[row] - 0.5, (z >= top[row]) | (rng.random(len(z)) < 0.3))
        t.epochs(a[keep], b[keep], y[row][keep], 3, RATE)
    z, top = t.all(a, b), np.full(len(y), -np.inf)
    np.maximum.at(top, row, z)
    use = aside & np.isfinite(top)
    if not {0.0, 1.0} <= set(y[use]):
        use = np.isfinite(top)
    # The contract's threshold is 0.3: its log-odds are put where the classes part.
    part = np.log(threshold / (1 - threshold))
    return Model(t.e @ t.w, min(float(t.b - cut_point(top[use], y[use]) + part), part - 0.5))


def cut_point(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the log-odds that separate the classes best, by balanced accuracy."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    pos, neg = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    good = np.concatenate([[0], np.cumsum(y == 0)]) / neg + (pos - np.concatenate([[0], np.cumsum(y == 1)])) / pos
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((edges[best[0]] + edges[best[-1]]) / 2)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, with score: the probability of toxic."""
    rest = [c for c in docs.columns if c not in (text, "score")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.value.astype(np.float32), model.bias))  # 512 KB, a constant

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(own.texts(*text_bytes(b.column(text))))], [*rest, "score"])

    return docs.select(*[f"`{c}`" for c in [*rest, text]]).mapInArrow(work, schema)
