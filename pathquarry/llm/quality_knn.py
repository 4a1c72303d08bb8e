"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted into hashed features: the shapes of its words (runs of upper-case, lower-case, digit and sign bytes), pairs of
shapes, whether words repeat their predecessors, its length, and its words themselves at a low weight. Square roots of their
shares, weighed by rarity, are projected on the leading singular directions of a labelled sample and normalised. Every text is
compared with all labelled vectors by exact cosines, in blocks, and the labels of the nearest ones vote by similarity.

The sample holds at most 2 * per_class labelled texts, so its vectors are bounded (3,000 x 48 floats by default) and broadcast.
Texts without words (null, empty, blank) score 0. Repeated rows score alike. Without labels every score is 0.5; without a
positive similarity it is the sample's mean label. Of sample vectors tied for the last place among the nearest (equal cosines) all
vote, sharing the places that are left. Texts of any length are used whole. An empty table gives no rows. Other columns pass through;
`score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, SpanHash, labelled_sample, mix64, pieces, text_bytes, word_spans

FEATURES = 1024
DIM = 48
NEIGHBOURS = 15
#: Byte kinds: lower-case (and all non-ASCII), upper-case, digit; signs stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[97:123] = KIND[128:] = ord("a")
KIND[65:91] = ord("A")
KIND[48:58] = ord("0")
WORD_WEIGHT = 0.15


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x FEATURES: weighted shares of the features, square-rooted."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros(n * FEATURES)
    if len(starts):
        kind = KIND[data]
        # A word's shape: its bytes' kinds without repetition. The dropped bytes are skipped by hashing what is left.
        keep = np.ones(len(kind), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[starts] = True
        left = np.concatenate([[0], np.cumsum(keep)])
        shape = SpanHash(kind[keep])(left[starts], left[ends])
        word = SpanHash(LOWER[data])(starts, ends)
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        before = np.where(new, np.uint64(1), np.roll(shape, 1))
        same = np.zeros(len(row), np.uint64)
        for back in (1, 2):
            same[back:] |= ((word[back:] == word[:-back]) & (row[back:] == row[:-back])).astype(np.uint64) << np.uint64(back - 1)
        with np.errstate(over="ignore"):
            pair = mix64(before * np.uint64(31) + shape)
            for values, weight, salt in ((shape, 1.0, 1), (pair, 1.0, 2), (same, 1.0, 3), (word, WORD_WEIGHT, 4)):
                cell = (mix64(values + np.uint64(salt << 32)) % np.uint64(FEATURES)).astype(np.int64)
                out += np.bincount(row * FEATURES + cell, minlength=n * FEATURES) * weight
    out = out.reshape(n, FEATURES)
    words = np.diff(first)
    out /= np.maximum(words, 1)[:, None]
    size = (mix64(np.log2(words + 1).astype(np.uint64) + np.uint64(5 << 32)) % np.uint64(FEATURES)).astype(np.int64)
    out[np.arange(n), size] += 0.1
    return np.sqrt(out).astype(np.float32)


@dataclass
class Model:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, features: np.ndarray) -> np.ndarray:
        v = (features * self.rarity) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, features: np.ndarray, block: int = 512) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(features), 0.5)
        out = np.full(len(features), self.labels.mean())
        k = min(NEIGHBOURS, n)
        for i in range(0, len(features), block):
            part = features[i : i + block]
            cosine = np.round(self.project(part) @ self.vectors.T, 5)  # equal vectors have equal cosines, whatever the rounding
            last = np.partition(cosine, n - k, axis=1)[:, n - k, None]
            above, tied = cosine > last, cosine == last
            share = above + tied * ((k - above.sum(axis=1)) / tied.sum(axis=1)).astype(np.float32)[:, None]
            square = np.maximum(cosine, 0) ** 2
            weight = share * square * square
            total = weight.sum(axis=1)
            some = total > 0
            out[i : i + block][some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def fit(features: np.ndarray, labels: np.ndarray) -> Model:
    if not len(labels):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    rarity = np.log((1 + len(labels)) / (1 + (features > 0).sum(axis=0))) + 1
    x = features * rarity
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, np.argsort(values)[::-1][: min(DIM, len(labels))]]
    model = Model(rarity.astype(np.float32), basis.astype(np.float32), np.zeros((0, 1), np.float32), labels)
    model.vectors = model.project(features).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500) -> Model:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = counts(*text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), b.column("y")], ["features", "y"])

    rows = labelled_sample(docs, labels, label, per_class).mapInArrow(work, "features binary, y int").collect()
    rows = sorted((bytes(r.features), r.y) for r in rows)  # the same model whatever order rows arrive in
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows], np.float32).reshape(len(rows), FEATURES)
    return fit(x, np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score, the share of good labels among the nearest; the text is left out unless keep_text."""
    rest = [c for c in docs.columns if c != "score" and (keep_text or c != text)]
    take = list(dict.fromkeys([*rest, text]))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in pieces(batches, text):
            data, offsets = text_bytes(b.column(text))
            votes = own.vote(counts(data, offsets))
            votes[np.diff(word_spans(data, offsets)[2]) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(votes)], [*rest, "score"])

    return docs.select(*[f"`{c}`" for c in take]).mapInArrow(work, schema)
