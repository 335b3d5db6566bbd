"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 7).

Statistics of whole texts (character classes, word and line shapes, repetition) are binned at quantiles of a bounded labelled
sample; trees of fixed depth are grown by histogram gains on logistic loss in numpy and flattened into arrays, so that all
documents of a batch descend all trees by array indexing.

Defined edge cases: null and empty texts have all-zero statistics and are scored like any other; texts of any length are
measured whole; without labelled rows of both kinds every score is the sample's share of label 1 (0.5 if there is none); a
null doc_id is scored but never learned from, and of an id with both labels 1 counts; equal texts score alike, and of equal
gains the first feature and cut are taken; other columns never enter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.sampling import labelled_rows

#: sample bound: documents of each label
PER_LABEL = 4000
BINS, TREES, DEPTH, RATE = 64, 80, 4, 0.15
N_STATISTICS = 20


def _classes() -> np.ndarray:
    """Byte -> class: upper, lower, digit, space, line break, sentence mark, symbol, other mark, beyond ASCII."""
    of = np.full(256, 8)
    of[:128] = 7
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:!?", "#*$%&|<>")):
        of[[ord(c) for c in chars]] = k
    return of


_CLASS = np.zeros((256, 9))
_CLASS[np.arange(256), _classes()] = 1


def statistics(raw: bytes) -> list[float]:
    """Document statistics of UTF-8 text."""
    n = len(raw)
    if not n:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = (counts @ _CLASS / n).tolist()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    longest = max(map(len, words), default=0)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(len(words) - 2, 1)
    return [
        *share,
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        len(b"".join(words)) / nw,
        float(np.log1p(longest)),
        len(set(words)) / nw,
        triples,
        len(set(lines)) / nl,
        float(np.log1p(n / nl)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / nl,
        counts[ord("!")] / nw,
        counts[ord("|")] / nw,
    ]


@dataclass
class Trees:
    """Flattened complete trees: node k has children 2k + 1 and 2k + 2; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    z = np.full(len(y), base)
    out_f, out_t, out_v = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                place = flat[rows].reshape(-1)
                size = x.shape[1] * BINS
                hist = [np.bincount(place, np.repeat(v[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1) for v in (g, h)]
                gl, hl = hist
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                k, b = divmod(int(gain.argmax()), BINS)
                if gain[k, b] > 1e-6 and b < len(cuts[k]):
                    feature[node], threshold[node] = k, cuts[k][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        z += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_v), base)


def measured(raw: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py() or b"") for t in raw]).reshape(-1, N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, where: Column, per_label: int = PER_LABEL) -> Trees:
    """Fitted on the statistics of up to per_label documents of each label; they are taken on the executors, texts never reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = pa.array(measured(part.column(2)).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), x], names=["doc_id", "label", "x"])

    rows = labelled_rows(docs, labels, "quality", per_label, where)
    if rows is None:
        return train(np.zeros((0, N_STATISTICS)), np.zeros(0))
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "label", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, label long, x array<double>").collect()
    got.sort(key=lambda r: r["doc_id"])
    return train(np.array([r["x"] for r in got]).reshape(-1, N_STATISTICS), np.array([r["label"] for r in got], float))


def score(df: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = model.score(measured(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", df["text"].cast("binary")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
