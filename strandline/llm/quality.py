"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is encoded by shape
features (symbols, case, repetition, lengths) and one hidden layer; gated
attention gives every passage a weight, and the weighted mean of the encodings
is scored.  Only the document's label teaches, so the attention learns which
passages decide it.  Every passage of every text is encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BLANK_WORDS, bounded_batches, pieces, utf8, words
from strandline.llm.folds import fold, sample_rows

#: Words of a passage.
PASSAGE = 64
#: Labelled rows that train the model: a bound.
TRAINING_ROWS = 6_000
FOLDS = 5
#: Score from which a document counts as good.
GOOD = 0.3
HIDDEN, GATE, ROUNDS, BATCH = 16, 8, 60, 256

# Byte classes whose shares of a passage are features.
_CLASSES = {
    "upper": lambda b: (b >= 65) & (b <= 90),
    "digit": lambda b: (b >= 48) & (b <= 57),
    "letter": lambda b: (((b | 32) >= 97) & ((b | 32) <= 122)) | (b >= 128),
    "mark": lambda b: (b == 35) | (b == 36) | (b == 37) | (b == 38) | (b == 42) | (b == 126) | (b == 94),
    "bar": lambda b: (b == 124) | (b == 60) | (b == 62) | (b == 123) | (b == 125) | (b == 61) | (b == 95),
    "bang": lambda b: (b == 33) | (b == 63),
    "stop": lambda b: (b == 46) | (b == 44) | (b == 59) | (b == 58),
}
FEATURES = len(_CLASSES) + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of all passages of a column's bytes, in order."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros((0, FEATURES), np.float32)]
    for first, last in pieces(offsets):
        own = data[offsets[first] : offsets[last]]
        w = words(own, offsets[first : last + 1] - offsets[first], BLANK_WORDS)
        n = len(w.hash)
        if n == 0:
            continue
        starts = np.concatenate(([0], np.flatnonzero(np.diff(w.row)) + 1))
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        heads = np.flatnonzero(place % PASSAGE == 0)
        size = np.diff(np.append(heads, n))
        passage = np.repeat(np.arange(len(heads)), size)
        low, high = w.start[heads], w.end[np.append(heads[1:], n) - 1]
        span = (high - low).astype(np.float32)
        columns = []
        for test in _CLASSES.values():
            sums = np.concatenate(([0], np.cumsum(test(own), dtype=np.int32)))
            columns.append((sums[high] - sums[low]) / span)
            if test is _CLASSES["mark"]:
                marked = (sums[w.end] > sums[w.start]).astype(np.float32)
                columns.append(np.add.reduceat(marked, heads) / size)
        length = (w.end - w.start).astype(np.float32)
        columns.append(np.add.reduceat(length, heads) / size / 10)
        columns.append(np.add.reduceat(np.minimum(length, 60) ** 2, heads) / size / 100)
        again = np.zeros(n, np.float32)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        columns.append(np.add.reduceat(again, heads) / size)
        second = np.zeros(n, np.float32)
        second[2:] = (w.hash[2:] == w.hash[:-2]) & (w.row[2:] == w.row[:-2])
        columns.append(np.add.reduceat(second, heads) / size)
        order = np.lexsort((w.hash, passage))
        new = np.ones(n, np.float32)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        columns.append(np.add.reduceat(new, heads) / size)
        columns.append(np.log1p(size) / 4)
        rows.append(w.row[heads] + first)
        found.append(np.stack(columns, axis=1).astype(np.float32))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    """Encoder, gated attention and scorer, with the scaling of features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def scores(self, row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """P(label 1) of bags 0 to n - 1; a bag without passages has a zero encoding."""
        return _forward(self.p, (x - self.mean) / self.scale, row, n)["score"]


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    if len(row):
        heads = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        out[row[heads]] = np.add.reduceat(values, heads, axis=0)
    return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray, row: np.ndarray, n: int) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    # Gates are bounded, so the weights need no shift before exp.
    a = np.exp(np.clip(e, -30, 30))
    total = _sums(a, row, n)
    a = a / total[row] if len(row) else a
    z = _sums(a[:, None] * h, row, n)
    score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}


def _backward(p, x, row, n, f, y):
    err = (f["score"] - y) / n
    grad = {"c": f["z"].T @ err, "d": err.sum(keepdims=True)}
    dz = err[:, None] * p["c"]
    da = (dz[row] * f["h"]).sum(axis=1)
    de = f["a"] * (da - _sums(f["a"] * da, row, n)[row])
    grad["w"] = (f["t"] * f["g"]).T @ de
    dg = de[:, None] * p["w"]
    dt, du = dg * f["g"] * (1 - f["t"] ** 2), dg * f["t"] * f["g"] * (1 - f["g"])
    grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ du
    dh = (f["a"][:, None] * dz[row] + dt @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    grad["W"], grad["b"] = x.T @ dh, dh.sum(axis=0)
    return grad


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Mini-batches of bags, Adam, a fixed number of rounds."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([*bags, np.zeros((0, FEATURES), np.float32)])
    mean = everything.mean(axis=0) if len(everything) else np.zeros(FEATURES)
    scale = everything.std(axis=0) + 1e-3 if len(everything) else np.ones(FEATURES)
    p = {
        "W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
    }
    if len(labels):
        share = np.clip(labels.mean(), 0.01, 0.99)
        p["d"][0] = np.log(share / (1 - share))
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(ROUNDS if len(bags) else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            row = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            x = (np.concatenate([bags[i] for i in own]) - mean) / scale
            grad = _backward(p, x, row, len(own), _forward(p, x, row, len(own)), labels[own])
            t += 1
            for k in p:
                g = grad[k] + (1e-4 * p[k] if k not in "bd" else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p)


def score_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = FOLDS, good: float = GOOD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned from at most about ``TRAINING_ROWS`` rows of ``labels``
    outside fold 0 whose label is not null (of repeated ids the largest
    counts).  Null texts are empty; a text without words gets the score of a
    zero encoding.  Without labels all scores follow the untrained model.
    Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = F.broadcast(sample_rows(known, TRAINING_ROWS, known.count(), 1).limit(2 * TRAINING_ROWS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = passages(*utf8(batch.column("text")))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["label", "bag"])

    # Features of a bounded sample: about 4 kB for a text of average length.
    sample = docs.join(picked, "doc_id").select("text", "label").mapInArrow(encode, "label int, bag binary").toArrow()
    bags = [np.frombuffer(b.as_py(), np.float32).reshape(-1, FEATURES) for b in sample.column("bag")]
    order = sorted(range(len(bags)), key=lambda i: (len(bags[i]), bags[i].tobytes()))
    model = train([bags[i] for i in order], sample.column("label").to_numpy().astype(float)[order])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = passages(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(row, x, batch.num_rows))], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))
