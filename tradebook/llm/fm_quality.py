"""Quality of documents by a factorisation machine over hashed words, structure and size.

    score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum is worked out in linear time as half of sum_f ((sum_i v_if
x_i)^2 - sum_i v_if^2 x_i^2).  Ids, languages and sources are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import as_bytes, bounded_sample, held_out
from tradebook.llm.text_features import BUCKETS, NAMES, vector

SAMPLE = 4_000  # labelled rows a model is fitted on, at most
RANK = 8
THRESHOLD = 0.7
MOST = 8.0  # standard deviations that a feature counts for, at most


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # (features,)
    factors: np.ndarray  # (features, rank)
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) * self.scale, -MOST, MOST)
        pairs = 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(1)
        return self.bias + x @ self.linear + pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, rounds: int = 300, rate: float = 0.02, decay: float = 1e-3) -> Machine:
    """Logistic loss with a quadratic penalty, Adam on all rows at once; the same rows give the same machine."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.02)
    scale[len(NAMES) :] *= 0.3  # single words count less than structure
    n, m = x.shape
    z = np.clip((x - mean) * scale, -MOST, MOST)
    rng = np.random.default_rng(3)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    params = np.concatenate([[np.log(share / (1 - share))], np.zeros(m), rng.normal(0, 0.01, m * rank)])
    grown, squared = np.zeros_like(params), np.zeros_like(params)
    square = z * z
    for i in range(1, rounds + 1):
        v = params[1 + m :].reshape(m, rank)
        s = z @ v
        p = 1 / (1 + np.exp(-np.clip(params[0] + z @ params[1 : 1 + m] + 0.5 * (s**2 - square @ v**2).sum(1), -30, 30)))
        off = (p - y) / n
        slope = z.T @ (off[:, None] * s) - (square.T @ off)[:, None] * v
        grad = np.concatenate([[off.sum()], z.T @ off + decay * params[1 : 1 + m], (slope + 4 * decay * v).ravel()])
        grown, squared = 0.9 * grown + 0.1 * grad, 0.999 * squared + 0.001 * grad**2
        params -= rate * (grown / (1 - 0.9**i)) / (np.sqrt(squared / (1 - 0.999**i)) + 1e-8)
    return Machine(float(params[0]), params[1 : 1 + m], params[1 + m :].reshape(m, rank), mean, scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, text) of at most ``most`` labelled rows that aren't held out; a label without a document gives none."""
    told = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    few = bounded_sample(told.where(~held_out(F.col("doc_id"))), "doc_id", most)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.join(F.broadcast(few), "doc_id").select("y", "text")  # at most ``most`` narrow rows


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, **names: str) -> Machine:
    """A machine from a bounded sample; what reaches the driver is one vector of fixed size per sampled row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [vector(as_bytes(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["y", "x"])

    rows = labelled_sample(docs, labels, label, most, **names).mapInArrow(work, "y int, x binary").limit(2 * most).toPandas()
    width = len(NAMES) + BUCKETS
    if not len(rows):
        return Machine(0.0, np.zeros(width), np.zeros((width, RANK)), np.zeros(width), np.ones(width))
    rows = rows.sort_values(["y", "x"])  # the order in which tasks end plays no part
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, width)
    return fit(x, rows["y"].to_numpy())


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    Null and empty texts are scored as texts without words.  Repeated rows give equal rows, a null id stays null (and
    isn't held out).  Without any label every score is 0.5.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.stack([vector(as_bytes(t)) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.scores(x))], ["doc_id", "score"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(work, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text scores ``threshold`` or more.

    The verdict is worked out beside the row, so no join brings texts and scores together.
    """
    at, schema = docs.columns.index(text), docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                x = np.stack([vector(as_bytes(t)) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(machine.scores(x) >= threshold))

    return docs.mapInArrow(work, schema)
