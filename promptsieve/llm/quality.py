"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): the second
sum is that of all pairwise interactions <v_i, v_j> x_i x_j, in time linear in the features.
Features are hashed words (log counts, scaled to length 1) and the statistics of
``features.STATISTICS``, centred, scaled and given as bounded values.

The model is fitted on labelled rows outside the held-out fold, at most ``max_rows`` of them,
taken in the order of a hash of their id: a bounded sample, whose features alone come to the
driver. Scoring is one map over all documents.

NULL and empty texts are scored by their statistics. Rows with a NULL label or id take no part
in the fit; repeated labels count as often as they come. Without labelled rows, or with one
class only, the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import blocks, fold, fold_of, prepared, texts_of, values_of
from promptsieve.llm.features import STATISTICS, Block, Sparse, row_sums

BITS, RANK = 15, 6
MAX_ROWS = 12_000
THRESHOLD = 0.3
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 600, 128, 0.05, 1e-4


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, words: Sparse, statistics: np.ndarray) -> Sparse:
        """Words and statistics in one sparse matrix; statistics come after the words."""
        n, k = statistics.shape
        value = np.clip((statistics - self.mean) / self.scale, -4, 4) / 2
        start = words.start + np.arange(n + 1) * k
        index = np.empty(len(words.index) + n * k, np.int32)
        out = np.empty(len(index), np.float32)
        own = (start[1:, None] - k + np.arange(k)).ravel()
        rest = np.ones(len(index), bool)
        rest[own] = False
        index[own], out[own] = np.tile(np.arange(k) + (1 << BITS), n), value.ravel()
        index[rest], out[rest] = words.index, words.value
        return Sparse(start, index, out)

    def margins(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, the factor sums of each row)."""
        vx = self.factors[x.index] * x.value[:, None]
        sums = row_sums(x.start, vx)
        pairs = ((sums * sums) - row_sums(x.start, vx * vx)).sum(1) / 2
        return self.bias + row_sums(x.start, self.linear[x.index] * x.value) + pairs, sums


def fit(words: Sparse, statistics: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in small batches."""
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + statistics.shape[1]
    known = len(label) and 0 < label.mean() < 1
    share = label.mean() if len(label) else 0.5
    model = Machine(
        float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))), np.zeros(size, np.float32),
        (rng.standard_normal((size, RANK)) * (0.02 if known else 0)).astype(np.float32),
        statistics.mean(0) if len(label) else np.zeros(statistics.shape[1], np.float32),
        (statistics.std(0) if len(label) else np.ones(statistics.shape[1], np.float32)) + np.float32(1e-6))
    if not known:
        return model
    x = model.rows(words, statistics)
    seen_w, seen_v, seen_b = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32), 1e-3
    for _ in range(max(EPOCHS, STEPS * BATCH // len(label))):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            pick = order[at: at + BATCH]
            length = x.start[pick + 1] - x.start[pick]
            start = np.concatenate([[0], np.cumsum(length)])
            take = np.repeat(x.start[pick] - start[:-1], length) + np.arange(start[-1])
            part = Sparse(start, x.index[take], x.value[take])
            z, sums = model.margins(part)
            error = (1 / (1 + np.exp(-z)) - label[pick]).astype(np.float32) / len(pick)
            row = np.repeat(np.arange(len(pick)), length)
            used, slot = np.unique(part.index, return_inverse=True)
            g = error[row] * part.value
            gw = np.bincount(slot, g, minlength=len(used)) + DECAY * model.linear[used]
            gv = np.empty((len(used), RANK))
            for f in range(RANK):
                own = g * (sums[row, f] - model.factors[part.index, f] * part.value)
                gv[:, f] = np.bincount(slot, own, minlength=len(used))
            gv += DECAY * model.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += float(error.sum()) ** 2
            model.linear[used] -= RATE * gw / np.sqrt(seen_w[used])
            model.factors[used] -= RATE * gv / np.sqrt(seen_v[used])
            model.bias -= RATE * float(error.sum()) / seen_b ** 0.5
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, label = texts_of(batch), values_of(batch, "label")
        rows = []
        for low, high in blocks(texts):
            block = Block(texts[low:high])
            words, statistics = block.counts(BITS), block.statistics()
            for i in range(high - low):
                own = slice(words.start[i], words.start[i + 1])
                rows.append((label[low + i], words.index[own].tobytes(), words.value[own].tobytes(), statistics[i].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                             names=["label", "index", "value", "statistics"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int) -> DataFrame:
    """(text, label) of the rows of at most ``max_rows`` labelled documents outside the held-out
    fold; of repeated labels the larger one counts. No more than ``max_rows`` numbers are sent to
    the tasks, so no text is shuffled."""
    known = labels.where(F.col(label).isNotNull() & (fold_of("doc_id", folds) != held)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0,
          max_rows: int = MAX_ROWS) -> Machine:
    rows = training_rows(docs, labels, label, folds, held, max_rows).mapInArrow(
        _sample_features, "label int, index binary, value binary, statistics binary").toArrow()
    join = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    length = np.array([len(x) // 4 for x in rows.column("index").to_pylist()], np.int64)
    y = rows.column("label").to_numpy().astype(np.float32)
    return fit(Sparse(np.concatenate([[0], np.cumsum(length)]), join("index", np.int32), join("value", np.float32)),
               join("statistics", np.float32).reshape(-1, len(STATISTICS)), y)


def margins(model: Machine, texts: list[bytes]) -> np.ndarray:
    block = Block(texts)
    return model.margins(model.rows(block.counts(BITS), block.statistics()))[0]


def score_map(docs: DataFrame, margin, folds: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted: one map over all documents. ``margin`` gives the
    scores before the sigmoid of a list of texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = values_of(batch, "doc_id"), texts_of(batch)
            z = [shared.value(texts[low:high]) for low, high in blocks(texts)]
            z = np.concatenate(z).astype(np.float64) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([fold(i, folds) == held for i in ids], pa.bool_()),
                pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


class Margin:
    """The machine as a function of texts, as it is sent to the tasks."""

    def __init__(self, model: Machine):
        self.model = model

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return margins(self.model, texts)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS) -> DataFrame:
    prepared(docs.sparkSession)
    return score_map(docs, Margin(train(docs, labels, "quality", folds, held, max_rows)), folds, held)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    prepared(docs.sparkSession)
    margin = docs.sparkSession.sparkContext.broadcast(Margin(train(docs, labels)))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            z = [margin.value(texts[low:high]) for low, high in blocks(texts)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -60, 60))) if z else np.zeros(0)
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema).select(columns)
