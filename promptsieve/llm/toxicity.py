"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the different words of a text and their beginnings (4, 5 and 6 bytes),
hashed. For every labelled sentence that names a group of people, the identity term is swapped
for another of its list, and the loss penalises the squared change of the score between the two
sentences. A group's name alone then cannot carry a score, which lowers false alarms on neutral
mentions. Weights are shrunk by soft thresholds, so words without evidence have weight zero and
long texts gather no noise.

Fitted on at most ``max_rows`` labelled rows outside the held-out fold, in the order of a hash of
their id; only their features come to the driver. Scoring is one map over all documents.

NULL and empty texts have no words and get the score of the intercept. Rows with a NULL label or
id take no part in the fit. Without labelled rows the score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptsieve.llm.common import blocks, prepared, texts_of, values_of
from promptsieve.llm.features import Block, row_sums
from promptsieve.llm.quality import score_map, training_rows

BITS, LENGTHS = 18, (4, 5, 6)
MAX_ROWS = 20_000
EPOCHS, STEPS, BATCH, RATE, SHRINK, COUNTERFACTUAL = 8, 1500, 128, 0.1, 2e-4, 1.0
LEAST = 3
#: Identity terms; terms of one list stand for each other (fixed values).
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "natives", "foreigners"), ("mexicans", "africans", "americans", "europeans", "chinese", "indians"),
    ("old", "young", "elderly"), ("disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)
OTHER = {term: own[(k + 1) % len(own)] for own in IDENTITY for k, term in enumerate(own)}
TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(OTHER, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

#: What IGNORECASE takes for s and i, but lower() does not turn into them.
FOLDED = str.maketrans("ſıİ", "sii")


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """(sentence, the sentence with its identity terms swapped) for those that have any."""
    if not TERM.search(text):
        return []
    pairs = []
    for sentence in re.split(r"[.!?\n]+", text):
        swapped = TERM.sub(lambda m: OTHER[m[0].translate(FOLDED).lower()], sentence)
        if swapped != sentence:
            pairs.append((sentence, swapped))
    return pairs


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, index) of documents; (NULL, features of a sentence, of its counterfactual)."""
    for batch in batches:
        texts, label = texts_of(batch), values_of(batch, "label")
        rows = []
        for low, high in blocks(texts):
            x = Block(texts[low:high]).pieces(BITS, LENGTHS)
            rows += [(label[low + i], x.index[x.start[i]: x.start[i + 1]].tobytes(), None) for i in range(high - low)]
        pairs = [p for t in texts for p in counterfactuals(t.decode("utf-8", "replace"))]
        both = [s.encode() for p in pairs for s in p]
        for low, high in blocks(both):
            x = Block(both[low:high]).pieces(BITS, LENGTHS)
            rows += [(None, x.index[x.start[i]: x.start[i + 1]].tobytes(), (low + i) % 2 == 1) for i in range(high - low)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.bool_()))],
                                             names=["label", "index", "swapped"])


def fit(rows: list[np.ndarray], label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> np.ndarray:
    """Weights, the intercept last. ``pairs`` are the features of counterfactual sentences."""
    weight = np.zeros((1 << BITS) + 1)
    if not len(label) or not 0 < label.mean() < 1:
        if len(label):
            share = np.clip(label.mean(), 1e-4, 1 - 1e-4)
            weight[-1] = np.log(share / (1 - share))
        return weight
    rng = np.random.default_rng(seed)
    weight[-1] = np.log(label.mean() / (1 - label.mean()))
    seen = np.full(len(weight), 1e-2)
    often = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= LEAST
    rows = [r[often[r]] for r in rows]
    every = max(1, -(-len(pairs) * BATCH // len(rows)))
    turn = 0
    for _ in range(max(EPOCHS, STEPS * BATCH // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at: at + BATCH]
            own = [rows[i] for i in pick]
            start = np.concatenate([[0], np.cumsum([len(r) for r in own])])
            index = np.concatenate(own)
            z = weight[-1] + row_sums(start, weight[index])
            error = (1 / (1 + np.exp(-z)) - label[pick]) / len(pick)
            indices, steps = [index], [np.repeat(error, np.diff(start))]
            for _ in range(min(every, len(pairs))):
                a, b = pairs[turn % len(pairs)]
                turn += 1
                change = COUNTERFACTUAL * 2 * (weight[a].sum() - weight[b].sum()) / len(pick)
                indices += [a, b]
                steps += [np.full(len(a), change), np.full(len(b), -change)]
            used, slot = np.unique(np.concatenate(indices), return_inverse=True)
            g = np.bincount(slot, np.concatenate(steps), minlength=len(used))
            seen[used] += g * g
            pace = RATE / np.sqrt(seen[used])
            moved = weight[used] - pace * g
            weight[used] = np.sign(moved) * np.maximum(np.abs(moved) - pace * SHRINK, 0)
            seen[-1] += error.sum() ** 2
            weight[-1] -= RATE * error.sum() / np.sqrt(seen[-1])
    return weight


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> np.ndarray:
    rows = training_rows(docs, labels, "toxic", folds, held, max_rows).mapInArrow(
        _features, "label int, index binary, swapped boolean").toArrow().to_pylist()
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    whole = [k for k, r in enumerate(rows) if r["swapped"] is None]
    sentence = [index[k] for k, r in enumerate(rows) if r["swapped"] is not None]
    label = np.array([rows[k]["label"] for k in whole], np.float64)
    return fit([index[k] for k in whole], label, list(zip(sentence[::2], sentence[1::2])))


class Margin:
    """The model as a function of texts, as it is sent to the tasks."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight.astype(np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = Block(texts).pieces(BITS, LENGTHS)
        return self.weight[-1] + row_sums(x.start, self.weight[x.index])


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> DataFrame:
    prepared(docs.sparkSession)
    return score_map(docs, Margin(train(docs, labels, folds, held, max_rows)), folds, held)
