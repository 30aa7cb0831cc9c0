"""Toxicity by a classifier chain of linear models.

Categories come in a fixed order. The model of a category sees the words of a document and the probabilities that the
models of the earlier categories gave. For training, those are out-of-fold predictions: a document's fold is left out of
the model that predicts it, so later models see probabilities of the quality that they will see at use.

Training takes a bounded sample of labelled rows (``sample`` rows, those of the smallest hash of the id, whole texts) and
is fitted by proximal gradient with an L1 penalty, which leaves few words with a weight. Scoring covers all rows, each by
itself.

Defined cases: null text is empty; a null label leaves the row out of that category's training; categories without both
classes in the sample get the base rate; without labels nothing is toxic; repeated rows are scored each; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.llm.bpe import text_groups
from annodelta.llm.text import whole_text

WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: Longer words also give their first letters, so that inflected and unseen words of a known stem count.
STEM = 4
SAMPLE = 4_000
FOLDS = 4
#: Words of fewer documents of the sample, or of a larger share of it, carry no weight.
LEAST_DOCS, MOST_SHARE = 5, 0.3
PENALTY = 0.004
STEPS = 80


def text_words(text: str) -> set[str]:
    """The words and runs of marks of a text in lower case, and ^ with the first letters of its longer words."""
    words = set(WORD.findall(text.lower()))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass(frozen=True)
class Linear:
    """log-odds = bias + weights of the words present + carry over the earlier categories' log-odds."""

    bias: float
    words: dict[str, float]
    carry: tuple[float, ...]


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]
    #: Of the last category's probability: best F1 on its out-of-fold predictions.
    threshold: float = 0.5

    def predict(self, texts: list[str]) -> np.ndarray:
        """A column of probabilities per category."""
        sets = [text_words(t) for t in texts]
        earlier = np.zeros((len(texts), 0))
        for model in self.models:
            known = model.words.keys()
            odds = np.array([sum(map(model.words.__getitem__, sorted(known & s))) for s in sets], dtype=float)
            odds += model.bias + earlier @ np.array(model.carry)
            earlier = np.column_stack([earlier, odds])
        return 1 / (1 + np.exp(-np.clip(earlier, -30, 30)))


class _Rows:
    """Presence of words by row (compressed rows), with dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray) -> None:
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.word = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.size, self.width, self.dense = len(rows), width, dense
        # Columns of unit size, so that rare words are learnt as fast as common ones.
        squares = np.concatenate([np.bincount(self.word, minlength=width), (dense ** 2).sum(axis=0)])
        self.scale = 1 / np.sqrt(np.maximum(squares / max(self.size, 1), 1e-3))

    def times(self, w: np.ndarray) -> np.ndarray:
        w = w * self.scale
        return np.bincount(self.row, w[:self.width][self.word], self.size) + self.dense @ w[self.width:]

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.scale * np.concatenate([np.bincount(self.word, r[self.row], self.width), self.dense.T @ r])


def _fit(rows: list[np.ndarray], width: int, dense: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights (words, then dense columns) of an L1-penalised logistic regression."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-6
        return float(np.log(rate / (1 - rate))), np.zeros(width + dense.shape[1])
    x = _Rows(rows, width, dense)
    n = len(y)
    v = np.ones(width + dense.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = x.back(x.times(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * (np.linalg.norm(x.back(x.times(v))) / n + 1))
    w, b = np.zeros(len(v)), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead) + ahead_b, -30, 30)))
        residual = (p - y) / n
        moved = ahead - step * x.back(residual)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b = ahead_b - step * residual.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w * x.scale


def fit_chain(texts: list[set[str]], folds: np.ndarray, labels: dict[str, np.ndarray]) -> Chain:
    """A chain over the categories of ``labels`` (NaN: not labelled), in their order."""
    counts: dict[str, int] = {}
    for words in texts:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    vocabulary = sorted(w for w, c in counts.items() if LEAST_DOCS <= c <= MOST_SHARE * len(texts))
    index = {w: k for k, w in enumerate(vocabulary)}
    rows = [np.array(sorted(index[w] for w in words if w in index), dtype=np.int64) for words in texts]
    dense, models = np.zeros((len(texts), 0)), []

    def fitted(chosen: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        return _fit([rows[k] for k in chosen], len(vocabulary), dense[chosen], y[chosen])

    for y in labels.values():
        labelled = ~np.isnan(y)
        bias, weights = fitted(np.flatnonzero(labelled), y)
        held_out = np.zeros(len(texts))
        for fold in range(FOLDS):
            b, w = fitted(np.flatnonzero(labelled & (folds != fold)), y)
            for k in np.flatnonzero(folds == fold):
                held_out[k] = b + w[rows[k]].sum() + dense[k] @ w[len(vocabulary):]
        words = {vocabulary[k]: float(weights[k]) for k in np.flatnonzero(weights[:len(vocabulary)])}
        models.append(Linear(float(bias), words, tuple(map(float, weights[len(vocabulary):]))))
        dense = np.column_stack([dense, np.clip(held_out, -30, 30)])
    return Chain(tuple(labels), tuple(models), _best_threshold(dense[:, -1], y) if len(texts) else 0.5)


def _best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the held-out score that gives the best F1; 0.5 where a class is missing."""
    odds, y = odds[~np.isnan(y)], y[~np.isnan(y)]
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-odds, kind="stable")
    odds, y = odds[order], y[order]
    last = np.append(odds[1:] != odds[:-1], True)  # equal scores fall on one side
    f1 = np.where(last, 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum()), 0)
    best = int(np.argmax(f1))
    below = odds[best + 1] if best + 1 < len(odds) else odds[best]
    return float(1 / (1 + np.exp(-(odds[best] + below) / 2)))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> Chain:
    """Fit on the ``sample`` labelled rows with the smallest hash of the id; ``categories``: name and 0/1 expression."""
    chosen = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *(F.max(value).cast("double").alias(f"_label{k}") for k, value in enumerate(categories.values()))
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("_text"))
    joined = texts.join(chosen, F.col("_id") == F.col("_chosen")).select(
        "_id", "_text", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("_fold"),
        *(f"_label{k}" for k in range(len(categories))))
    kinds = ", ".join(f"_label{k} double" for k in range(len(categories)))
    found = joined.mapInArrow(_with_words, f"_id long, _fold int, {kinds}, words array<string>").toArrow()
    order = np.lexsort([found["_id"].to_numpy()])
    found = found.take(order)
    values = {name: found[f"_label{k}"].to_numpy().astype(float) for k, name in enumerate(categories)}
    return fit_chain([set(w) for w in found["words"].to_pylist()], found["_fold"].to_numpy(), values)


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([sorted(text_words(t)) for t in batch.column("_text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [c for c, n in zip(batch.columns, batch.schema.names) if n != "_text"] + [words],
            names=[n for n in batch.schema.names if n != "_text"] + ["words"])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, and toxic: the last category's probability reaches the threshold."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_groups(texts):
                p = chain.predict(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start:part.stop], *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= chain.threshold)],
                    names=["doc_id", *names, "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are; works within a row, so without a shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index("text")).to_pylist()]
            toxic = [chain.predict(texts[part])[:, -1] >= chain.threshold for part in text_groups(texts)]
            yield batch.filter(pa.array(~np.concatenate(toxic))) if toxic else batch

    return docs.mapInArrow(run, docs.schema)
