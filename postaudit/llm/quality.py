"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios under a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postaudit.llm.features import held_out, indicators, labelled_sample, raw_bytes, sampled_texts

BITS = 17
PER_LABEL, SAMPLE = 1200, 2400
"""The classifier learns from this many rows of a label, and of both, at most."""
SMOOTH, COST, PASSES = 1.0, 0.1, 30

@dataclass
class Model:
    weights: np.ndarray  # of the indicators; the ratios are already multiplied in
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        at = indicators(raw_bytes(text), BITS)
        margin = float(self.weights[at].sum() / np.sqrt(max(1, len(at)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))

def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of (share of an indicator among good rows / among the others), with smoothed counts."""
    shares = []
    for side in (True, False):
        counts = np.full(1 << BITS, SMOOTH)
        for at, is_good in zip(rows, good):
            if is_good == side:
                counts[at] += 1
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])

def dual_descent(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: np.ndarray, passes: int = PASSES,
                 seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss plus half their square, one dual variable at a time.

    Row i has the value scale[j] / sqrt(number of its indicators) for each of its indicators j, and one constant 1.
    """
    rng, weights, bias = np.random.default_rng(seed), np.zeros(len(scale)), 0.0
    values = [scale[at] / np.sqrt(max(1, len(at))) for at in rows]
    norms = np.array([v @ v + 1 for v in values])
    alpha = np.zeros(len(rows))
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-4 * cost.max():
            break
    return weights, bias

def logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of labels to margins, by Newton steps; the slope is positive."""
    slope, offset = 1.0, 0.0
    target = np.where(good, 0.99, 0.01)  # soft targets, as margins may separate the labels
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -35, 35)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        gap = weight * (target - p)
        h = np.array([[curve @ margins**2 + 1e-3, curve @ margins], [curve @ margins, curve.sum() + 1e-3]])
        step = np.linalg.solve(h, [gap @ margins, gap.sum()])
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 1e-6), offset

def train(rows: list[tuple[int, np.ndarray]], share: float) -> Model:
    """Fit on (label, indicators); `share` of the labelled rows that are not held out have label 1, which the scores are calibrated to.

    Four fifths give ratios and weights whose margins on the last fifth fit the calibration; with one label
    only, the score is constant: near that label.
    """
    good = np.array([label == 1 for label, _ in rows], bool)
    if not len(good) or good.all() or not good.any():
        level = 0.5 if not len(good) else 0.99 if good.all() else 0.01
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(level / (1 - level))))
    at = [a for _, a in rows]
    prior = np.where(good, share, 1 - share)
    balance = np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))

    def learn(mask: np.ndarray) -> tuple[np.ndarray, float]:
        used = [a for a, m in zip(at, mask) if m]
        scale = log_ratios(used, good[mask])
        weights, bias = dual_descent(used, np.where(good[mask], 1.0, -1.0), scale, COST * balance[mask])
        return weights * scale, bias

    def margins(weights: np.ndarray, bias: float) -> np.ndarray:
        return np.array([weights[a].sum() / np.sqrt(max(1, len(a))) + bias for a in at])

    fold = np.zeros(len(rows), int)
    for side in (good, ~good):
        fold[side] = np.arange(side.sum()) % 5
    if min(good.sum(), (~good).sum()) < 5:
        weights, bias = learn(np.ones(len(rows), bool))
        slope, offset = logistic(margins(weights, bias), good, prior * balance)
        return Model(weights, bias, slope, offset)
    # Margins of rows that were not learnt from, for each fold.
    free = np.zeros(len(rows))
    for k in range(5):
        weights, bias = learn(fold != k)
        free[fold == k] = margins(weights, bias)[fold == k]
    slope, offset = logistic(free, good, prior * balance)
    weights, bias = learn(np.ones(len(rows), bool))
    return Model(weights, bias, slope, offset)

def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = SAMPLE) -> Model:
    """Learn from a bounded sample of `labels` (doc_id, quality) whose ids are not held out and that `docs` has.

    A label other than 0 and 1 is no label; of several for one id the smallest counts. Tasks turn the sampled
    texts into indicators; only these, bounded by the sample and the number of buckets, reach the driver.
    """
    own = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    both = own.filter(~held_out(F.col("doc_id"))).join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["count"] for r in both.groupBy("label").count().collect()}  # two rows
    sample = labelled_sample(both, per_label, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [indicators(raw_bytes(t), BITS).astype(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "at": made})

    rows = sampled_texts(docs, sample).mapInPandas(
        run, "label int, at array<int>").toPandas()
    made = sorted(((int(r.label), np.asarray(r.at)) for r in rows.itertuples()), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return train(made, counts.get(1, 0) / max(1, sum(counts.values())))

def rate(docs: DataFrame, model: Model, passed: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted; only the text is looked at.

    Null counts as an empty text, which gets the score of having no n-gram. A null id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            scores = np.array([own.score(t) for t in batch["text"]], np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores,
                                "predicted": (scores >= 0.5).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

def drop_poor(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without the rows that are predicted 0; all columns are passed on."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        own = sent.value
        return pd.Series([own.score(t) >= 0.5 for t in texts], dtype=bool)

    return docs.filter(good("text"))
