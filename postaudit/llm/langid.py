"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postaudit.llm.features import held_out, labelled_sample, pieces, raw_bytes, sampled_texts, subwords

BITS, DIM = 14, 16
PER_LANGUAGE, SAMPLE = 500, 8000
"""The classifier learns from this many rows of a language, and of all, at most."""
EPOCHS, BATCH, RATE = 10, 16, 12.0
PRECISION = 0.99
"""Accepted predictions are right this often on the calibration part."""
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: the embeddings times the output layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum(axis=-1, keepdims=True)
        return counts @ self.table / np.maximum(total, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is too low to be accepted."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        shares = softmax(self.logits(bucket_counts(text)) / self.temperature)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best]), bool(shares[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bucket_counts(text: str) -> np.ndarray:
    total = np.zeros(1 << BITS)
    for part in pieces(raw_bytes(text)):
        total += np.bincount(subwords(part, BITS), minlength=1 << BITS)
    return total


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """Stochastic gradient descent over (language, buckets, counts); every fifth row calibrates and is not learnt from.

    The softmax's temperature is the one of least log loss on the calibration rows; the threshold is the lowest
    at which accepted predictions reach PRECISION there.
    """
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    kept = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 20]
    checked = [r for i, r in enumerate(rows) if not i % 5] if len(rows) >= 20 else rows
    embed = rng.normal(0, 1 / np.sqrt(DIM), (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    place = {lang: i for i, lang in enumerate(languages)}
    steps, step = EPOCHS * max(1, -(-len(kept) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(kept))
        for at in range(0, len(kept), BATCH):
            batch = [kept[i] for i in order[at:at + BATCH]]
            used = np.unique(np.concatenate([b for _, b, _ in batch]))
            x = np.zeros((len(batch), len(used)), np.float32)
            for i, (_, buckets, counts) in enumerate(batch):
                x[i, np.searchsorted(used, buckets)] = counts / max(1, counts.sum())
            mean = x @ embed[used]
            error = softmax(mean @ out + bias)
            error[np.arange(len(batch)), [place[r[0]] for r in batch]] -= 1
            rate = RATE * (1 - step / steps) / len(batch)
            back = error @ out.T
            out -= rate * mean.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            embed[used] -= rate * (x.T @ back)
            step += 1
    model = Model(languages, (embed @ out).astype(np.float64), bias.astype(np.float64))
    scores = np.array([b_counts @ model.table[b] / max(1, b_counts.sum()) + model.bias for _, b, b_counts in checked])
    truth = np.array([place[r[0]] for r in checked])
    soft = np.full(scores.shape, 0.01 / len(languages))  # so that separable languages still have a finite best
    soft[np.arange(len(truth)), truth] += 0.99
    losses = {t: -(soft * np.log(np.maximum(softmax(scores / t), 1e-12))).sum(axis=1).mean() for t in np.geomspace(0.02, 5, 41)}
    model.temperature = float(min(losses, key=losses.get))
    shares = softmax(scores / model.temperature)
    best, right = shares.max(axis=1), shares.argmax(axis=1) == truth
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    model.threshold = float(best[order][good[-1]]) if len(good) else 1.0
    if len(good) == len(order):  # nothing had to be rejected there: halfway to even odds stays acceptable
        model.threshold = min(model.threshold, (1 + 1 / len(languages)) / 2)
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> Model:
    """Learn from a bounded sample of `docs` (doc_id, text, lang): ids not held out, lang and text not null.

    Tasks turn the sampled texts into bucket counts; only these, bounded by the sample and the number of buckets,
    reach the driver.
    """
    sample = labelled_sample(docs.filter("text IS NOT NULL").select("doc_id", F.col("lang").alias("label")), per_language, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for label, text in zip(batch["label"], batch["text"]):
                counts = bucket_counts(text)
                used = np.flatnonzero(counts)
                made.append((label, used.astype(np.int32), counts[used].astype(np.float32)))
            yield pd.DataFrame(made, columns=["label", "buckets", "counts"])

    rows = sampled_texts(docs, sample).mapInPandas(
        run, "label string, buckets array<int>, counts array<float>").toPandas()
    made = [(r.label, np.asarray(r.buckets), np.asarray(r.counts)) for r in rows.itertuples() if len(r.buckets)]
    # Tasks return rows in no fixed order.
    return train(sorted(made, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def identify(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, rejected; only the text is looked at.

    A null text or one without a letter is `und` with score 0 and rejected; so is every text if nothing was
    learnt. With `reject`, predictions below the threshold are `und` too. A null id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            found = [own.predict(t) for t in batch["text"]]
            langs = [UNKNOWN if bad and reject else lang for lang, _, bad in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": langs,
                                "score": [s for _, s, _ in found], "rejected": [b for _, _, b in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
