"""Quality scores by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import require, text_or_empty
from lumenfold.llm.tokens import small_batches

THRESHOLD = 0.3
MOST_LABELLED = 6000  # documented bound of the rows the model is fitted on
MOST_PASSAGES = 64  # a document has so many passages at most; longer documents get longer ones
PASSAGE_WORDS = 120
HIDDEN, ATTENTION, EPOCHS, BATCH, SEED = 24, 12, 40, 128, 7


def _byte_classes() -> np.ndarray:
    """The class of each byte: each ASCII punctuation mark its own, letters, digits, blanks, line feeds and others by kind."""
    out = np.zeros(256, dtype=np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[[ord(" ")]], out[[9, 10, 11, 12, 13]] = 1, 2
    out[np.arange(ord("a"), ord("z") + 1)], out[np.arange(ord("A"), ord("Z") + 1)] = 3, 4
    out[np.arange(ord("0"), ord("9") + 1)] = 5
    out[128:192], out[192:] = 6, 7
    out[marks] = 8 + np.arange(len(marks))
    return out


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
FEATURES = _CLASSES + 8


def passages(text: str | None) -> np.ndarray:
    """One row of FEATURES numbers a passage; an empty text has one passage of zeros.

    A passage has PASSAGE_WORDS words in a row, or a 64th of a long document. Its
    encoding: the shares of the byte classes, mean and spread of word lengths, share
    of distinct words, of repeats of the word two before, of all-capital words, of
    words without a letter, the log of the word count, and its share of the text.
    """
    words = (text or "").encode().split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    size = max(PASSAGE_WORDS, -(-len(words) // MOST_PASSAGES))
    out = []
    for i in range(0, len(words), size):
        part = words[i : i + size]
        n = len(part)
        joined = b" ".join(part)
        shares = np.bincount(_CLASS[np.frombuffer(joined, dtype=np.uint8)], minlength=_CLASSES) / len(joined)
        lengths = np.fromiter(map(len, part), dtype=np.float64, count=n)
        extra = [
            min(lengths.mean(), 40) / 10,
            min(lengths.std(), 40) / 10,
            len(set(part)) / n,
            sum(a == b for a, b in zip(part, part[2:], strict=False)) / n,
            sum(map(bytes.isupper, part)) / n,
            1 - sum(w[:1].isalpha() or w[0] > 127 for w in part) / n,
            np.log1p(n) / 5,
            n / len(words),
        ]
        out.append(np.concatenate([shares * 4, extra]))
    return np.array(out, dtype=np.float32)


@dataclass
class GatedAttentionModel:
    """Passage encoder, gated attention over passages, and a logistic head."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    head: np.ndarray

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        h = np.hstack([np.tanh(z @ self.encode), np.ones((len(x), 1))])
        t, g = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-(h @ self.gate)))
        a = (t * g) @ self.attend
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        pooled = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.head, -30, 30)))
        return bag, z, h, t, g, a, pooled, p

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        return self._forward(np.concatenate(bags), starts)[-1]


def fit(bags: list[np.ndarray], labels: np.ndarray) -> GatedAttentionModel | None:
    """Fits the model by Adam; None if there aren't two classes to tell apart."""
    if len(set(labels.tolist())) < 2:
        return None
    rng, every = np.random.default_rng(SEED), np.concatenate(bags)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    model = GatedAttentionModel(every.mean(0), every.std(0) + 0.05, draw(FEATURES + 1, HIDDEN), draw(HIDDEN + 1, ATTENTION), draw(HIDDEN + 1, ATTENTION), draw(ATTENTION), np.zeros(HIDDEN + 1))
    names = ("encode", "tanh", "gate", "attend", "head")
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            chosen = [bags[k] for k in order[i : i + BATCH]]
            y = labels[order[i : i + BATCH]]
            starts = np.concatenate([[0], np.cumsum([len(b) for b in chosen])[:-1]]).astype(np.int64)
            bag, z, h, t, g, a, pooled, p = model._forward(np.concatenate(chosen), starts)
            d = (p - y) / len(y)
            d_pooled = d[:, None] * model.head
            d_a = (d_pooled[bag] * h).sum(1)
            d_logit = a * (d_a - np.add.reduceat(a * d_a, starts)[bag])
            d_tg = d_logit[:, None] * model.attend
            d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
            d_h = a[:, None] * d_pooled[bag] + d_t @ model.tanh.T + d_g @ model.gate.T
            d_z = d_h[:, :-1] * (1 - h[:, :-1] ** 2)
            grads = {"encode": z.T @ d_z, "tanh": h.T @ d_t, "gate": h.T @ d_g, "attend": (t * g).T @ d_logit, "head": pooled.T @ d}
            step += 1
            for n in names:
                w = getattr(model, n)
                grad = grads[n] + 1e-4 * w
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad * grad
                w -= 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> GatedAttentionModel | None:
    """Fits on at most ``most`` labelled documents that aren't held out.

    The sample is the ids with the least hash, so it doesn't depend on the order of
    the rows; null labels and ids are left out and labels that disagree are averaged.
    The driver gets the sample's passage features: at most ``most`` x MOST_PASSAGES
    rows of FEATURES floats, whatever the size of the input.
    """
    require(labels, doc_id, label)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    # The sample has at most ``most`` small rows and is broadcast.
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            data = [passages(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(data, pa.binary())], names=["doc_id", "y", "x"])

    rows = joined.mapInArrow(encode, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    bags = [np.frombuffer(x, dtype="<f4").reshape(-1, FEATURES) for x in rows.column("x").to_pylist()]
    return fit(bags, np.array(rows.column("y").to_pylist(), dtype=np.float64)) if bags else None


def score(docs: DataFrame, model: GatedAttentionModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted, passages.

    Null and empty texts are scored as one passage of zeros. Without a model (no
    labels, or of one class only) the score is 0.5 and every document stays.
    """
    require(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            bags = [passages(t) for t in batch.column("text").to_pylist()]
            found = model.scores(bags) if model is not None and bags else np.full(len(bags), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array([len(b) for b in bags], pa.int32())], names=["doc_id", "score", "passages"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double, passages int")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects, all columns as they are.

    The text's score is a column on the row itself, so nothing is shuffled. Rows
    with the same text share their fate; null texts count as empty.
    """
    model = train(docs, labels, doc_id=doc_id, text=text)
    if model is None:
        return docs
    rule = score_column(model)
    return docs.where(rule(text_or_empty(text)) >= THRESHOLD)


def score_column(model: GatedAttentionModel):
    @F.pandas_udf("double")
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([passages(t) for t in texts]) if len(texts) else [], dtype="float64")

    return quality_score
