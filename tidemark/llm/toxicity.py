"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over words and word stems, all of them, hashed; each
model also takes the probabilities of all earlier categories. In training these are out-of-fold predictions, so that a
model learns how far to trust its forerunners on unseen documents. A term counts as much as the log-ratio of its
frequencies in either class, taken on the rows that a model is fitted on: never on those that it is held out from.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import chunked, durable, owners, word_codes, words

#: Labelled documents that the models are fitted on, at most: those of least hash of doc_id.
SAMPLE = 12_000
FOLDS = 5
#: The chain: a category's name, and its label as an expression over the labels table. The last one is the verdict.
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}
#: Hashed terms; the last number stands for no term.
TERMS = 1 << 18
_STEMS = (4, 6)
_PENALTY, _PRIOR, _STEPS = 1e-3, 0.5, 60
#: Words whose terms a worker remembers at most; then it starts anew. Bounds its memory only.
_REMEMBERED = 300_000
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


class Terms:
    """Numbers of each word and its stems, lower-cased and without punctuation around."""

    def __init__(self) -> None:
        self.met: dict[str, tuple[int, ...]] = {}

    def _cut(self, word: str) -> tuple[int, ...]:
        w = word.lower().strip(_PUNCTUATION)
        if not w:
            return (TERMS - 1,) * (1 + len(_STEMS))
        own = xxhash.xxh64_intdigest("=" + w) % (TERMS - 1)
        return (own, *(xxhash.xxh64_intdigest("^" + w[:n]) % (TERMS - 1) if len(w) > n else TERMS - 1 for n in _STEMS))

    def of(self, distinct: list[str]) -> np.ndarray:
        if len(self.met) > _REMEMBERED:
            self.met.clear()
        for w in distinct:
            if w not in self.met:
                self.met[w] = self._cut(w)
        return np.array([self.met[w] for w in distinct], np.int64).reshape(-1, 1 + len(_STEMS))


def text_terms(texts: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every distinct term of each text."""
    offsets, values = words(texts)
    codes, distinct = word_codes(values)
    pair = np.unique((owners(offsets) << 32) | codes)
    flat = ((pair >> 32)[:, None] * TERMS + terms.of(distinct)[pair & 0xFFFFFFFF]).ravel()
    flat = np.unique(flat[flat % TERMS != TERMS - 1])
    return flat // TERMS, flat % TERMS


def minimum(value, start: np.ndarray, steps: int = _STEPS) -> np.ndarray:
    """Where a smooth function (value(w) gives it and its gradient) is least: L-BFGS with halved steps."""
    past: deque = deque(maxlen=8)
    w, (f, g) = start, value(start)
    for _ in range(steps):
        step, factors = g.copy(), []
        for s, y, r in reversed(past):
            factors.append(r * s.dot(step))
            step -= factors[-1] * y
        if past:
            s, y, _ = past[-1]
            step *= s.dot(y) / y.dot(y)
        for (s, y, r), a in zip(past, reversed(factors)):
            step += s * (a - r * y.dot(step))
        t = 1.0
        new, slope = value(w - step), g.dot(step)
        while new[0] > f - 1e-4 * t * slope and t > 1e-6:
            t /= 2
            new = value(w - t * step)
        s, y = -t * step, new[1] - g
        done = abs(f - new[0]) < 1e-6
        w, (f, g) = w + s, new
        if done:
            break
        if s.dot(y) > 1e-12:
            past.append((s, y, 1 / s.dot(y)))
    return w


def _logistic(text: np.ndarray, term: np.ndarray, n_terms: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of the terms, the dense columns and the intercept, fitted on the rows in use.

    (text, term) are the places of the ones among the terms: the design matrix is never laid out.
    """
    count, ones = int(use.sum()), float(y[use].sum())
    out = np.zeros(n_terms + dense.shape[1] + 1)
    if not 0 < ones < count:
        out[-1] = 30.0 if ones else -30.0
        return out
    toxic = np.bincount(term, weights=(y * use)[text], minlength=n_terms)
    clean = np.bincount(term, weights=((1 - y) * use)[text], minlength=n_terms)
    scale = np.log((toxic + _PRIOR) / (ones + 1)) - np.log((clean + _PRIOR) / (count - ones + 1))
    scale[toxic + clean == 0] = 0.0

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        logit = np.bincount(text, weights=(scale * w[:n_terms])[term], minlength=len(y)) + dense @ w[n_terms:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        off = np.where(use, p - y, 0.0) / count
        loss = -np.where(use, y * np.log(p + 1e-15) + (1 - y) * np.log(1 - p + 1e-15), 0.0).sum() / count
        g = np.r_[scale * np.bincount(term, weights=off[text], minlength=n_terms), dense.T @ off, off.sum()]
        g[:-1] += _PENALTY * w[:-1]
        return loss + _PENALTY / 2 * float(w[:-1] @ w[:-1]), g

    start = out.copy()
    start[-1] = np.log(ones / (count - ones))
    out = minimum(value, start)
    out[:n_terms] *= scale
    return out


def fit_chain(text: np.ndarray, term: np.ndarray, n_terms: int, targets: list[np.ndarray], fold: np.ndarray) -> list[np.ndarray]:
    """A model for each category: weights of the terms, of the earlier categories' probabilities, and the intercept."""
    models, earlier = [], np.zeros((len(fold), 0))
    for y in targets:
        models.append(_logistic(text, term, n_terms, earlier, y, np.ones(len(fold), bool)))
        held_out = np.zeros(len(fold))
        for f in range(FOLDS if y is not targets[-1] else 0):
            out = fold == f
            if out.any() and not out.all():
                w = _logistic(text, term, n_terms, earlier, y, ~out)
                logit = np.bincount(text, weights=w[term], minlength=len(fold)) + earlier @ w[n_terms:-1] + w[-1]
                held_out[out] = (1 / (1 + np.exp(-np.clip(logit, -30, 30))))[out]
        earlier = np.c_[earlier, held_out]
    return models


def predict_chain(models: list[np.ndarray], count: int, text: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Probabilities (a column for each category) of `count` texts with the given terms."""
    n_terms = len(models[0]) - 1 if models else 0
    out = np.zeros((count, len(models)))
    for k, w in enumerate(models):
        logit = np.bincount(text, weights=w[term], minlength=count) + w[-1]
        logit += out[:, :k] @ w[n_terms : n_terms + k]
        out[:, k] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        for piece in chunked(batch, "text"):
            text, term = text_terms(piece.column("text"), terms)
            edges = np.searchsorted(text, np.arange(piece.num_rows + 1))
            blobs = [term[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("labels"), pa.array(blobs, pa.binary())], names=["doc_id", "labels", "terms"])


def sample_of(labels: DataFrame, columns: list, sample: int) -> DataFrame:
    """(doc_id, labels) of at most `sample` documents, those of least hash of doc_id; of several labels the highest holds, NULLs are left out."""
    cast = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    best = cast.groupBy("doc_id").agg(F.array(*[F.max(f"c{i}") for i in range(len(columns))]).alias("labels"))
    return best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def sampled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, labels, text): one row for each chosen document that there is, whatever the number of its rows."""
    # At most `sample` rows of a few numbers: the size of what is broadcast is bounded.
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("labels").alias("labels"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> list[np.ndarray]:
    """The models, from at most `sample` labelled documents: the driver gets which terms each of them holds."""
    chosen = sample_of(labels, [F.expr(c) for c in categories.values()], sample)
    found = durable(sampled(docs, chosen)).mapInArrow(_gather, "doc_id long, labels array<int>, terms binary").toArrow().sort_by("doc_id")
    blobs = found["terms"].to_pylist()
    term = np.frombuffer(b"".join(blobs), np.int32)
    text = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b) // 4 for b in blobs])
    y = np.array(found["labels"].to_pylist(), float).reshape(len(blobs), len(categories))
    fold = np.array([xxhash.xxh64_intdigest(str(d)) % FOLDS for d in found["doc_id"].to_pylist()], int)
    return fit_chain(text, term, TERMS, list(y.T), fold)


def _predict(models: list[np.ndarray], names: list[str]):
    models = [m.astype(np.float32) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for piece in chunked(batch, "text"):
                text, term = text_terms(piece.column("text"), terms)
                p = predict_chain(models, piece.num_rows, text, term)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *names])

    return run


def toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", categories: dict[str, str] | None = None
) -> DataFrame:
    """Category probabilities of every document and the verdict: (doc_id, poor, toxic, is_toxic), one row each.

    labels has doc_id and what categories refer to: a chain of names and 0/1 labels as expressions over it. The labels at hand tell
    poor quality and toxicity, so these two are the links; is_toxic is the last one's probability against the threshold. sample bounds the labelled
    documents that the models are fitted on; every document is scored.

    Labels that are all alike or missing: every document gets that label, or none. Rows with a NULL label are left out; of
    several labels of a document the highest holds; of several texts of a labelled doc_id the least is learnt from. NULL, empty and blank
    texts: no terms, so the intercept alone. NULL doc_id: scored like any other. Repeated rows: one result row each. Very long texts are scored whole. Empty
    tables: no rows. Other columns are ignored, whatever their names.
    """
    chain = CATEGORIES if categories is None else categories
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    models = fit(rows, labels, chain, sample)
    scored = rows.mapInArrow(_predict(models, list(chain)), "doc_id long, " + ", ".join(f"{c} double" for c in chain))
    return scored.withColumn("is_toxic", F.col(list(chain)[-1]) >= threshold)
