"""Quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees are boosted in cycles, each on one feature's bins, so
that every feature ends up with a lookup table; then the pairs of features that explain most of what is left get
tables of their own the same way. A document's score is the sum of its bins' entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import chunked, owners, word_codes, words
from tidemark.llm.toxicity import sample_of, sampled

#: Labelled documents that the model is fitted on, at most: those of least hash of doc_id.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
CYCLES, PAIR_CYCLES, RATE = 150, 60, 0.15
FEATURES = (
    "log_words", "word_length", "letters", "capitals", "digits", "symbols", "distinct_words", "top_word", "adjacent_repeats",
    "marked_words", "bars", "lines", "repeated_lines", "short_words", "stops", "long_words",
)

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 plain punctuation, 5 symbol, 0 white space
_KIND[33:127] = 5
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all 0 for a text without words."""
    texts = pc.fill_null(texts, "")
    offsets, values = words(texts)
    codes, distinct = word_codes(values)
    count, n = len(texts), np.diff(offsets).astype(float)
    text = owners(offsets)
    per = lambda w: np.bincount(text, weights=w, minlength=count)
    safe = np.maximum(n, 1)
    length = np.fromiter(map(len, distinct), float, len(distinct))
    marked = np.fromiter((not w[-1].isalnum() and w[-1] not in ".,;:" for w in distinct), float, len(distinct))
    stops = np.fromiter((w[-1] in ".!?" for w in distinct), float, len(distinct))
    # Bytes of each kind.
    raw = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.LargeStringArray) else texts
    raw = pa.concat_arrays([raw])
    edge = np.frombuffer(raw.buffers()[1], np.int64, count + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    kind = _KIND[data]
    owner = np.repeat(np.arange(count), np.diff(edge))
    kinds = np.bincount(owner * 6 + kind, minlength=count * 6).reshape(count, 6).astype(float)
    ink = np.maximum(kinds[:, 1:].sum(axis=1), 1)
    bars = np.bincount(owner, weights=data == ord("|"), minlength=count)
    # Words by count.
    pair = np.sort((text << 32) | codes)
    heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, int)
    times = np.diff(np.r_[heads, len(pair)]).astype(float)
    of = (pair[heads] >> 32).astype(int)
    top = np.zeros(count)
    np.maximum.at(top, of, times)
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    lists = pc.split_pattern(texts, "\n")
    lines = np.diff(lists.offsets.to_numpy()).astype(float)
    line_text = np.repeat(np.arange(count), lines.astype(int))
    line = pc.dictionary_encode(lists.values).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_count = np.bincount(np.unique((line_text.astype(np.int64) << 32) | line) >> 32, minlength=count)
    out = np.stack(
        [
            np.log1p(n), per(length[codes]) / safe, (kinds[:, 1] + kinds[:, 2]) / ink, kinds[:, 2] / ink, kinds[:, 3] / ink, kinds[:, 5] / ink,
            np.bincount(of, minlength=count) / safe, top / safe, per(again) / safe, per(marked[codes]) / safe, bars / safe,
            lines / safe, 1 - line_count / np.maximum(lines, 1), per(length[codes] <= 3) / safe, per(stops[codes]) / safe, per(length[codes] > 20) / safe,
        ],
        axis=1,
    )
    out[n == 0] = 0
    return out


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most `bins` bins of about equal counts."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best place to cut bins in two, and its gain."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
    if not len(gain):
        return 0, 0.0
    k = int(np.argmax(gain))
    return k + 1, float(gain[k])


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of a shallow tree over bins with gradients g and weights h."""
    at, gain = _split(g, h) if depth else (0, 0.0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.r_[tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)]


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The step of a tree that cuts one feature of a pair, then the other on either side; and its gain."""
    best = (np.zeros(g.shape), 0.0)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        at, gain = _split(a.sum(axis=1), b.sum(axis=1))
        step, total = np.zeros(a.shape), gain
        for rows in (slice(0, at), slice(at, len(a))):
            x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
            cut, more = _split(x, y)
            total += more
            step[rows, :cut] = _leaf(x[:cut].sum(), y[:cut].sum()) if cut else 0
            step[rows, cut:] = _leaf(x[cut:].sum(), y[cut:].sum())
        if total > best[1]:
            best = (step.T if flip else step, total)
    return best


class Model:
    """Tables of all features and pairs."""

    def __init__(self, intercept: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple], pair_edges: list[np.ndarray]):
        self.intercept, self.edges, self.tables, self.pairs, self.pair_edges = intercept, edges, tables, pairs, pair_edges

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: additions of looked-up entries."""
        out = np.full(len(x), self.intercept)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, j], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out


def fit_model(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the logistic loss: features first, then the pairs of most gain."""
    edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    model = Model(float(np.log(share / (1 - share))), edges, tables, [], pair_edges)
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    paired = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    score = model.score(x)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j, table in enumerate(tables):
            g, h = gradients()
            step = RATE * tree(np.bincount(binned[j], g, len(table)), np.bincount(binned[j], h, len(table)))
            table += step
            score += step[binned[j]]
    g, h = gradients()

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        cell = paired[i] * shape[1] + paired[j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((-pair_tree(*grids(i, j))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain < 0]
    for _ in range(PAIR_CYCLES):
        for i, j, table in model.pairs:
            g, h = gradients()
            step = RATE * pair_tree(*grids(i, j))[0]
            table += step
            score += step[paired[i], paired[j]]
    return model


_COLUMNS = [f"x{i}" for i in range(len(FEATURES))]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunked(batch, "text"):
            x = features(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", "label", *_COLUMNS])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled documents."""
    chosen = sample_of(labels, [F.col("quality")], sample)
    found = sampled(docs, chosen).select("doc_id", F.col("labels")[0].alias("label"), "text")
    rows = found.mapInArrow(_gather, "doc_id long, label int, " + ", ".join(f"{c} double" for c in _COLUMNS)).toPandas().sort_values("doc_id")
    return fit_model(rows[_COLUMNS].to_numpy(), rows["label"].to_numpy(float))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunked(batch, "text"):
                score = model.score(features(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every document: (doc_id, score, probability, keep), one row each.

    labels has (doc_id, quality). score is in log-odds; keep says whether the probability of good quality reaches
    the threshold. sample bounds the labelled documents that the model is fitted on; every document is scored.

    Labels that are all alike or missing: every document gets the base rate. NULL labels are left out; of several
    labels of a document the highest holds; of several texts of a labelled doc_id the least is learnt from. NULL, empty and blank texts: all features 0. NULL doc_id: scored like any other.
    Repeated rows: one result row each. Very long texts are scored whole. Empty tables: no rows. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(rows, labels, sample)
    scored = rows.mapInArrow(_predict(model), "doc_id long, score double")
    p = 1 / (1 + F.exp(-F.col("score")))
    return scored.withColumn("probability", p).withColumn("keep", F.col("probability") >= threshold)
