"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the two tokens before it and the two behind it, never from itself: their embeddings
(one table for each place) add up to a hidden layer, which predicts the token's class and then the token
within its class. The vocabulary comes from the words' counts over the whole corpus and grows with it: frequent words have codes of
their own, in order of frequency, rare ones share the last codes. Training runs over all tokens of all documents: in each round every partition makes
stochastic gradient steps of its own from the common weights (numpy), and the results are averaged, weighted by targets. A document's score
is the sum of its tokens' conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import U64, chunked, durable, word_hashes

MEMBERS, HIDDEN = 64, 31
PLACES = (-2, -1, 1, 2)
ROUNDS = 2
#: Cells of the table in which words are counted; its size doesn't depend on the corpus.
CELLS = 1 << 18
#: The vocabulary has this many codes for the cube root of the corpus' tokens; one code in SHARED is for rare words.
GROWTH, SHARED = 9, 8
_BATCH = 8192
#: Rows whose class logits are computed at a time, so that they stay in a core's cache however many classes there are.
_ROWS = 1024
_SLICES = 16


def classes(tokens: int) -> int:
    """Classes of MEMBERS codes each for a corpus of so many tokens."""
    return max(2, round(GROWTH * tokens ** (1 / 3) / MEMBERS))


def vocabulary(counts: np.ndarray) -> np.ndarray:
    """The code of each cell: the fullest cells have their own, by falling count, the others share the last ones."""
    size = classes(int(counts.sum())) * MEMBERS
    own = min(size - size // SHARED, int((counts > 0).sum()))
    codes = own + np.arange(CELLS) % (size - own)
    codes[np.lexsort((np.arange(CELLS), -counts))[:own]] = np.arange(own)
    return codes.astype(np.int32)


def shapes(n_classes: int) -> dict[str, tuple]:
    return {
        "embed": (len(PLACES), n_classes * MEMBERS + 1, HIDDEN),
        "bias": (HIDDEN,),
        "to_class": (HIDDEN + 1, n_classes),
        "to_member": (n_classes, HIDDEN + 1, MEMBERS),
    }


def new_model(n_classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {k: np.zeros(s, np.float32) for k, s in shapes(n_classes).items()}
    model["embed"][:] = rng.normal(0, 0.1, model["embed"].shape)
    return model


def flatten(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in model.values()])


def unflatten(flat: np.ndarray, n_classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(n_classes).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and the cell of every token."""
    offsets, hashes = word_hashes(texts)
    return offsets, (hashes % U64(CELLS)).astype(np.int32)


def contexts(offsets: np.ndarray, tokens: np.ndarray, outside: int) -> np.ndarray:
    """The tokens around each (`outside` beyond the text)."""
    count = np.diff(offsets)
    start, end = np.repeat(offsets[:-1], count), np.repeat(offsets[1:], count)
    at = np.arange(len(tokens))
    around = np.full((len(PLACES), len(tokens)), outside, np.int64)
    for j, p in enumerate(PLACES):
        ok = (at + p >= start) & (at + p < end)
        around[j, ok] = tokens[at[ok] + p]
    return around


def _hidden(model: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    """The hidden layer with a constant 1 behind it."""
    h = np.empty((around.shape[1], HIDDEN + 1), np.float32)
    total = model["embed"][0][around[0]]
    for j in range(1, len(PLACES)):
        total += model["embed"][j][around[j]]
    np.tanh(total + model["bias"], out=h[:, :HIDDEN])
    h[:, HIDDEN] = 1
    return h


def _order(codes: np.ndarray) -> np.ndarray:
    """Stable order of codes; numpy sorts short integers by radix."""
    return np.argsort(codes.astype(np.uint16) if len(codes) and codes.max() < 1 << 16 else codes, kind="stable")


def _summed(rows: np.ndarray, heads: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows that begin at heads; most are of one row, which is taken as it is."""
    sums, many = rows[heads], np.flatnonzero(times > 1)
    if len(many):
        inner = np.repeat(times > 1, times)
        sums[many] = np.add.reduceat(rows[inner], np.r_[0, np.cumsum(times[many])[:-1]], axis=0)
    return sums


def _log_norm(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    return top[:, 0] + np.log(np.exp(logits).sum(axis=1))


def log_probabilities(model: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Log-probability of each token given those around it."""
    out = np.empty(len(tokens), np.float64)
    for a in range(0, len(tokens), step):
        t = tokens[a : a + step]
        order = _order(t // MEMBERS)
        t = t[order]
        h = _hidden(model, around[:, a : a + step][:, order])
        group, member = t // MEMBERS, t % MEMBERS
        row = np.arange(len(t))
        score = np.empty(len(t), np.float32)
        for x in range(0, len(t), _ROWS):
            logits = h[x : x + _ROWS] @ model["to_class"]
            score[x : x + _ROWS] = logits[row[: len(logits)], group[x : x + _ROWS]]
            score[x : x + _ROWS] -= _log_norm(logits)
        edges = np.searchsorted(group, np.arange(len(model["to_member"]) + 1))
        for c in np.flatnonzero(np.diff(edges)):
            x, y = edges[c], edges[c + 1]
            inner = h[x:y] @ model["to_member"][c]
            picked = inner[row[: y - x], member[x:y]].copy()
            score[x:y] += picked - _log_norm(inner)
        out[a + order] = score
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place; logits beyond 60 don't occur unless training has gone astray."""
    np.maximum(logits, np.float32(-60), out=logits)
    np.minimum(logits, np.float32(60), out=logits)
    np.exp(logits, out=logits)
    logits /= np.add.reduce(logits, axis=1, keepdims=True)
    return logits


def train_step(model: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One gradient step on the mean negative log-probability of a batch sorted by class, in place."""
    n, n_classes = len(tokens), len(model["to_member"])
    h = _hidden(model, around)
    group, member = tokens // MEMBERS, tokens % MEMBERS
    back, to_class = np.empty_like(h), np.zeros_like(model["to_class"])
    for x in range(0, n, _ROWS):
        some = h[x : x + _ROWS]
        p = _softmax(some @ model["to_class"])
        p[np.arange(len(some)), group[x : x + _ROWS]] -= 1
        back[x : x + _ROWS] = p @ model["to_class"].T
        to_class += some.T @ p
    edges = np.searchsorted(group, np.arange(n_classes + 1))
    for c in np.flatnonzero(np.diff(edges)):
        x, y = edges[c], edges[c + 1]
        w = model["to_member"][c]
        q = _softmax(h[x:y] @ w)
        q[np.arange(y - x), member[x:y]] -= 1
        back[x:y] += q @ w.T
        w -= rate / (n * (y - x)) ** 0.5 * (h[x:y].T @ q)  # small classes get longer steps
    model["to_class"] -= rate / n * to_class
    inner = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
    model["bias"] -= rate / n * inner.sum(axis=0)
    for j in range(len(PLACES)):
        order = _order(around[j])
        ids = around[j][order]
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        times = np.diff(np.r_[heads, n])
        sums = _summed(inner[order], heads, times)
        sums *= (rate / np.sqrt(times * n)).astype(np.float32)[:, None]  # rare tokens get longer steps
        model["embed"][j][ids[heads]] -= sums


def train(model: dict[str, np.ndarray], batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 2.0) -> int:
    """Gradient steps over (tokens, around) in order, in place; returns the number of targets."""
    seen = 0
    for tokens, around in batches:
        for a in range(0, len(tokens), _BATCH):
            t, x = tokens[a : a + _BATCH], around[:, a : a + _BATCH]
            order = _order(t)
            train_step(model, t[order], x[:, order], rate * min(1.0, len(t) / _BATCH))
        seen += len(tokens)
    return seen


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each document's tokens; a task's counts, in slices, come last with kind 1."""
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        for piece in chunked(batch, "text"):
            offsets, found = cells(piece.column("text"))
            seen += np.bincount(found, minlength=CELLS)
            blobs = [found[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(piece.num_rows, np.int32)), piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(blobs, pa.binary())], names=["kind", "doc_id", "n_tokens", "cells"]
            )
    parts = seen.reshape(_SLICES, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(_SLICES, np.int32)), pa.array(range(_SLICES), pa.int64()), pa.array(parts.sum(axis=1)), pa.array([x.tobytes() for x in parts], pa.binary())],
        names=["kind", "doc_id", "n_tokens", "cells"],
    )


def _count(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.int64) for b in table["cells"].to_pylist()], axis=0)
    return pa.table({"doc_id": table["doc_id"][:1], "cells": pa.array([total.tobytes()], pa.binary())})


def encoded(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_tokens, cells) of all documents in the shared folder, so that texts are cut once; and the words' counts by cell."""
    table = durable(docs.mapInArrow(_encode, "kind int, doc_id long, n_tokens long, cells binary"))
    counts = table.filter("kind = 1").select("doc_id", "cells", F.pmod(F.xxhash64("cells"), F.lit(64)).alias("salt"))
    added = counts.groupBy("doc_id", "salt").applyInArrow(lambda t: _count(t.select(["doc_id", "cells"])), "doc_id long, cells binary")
    slices = sorted(added.groupBy("doc_id").applyInArrow(_count, "doc_id long, cells binary").collect(), key=lambda r: r["doc_id"])
    return table.filter("kind = 0").drop("kind"), np.concatenate([np.frombuffer(r["cells"], np.int64) for r in slices] or [np.zeros(CELLS, np.int64)])


def _pieces(batches: Iterator[pa.RecordBatch], codes: np.ndarray, outside: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' offsets, tokens and the tokens around."""
    for batch in batches:
        for piece in chunked(batch, "cells", 1 << 21):
            offsets = np.r_[0, np.cumsum(piece.column("n_tokens").to_numpy())]
            tokens = codes[np.frombuffer(b"".join(piece.column("cells").to_pylist()), np.int32)].astype(np.int64)
            yield piece, offsets, tokens, contexts(offsets, tokens, outside)


def _train_partition(flat: np.ndarray, codes: np.ndarray, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unflatten(flat, n_classes)

        def targets():
            for _, _, tokens, around in _pieces(batches, codes, n_classes * MEMBERS):
                mixed = np.random.default_rng(len(tokens)).permutation(len(tokens))
                yield tokens[mixed], around[:, mixed]

        seen = train(model, targets())
        if seen:
            weighted = flatten(model).astype(np.float64) * seen
            parts = np.array_split(weighted.astype(np.float32), _SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_SLICES), pa.int32()), pa.array([seen] * _SLICES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([int(seen) % 64] * _SLICES, pa.int32())],
                names=["slice", "seen", "weights", "salt"],
            )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.float32) for b in table["weights"].to_pylist()], axis=0, dtype=np.float64)
    return pa.table(
        {
            "slice": pa.array([table["slice"][0].as_py()], pa.int32()),
            "seen": pa.array([sum(table["seen"].to_pylist())], pa.int64()),
            "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def fit(table: DataFrame, codes: np.ndarray, n_classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights trained on (doc_id, n_tokens, cells): each round takes its share of the documents, all rounds take all."""
    flat = flatten(new_model(n_classes))
    keyed = table.select("n_tokens", "cells", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(rounds)).alias("round"))
    out = "slice int, seen long, weights binary"
    for r in range(rounds):
        trained = keyed.filter(F.col("round") == r).drop("round").mapInArrow(_train_partition(flat, codes, n_classes), out + ", salt int")
        summed = trained.groupBy("slice", "salt").applyInArrow(_add, out).groupBy("slice").applyInArrow(_add, out).collect()
        if summed:
            flat = np.concatenate([np.frombuffer(s["weights"], np.float32) / s["seen"] for s in sorted(summed, key=lambda s: s["slice"])])
    return flat


def _score(flat: np.ndarray, codes: np.ndarray, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unflatten(flat, n_classes)
        for piece, offsets, tokens, around in _pieces(batches, codes, n_classes * MEMBERS):
            total = np.r_[0.0, np.cumsum(log_probabilities(model, tokens, around))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_tokens"), pa.array(total[offsets[1:]] - total[offsets[:-1]])], names=["doc_id", "n_tokens", "log_prob"])

    return run


def score_documents(docs: DataFrame, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pseudo-likelihood of every document: (doc_id, n_tokens, log_prob, mean_log_prob), one row each.

    Tokens are words split at white space. Every token of every document is a training target, in one of the rounds, and is scored.
    The vocabulary grows with the cube root of the corpus. Weights depend on how the rows are split into partitions, as gradient steps follow their order.

    NULL, empty and blank texts: no tokens, log_prob 0 and mean_log_prob NULL. NULL doc_id: scored like any other.
    Repeated rows: one result row each. Very long texts are scored whole. Empty tables: no rows. Other columns
    are ignored, whatever their names.
    """
    table, counts = encoded(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    codes, n_classes = vocabulary(counts), classes(int(counts.sum()))
    flat = fit(table, codes, n_classes, rounds)
    scored = table.mapInArrow(_score(flat, codes, n_classes), "doc_id long, n_tokens long, log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
