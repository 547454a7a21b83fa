"""Substring dedup by seed and extend.

Seeds are winnowed anchors: in every stretch of `threshold` words the k-gram with the least hash. Documents
meet on their anchors: each occurrence goes to the part of its anchor's hash, with the hashes of all
threshold-long windows around it that it is the anchor of. There every seed is extended to the left and
to the right, a word at a time, as long as the window that holds it recurs in another document, and runs that touch, from one seed or
the next, are joined to maximal repeats. Two documents that share `threshold` words share the anchor of
those words, so nothing is missed. Windows are extended, not pairs of documents, since pairs grow with the square of a passage's
copies: work and output are linear in the occurrences. Windows are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import U64, by_part, chunked, gram_hashes, mix, owners, packed, sliding_min, text_size, word_hashes

#: Windows of one part of the packed shuffle, about.
PART_WINDOWS = 1_000_000
#: Bytes of windows that a task gathers before it sends them off.
FLUSH_BYTES = 16 << 20
#: Low bits of a sort key that hold a word's position in its slice, at least; a longer slice takes as many as it needs.
_POSITION_BITS = 24


def occurrences(texts: pa.Array, ids: np.ndarray, threshold: int, k: int) -> tuple[np.ndarray, ...]:
    """Of a slice of texts: anchor hash, document, first window start and number of windows of each seed; all window hashes."""
    offsets, hashes = word_hashes(texts)
    grams, windows = gram_hashes(hashes, k), gram_hashes(hashes, threshold)
    if not len(windows):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), windows
    text = owners(offsets)[: len(windows)]
    inside = np.arange(len(windows)) + threshold <= offsets[1:][text]
    position = U64((1 << max(_POSITION_BITS, len(grams).bit_length())) - 1)
    keys = (grams & ~position) | np.arange(len(grams)).astype(U64)
    anchor = (sliding_min(keys, threshold - k + 1)[: len(windows)] & position).astype(np.int64)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), windows[:0]
    new = np.r_[True, (anchor[at][1:] != anchor[at][:-1]) | (text[at][1:] != text[at][:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)]).astype(np.int32)
    head = at[first]
    return mix(grams[anchor[head]]), ids[text[head]], (head - offsets[text[head]]).astype(np.int32), count, windows[at]


def _flush(held: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    anchor, doc, start, count, windows = (np.concatenate(x) for x in zip(*held))
    if not len(anchor):
        return
    edges = np.r_[0, np.cumsum(count)]
    # Seeds of several documents whose windows all agree: two of them go to the part, the others are repeats already.
    sign = mix(np.add.reduceat(mix(windows), edges[:-1]) + count.astype(U64))
    order = np.lexsort((doc, sign))
    s, d = sign[order], doc[order]
    group = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
    heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    lowest = d[heads][group]
    other = d != lowest
    second = np.full(len(heads), len(d))
    np.minimum.at(second, group[other], np.flatnonzero(other))
    known_other = np.where(second[group] < len(d), lowest, -1)
    extra = other & (np.arange(len(d)) != second[group])
    known = np.zeros(len(anchor), bool)
    partner = np.full(len(anchor), -1, np.int64)
    known[order[extra]] = True
    partner[order[extra]] = known_other[extra]
    part = (anchor % U64(parts)).astype(np.int64)
    part[known] = (mix(doc[known].astype(U64)) % U64(parts)).astype(np.int64)
    for p, (rows,) in by_part(part, [np.arange(len(anchor))]):
        sent = rows[~known[rows]]
        n = count[sent]
        flat = np.repeat(edges[sent] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        done = rows[known[rows]]
        size = np.array([len(sent), len(done)], np.int64).tobytes()
        yield p, size + packed([doc[sent], start[sent], n]) + windows[flat].tobytes(), packed([doc[done], start[done], count[done], partner[done]])


def _emit(parts: int, threshold: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            rows = list(_flush(held, parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["part", "seeds", "known"],
            )

        for batch in batches:
            for piece in chunked(batch, "text"):
                got = occurrences(piece.column("text"), piece.column("doc_id").to_numpy(), threshold, k)
                held.append(got)
                size += got[-1].nbytes + 24 * len(got[0])
                if size > FLUSH_BYTES:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return run


def _extend(table: pa.Table) -> pa.Table:
    """Runs of windows that recur in another document, from all seeds of one part."""
    docs, starts, counts, windows, done = [], [], [], [], []
    for seeds, known in zip(table["seeds"].to_pylist(), table["known"].to_pylist()):
        n, m = np.frombuffer(seeds, np.int64, 2)
        docs.append(np.frombuffer(seeds, np.int64, n, 16))
        starts.append(np.frombuffer(seeds, np.int32, n, 16 + 8 * n))
        counts.append(np.frombuffer(seeds, np.int32, n, 16 + 12 * n))
        windows.append(np.frombuffer(seeds, U64, -1, 16 + 16 * n))
        done.append((np.frombuffer(known, np.int64, m), np.frombuffer(known, np.int32, m, 8 * m), np.frombuffer(known, np.int32, m, 12 * m), np.frombuffer(known, np.int64, m, 16 * m)))
    doc, start, count, window = (np.concatenate(x) for x in (docs, starts, counts, windows))
    edges = np.r_[0, np.cumsum(count)]
    seed = np.repeat(np.arange(len(doc)), count)
    order = np.argsort(window)
    w, d = window[order], doc[seed[order]]
    twin = np.zeros(len(w), bool)
    same = w[1:] == w[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    order, w, d = order[twin], w[twin], d[twin]
    out = [np.concatenate(x) for x in zip(*done)]
    result = [(out[0], out[1].astype(np.int64), out[1].astype(np.int64) + out[2] - 1, out[3])]
    if len(w):
        heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        group = np.cumsum(np.r_[True, w[1:] != w[:-1]]) - 1
        low = np.minimum.reduceat(d, heads)
        rest = np.where(d == low[group], np.iinfo(np.int64).max, d)
        second = np.minimum.reduceat(rest, heads)
        shared = second[group] != np.iinfo(np.int64).max
        at = order[shared]
        partner = np.where(d == low[group], second[group], low[group])[shared]
        back = np.argsort(at)
        at, partner = at[back], partner[back]
        sd = seed[at]
        place = start[sd].astype(np.int64) + at - edges[sd]
        if len(at):
            new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(sd) != 0)])
            last = np.r_[new[1:], len(at)] - 1
            result.append((doc[sd[new]], place[new], place[last], partner[new]))
    columns = [np.concatenate(x) for x in zip(*result)]
    return pa.table(dict(zip(("doc_id", "first", "last", "other_id"), columns)))


def repeated_passages(docs: DataFrame, threshold: int = 50, k: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeats of at least `threshold` words: (doc_id, start_word, n_words, other_id).

    A maximal repeat is a longest stretch of a document in which every `threshold` words (split at
    white space) occur in another document as well; other_id is a document that has the first of
    them. Every document that has the passage is listed, the first one too.

    NULL, empty and short texts have no repeats. Rows with a NULL doc_id are left out, and can't be the
    other document. Rows with one doc_id are one document: repeated rows don't count as each other's repeat. A
    passage that recurs only within a document isn't reported. Ties (a passage in many documents) are all
    listed. Very long texts are read whole. Empty tables: no rows. Other columns are ignored, whatever their names.
    """
    if not 0 < k <= threshold:
        raise ValueError("k must lie between 1 and threshold")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    _, size = text_size(rows, "text")
    parts = max(1, size // 6 // PART_WINDOWS)
    seeds = rows.mapInArrow(_emit(parts, threshold, k), "part int, seeds binary, known binary")
    runs = seeds.groupBy("part").applyInArrow(_extend, "doc_id long, first long, last long, other_id long")
    ordered = Window.partitionBy("doc_id").orderBy("first", "last", "other_id")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        runs.withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy("doc_id", "island")
        .agg(F.min("first").alias("start_word"), (F.max("last") - F.min("first") + threshold).alias("n_words"), F.min_by("other_id", "first").alias("other_id"))
        .select("doc_id", "start_word", "n_words", "other_id")
    )
