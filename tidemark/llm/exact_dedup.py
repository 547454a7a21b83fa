"""Exact dedup against a history held in a minimal perfect hash.

The distinct digests of the historical documents are split into shards; each shard's digests get a
minimal perfect hash (levels of collision-free bits, the slot is the rank of the key's bit) whose slots
hold the full SHA-256 digest and the doc_id of the winner. The distinct digests of all documents are looked up
in their shard and compared byte by byte with what the slot holds; a member's winner is read from its slot, those that
aren't members are grouped among themselves. Only digests and ids are shuffled, and texts that may have repeats where they are to be dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import U64, maybe_in, mix

#: Digests of one shard, about: what a worker holds at a time.
SHARD_KEYS = 200_000
_GAMMA = 2.0


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys[:, 0] ^ seed) ^ mix(keys[:, 1] + seed)) % U64(size)


def build_mph(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits for distinct digests (rows of four 64-bit words), and each digest's slot in 0..n-1."""
    left, levels, slots, base = np.arange(len(digests)), [], np.zeros(len(digests), np.int64), 0
    while len(left):
        size = max(64, int(_GAMMA * len(left)))
        at = _bits(digests[left], len(levels), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[placed]] = base + rank[at[placed]]
        base += int(placed.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def probe_mph(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest has if it is a member, -1 if its bits already rule that out."""
    slots, left, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        if not len(left):
            break
        at = _bits(digests[left], k, len(bits)).astype(np.int64)
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        slots[left[hit]] = base + rank[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slots


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, U64).reshape(-1, 4)


def _build(table: pa.Table) -> pa.Table:
    keys = _digests(table["digest"])
    levels, slots = build_mph(keys)
    held = np.empty_like(keys)
    held[slots] = keys
    winner = table["winner"].combine_chunks()
    locators = np.zeros(len(keys), np.int64)
    locators[slots] = winner.fill_null(0).to_numpy()
    missing = np.zeros(len(keys), bool)
    missing[slots] = winner.is_null().to_numpy(zero_copy_only=False)
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "held": pa.array([held.tobytes()], pa.binary()),
            "locators": pa.array([locators.tobytes()], pa.binary()),
            "missing": pa.array([np.packbits(missing).tobytes()], pa.binary()),
        }
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard from distinct (digest, winner): the hash's bits, full digests and winner locators."""
    return (
        history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(_build, "shard int, sizes array<long>, bits binary, held binary, locators binary, missing binary")
    )


def _probe(fresh: pa.Table, index: pa.Table) -> pa.Table:
    if not fresh.num_rows or not index.num_rows:
        return fresh.select(["digest", "winner"])
    row = index.to_pylist()[0]
    sizes = row["sizes"]
    flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
    levels = np.split(flat, np.cumsum(sizes)[:-1])
    keys = _digests(fresh["digest"])
    slots = probe_mph(levels, keys)
    held = np.frombuffer(row["held"], U64).reshape(-1, 4)
    member = slots >= 0
    member[member] = (held[slots[member]] == keys[member]).all(axis=1)  # the bytes decide
    at = slots[member]
    own = fresh["winner"].combine_chunks()
    winner, void = own.fill_null(0).to_numpy().copy(), own.is_null().to_numpy(zero_copy_only=False).copy()
    winner[member] = np.frombuffer(row["locators"], np.int64)[at]
    void[member] = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(held)).astype(bool)[at]
    return pa.table({"digest": fresh["digest"], "winner": pa.array(winner, pa.int64(), mask=void)})


def looked_up(fresh: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The distinct (digest, winner) rows of `fresh`, with the winner that the index holds for a member."""
    keyed = fresh.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "digest binary, winner long")


def _winners(rows: DataFrame, total: int) -> DataFrame:
    """(digest, winner) of all texts, from rows of (doc_id, digest, old): the history's winners, and those of its nonmembers."""
    shards = max(1, -(-total // SHARD_KEYS))
    real = rows.filter(F.col("digest").isNotNull())
    old = real.filter("old").groupBy("digest").agg(F.min("doc_id").alias("winner"))
    every = real.groupBy("digest").agg(F.min(F.when(~F.col("old"), F.col("doc_id"))).alias("winner"))
    return looked_up(every, build_index(old, shards), shards)


def _middle(docs: DataFrame, doc_id: str) -> Column:
    low, high = docs.agg(F.min(F.col(doc_id).cast("long")), F.max(F.col(doc_id).cast("long"))).first()
    return F.col(doc_id).cast("long") <= F.lit(((low or 0) + (high or 0)) // 2)


def exact_dedup(docs: DataFrame, history: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Which documents repeat a text: (doc_id, winner_id, n_rows, is_repeat), one row for each distinct (doc_id, text).

    history: true for the documents already taken in; by default those with doc_ids up to the middle of
    the range. A historical winner (the smallest doc_id there) wins over new documents; among new ones the
    smallest doc_id wins. Texts are equal if their bytes are.

    NULL text: never a repeat, its own winner. Empty text: a text like any other. NULL doc_id: wins only where
    no copy has an id, and is a repeat otherwise. Repeated rows: one result row, n_rows says how often they
    came. Empty tables: no rows. Other columns are ignored, whatever their names.
    """
    if history is None:
        history = _middle(docs, doc_id)
    rows = (
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.col(text), 256)).alias("digest"),
            F.coalesce(history, F.lit(False)).alias("old"),
        )
        .groupBy("doc_id", "digest", "old")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    winners = _winners(rows, docs.count()).withColumnRenamed("digest", "key")
    joined = rows.join(winners, F.col("digest") == F.col("key"), "left")
    chosen = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    return (
        joined.groupBy("doc_id", "digest")
        .agg(F.first(chosen).alias("winner_id"), F.sum("n_rows").alias("n_rows"))
        .select("doc_id", "winner_id", "n_rows", (~F.col("doc_id").eqNullSafe(F.col("winner_id"))).alias("is_repeat"))
    )


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without exact repeats, all columns kept; of rows with one doc_id and text one stays.

    Winners are those of exact_dedup. Of rows that agree in doc_id and text but not in other columns the one stays whose columns hash
    lowest. Documents without a text all stay. Only texts that occur more than once (and few others, by chance) are shuffled.
    """
    digest = F.unhex(F.sha2(F.col(text), 256))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), digest.alias("digest"),
        F.when(F.col(text).isNotNull(), F.xxhash64(digest)).alias("short"),
    )
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce(_middle(docs, doc_id), F.lit(False)).alias("old"))
    often = narrow.filter("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    suspect = maybe_in(often.select(F.xxhash64("digest").alias("short")), "short")("short")
    kept = _winners(narrow, docs.count()).withColumnRenamed("digest", "key")
    found = keyed.filter(suspect).join(kept, (F.col("digest") == F.col("key")) & F.col("id").eqNullSafe(F.col("winner")), "left_semi")
    one = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.xxhash64("row")))
    first = found.withColumn("n", one).filter("n = 1").select("row")
    return keyed.filter(~F.coalesce(suspect, F.lit(False))).select("row.*").unionAll(first.select("row.*"))
