"""Shared pieces of the corpus operators: word hashing in Arrow batches, packed shuffles, durable tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.shared import shared_dir

U64 = np.uint64
#: Text handled at a time inside a worker; bounds the worker's memory whatever the batch holds.
CHUNK_BYTES = 3 << 20
_BASE = U64(0x9E3779B97F4A7C15)


_OPEN: list[list[str]] = []


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths of all tables that durable writes meanwhile, for discard once the results that read them are written."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        _OPEN.pop()


def durable(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table's path is added to `held`, for discard once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in ([] if held is None else [held], _OPEN[-1:]):
        for x in paths:
            x.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that durable wrote and whose readers have all been written themselves."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in held:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    held.clear()


def trim() -> None:
    """Give memory that a finished task has freed back to the system: workers live on, and their next task may be another's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def trimmed(run: Callable) -> Callable:
    """A function over batches that trims when it is done."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        trim()

    return wrapped


def group_trimmed(run: Callable) -> Callable:
    """A function over a group's table that trims when the group is done."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return wrapped


def groups_trimmed(run: Callable) -> Callable:
    """The same for a function over the tables of two groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            trim()

    return wrapped


def word_count(text: Column) -> Column:
    """Whitespace-delimited words of a text, JVM-side; NULL and blank texts have none."""
    flat = F.trim(F.translate(text, "\t\n\r\x0b\x0c", "     "))
    return F.when(text.isNull() | (flat == ""), F.lit(0)).otherwise(
        F.size(F.filter(F.split(flat, " "), lambda w: w != ""))
    ).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunked(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than there are texts) and the flat array of whitespace-separated words; NULL has none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    base = offsets[0]
    before = np.zeros(len(real) + 1, np.int64)
    np.cumsum(real, out=before[1:])
    return before[offsets] - before[base], values.filter(pa.array(real)) if not real.all() else values.slice(base, offsets[-1] - base)


def word_codes(values: pa.Array) -> tuple[np.ndarray, list]:
    """A code for each word and the distinct words in order of their codes."""
    coded = pc.dictionary_encode(values)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the 64-bit hash of every word."""
    offsets, values = words(texts)
    codes, distinct = word_codes(values)
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), U64, len(distinct))
    return offsets, table[codes] if len(codes) else np.zeros(0, U64)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, by doubling; positions near the end are left out."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out, have, power, left = None, 0, {1: _BASE}, hashes
    span = 1
    while True:
        if n & span:
            if out is None:
                out, have = left, span
            else:  # the words so far, then `span` more
                m = len(hashes) - have - span + 1
                out, have = out[:m] * power[span] + left[have : have + m], have + span
        if span * 2 > n:
            break
        m = len(left) - span
        left = left[:m] * power[span] + left[span : span + m]
        power[span * 2] = U64(int(power[span]) ** 2 & 0xFFFFFFFFFFFFFFFF)
        span *= 2
    return mix(out[: len(hashes) - n + 1])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each position on."""
    if len(keys) < width:
        return keys[:0]
    low, span = keys, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = len(keys) - width + 1
    return np.minimum(low[:m], low[width - span : width - span + m])


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each flat position the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length laid end to end."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The inverse of packed for columns of the given dtypes."""
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def by_part(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    for a, b in zip(starts, np.r_[starts[1:], len(part)]):
        yield int(part[a]), [c[a:b] for c in columns]


#: Bits of a filter for each key, and the most that a filter is sent to all workers with; beyond, every key passes it.
FILTER_BITS, FILTER_LIMIT = 12, 1 << 28
_ROUNDS = 5


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = mix(keys ^ _BASE), mix(keys + _BASE) | U64(1)
    return np.stack([(a + U64(i) * b) % U64(bits) for i in range(_ROUNDS)])


def may_be_in(keys: DataFrame, key: str) -> Callable[[pa.Array], pa.Array] | None:
    """A test of long values for use in workers: false only for values that aren't among keys[key]; NULL gives false.

    The keys go into a Bloom filter that is built where they are, in slices; its size is checked before it is sent to the workers. Beyond
    FILTER_LIMIT bits there is no filter (None), and the join that it spares work for takes all rows.
    """
    spark = keys.sparkSession
    count = keys.count()
    if count * FILTER_BITS > FILTER_LIMIT:
        return None
    bits = max(4096, 1 << (count * FILTER_BITS - 1).bit_length()) if count else 4096
    slices = max(1, bits >> 20)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.unique(_places(b.column(0).drop_null().to_numpy().view(U64), bits)) for b in batches]
        at = np.unique(np.concatenate(own)).astype(np.int64) if own else np.zeros(0, np.int64)
        some, parts = [], []
        for i, (rows,) in by_part(at // (bits // slices), [at % (bits // slices)]):
            held = np.zeros(bits // slices, bool)
            held[rows] = True
            some.append(i)
            parts.append(np.packbits(held).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "bits"])

    def either(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    found = keys.select(key).mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInArrow(either, "slice int, bits binary").collect()
    whole = np.zeros((slices, bits // slices // 8), np.uint8)
    for r in found:
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(whole.ravel())

    def test(values: pa.Array) -> pa.Array:
        at = _places(pc.fill_null(values, 0).to_numpy(zero_copy_only=False).view(U64), bits)
        hit = (sent.value[at >> U64(3)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).all(axis=0)
        return pa.array(hit & ~values.is_null().to_numpy(zero_copy_only=False))

    return test


def maybe_in(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """may_be_in as a test of a long column. Where a Python step follows, the test belongs in that: a task keeps a worker for each of its Python steps."""
    test = may_be_in(keys, key)
    if test is None:
        return lambda name: F.col(name).isNotNull()

    @F.arrow_udf("boolean")
    def column(values: pa.Array) -> pa.Array:
        return test(values)

    return lambda name: column(F.col(name))


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a table. From a list, createDataFrame starts workers of their own on every executor, which live on, to pass the rows through."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def text_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows, and bytes of text over all of them; sizes the packed shuffles."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(n), int(size)
