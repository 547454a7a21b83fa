"""N-gram Jaccard join by parity sketches.

A text's sketch is a long bit string; each distinct word n-gram flips one bit of it, so that the sketches of
two texts differ in at most as many bits as their n-gram sets differ in elements. Two sets of Jaccard
similarity at least t and sizes a and b differ in at most (1-t)/(1+t)(a+b) elements. For each band of sizes the
sketch is cut into groups of GROUP blocks, so many that in one of them at most GROUP - AGREE blocks of two similar texts differ. They are
joined on single blocks, the most telling ones of each group by how often their n-grams occur in the corpus. Two texts meet on the most telling block that they
agree in: each row carries short signatures of its group's less telling blocks alone, and only texts that agree in AGREE blocks of the group, that one among
them, (more, where the sizes of two allow fewer differences) go on. A false agreement of signatures adds candidates and never takes one away.

Texts that agree with few others on a block go on as pairs; those that agree with RUN_TEXTS and more are tied together by a star, so that the candidates of a
group of near copies grow with its texts and not with their pairs. A text with few is never tied: agreements by chance would else join ever more unlike texts
to one group as the corpus grows. Long sketches and then the full n-gram sets decide on pairs; texts tied together by stars are all compared with each other,
by matrix products of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import U64, by_part, chunked, discard, durable, gram_hashes, group_trimmed, groups_trimmed, may_be_in, maybe_in, mix, owners, packed, text_size, trimmed, unpacked, word_hashes

#: Block rows of one part of the packed shuffle, about.
PART_ROWS = 500_000
FLUSH_ROWS = 250_000
#: Texts of one tile while pairs are verified, about, and n-grams of its rows or columns where all are compared.
TILE_TEXTS = 2_000
TILE_GRAMS = 1_500_000
#: A text that agrees with so many others on a block is tied to them by a star; with fewer, it is paired with each.
RUN_TEXTS = 24
#: Pairs of texts looked at in one go, so that what is computed of them stays in a core's cache.
CELLS_AT_ONCE = 1 << 15
#: Bits of a long sketch at least.
SKETCH_BITS = 256
#: Blocks of a group (bytes of whole words of signatures), and how many of them similar texts agree in, in one group at least; short texts, with few groups, in
#: more. A text sends all but one less than that of a group's blocks, those that say least: of the blocks in which two texts agree the most telling one is sent by both.
#: Unlike texts agree in half of a large group far less often than in half of a small one; their false ties would else join most of a large corpus to one group.
GROUP, AGREE = 16, 8
#: Near copies: sets of single words, so that an edit costs one element and not n. About one word in nine may differ.
THRESHOLD, N_WORDS = 0.8, 1
#: Cells of the hashed table of document frequencies; its size doesn't depend on the corpus.
CELLS, _SLICES = 1 << 17, 16
#: Bits of an n-gram's hash; the high bits of a sort key number the text.
_BITS = 44
_LOW = U64((1 << _BITS) - 1)
_WORDS = GROUP // 8
_KINDS = ["u4", "i8", *["u8"] * _WORDS, "u4", "u1"]


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the sorted distinct n-gram hashes of each text; a text of fewer than n words is one gram."""
    offsets, hashes = word_hashes(texts)
    count = len(offsets) - 1
    length = np.diff(offsets)
    grams = gram_hashes(hashes, n)
    text = owners(offsets)
    inside = np.arange(len(grams)) + n <= offsets[1:][text[: len(grams)]] if len(grams) else np.zeros(0, bool)
    keys = [(text[: len(grams)][inside].astype(U64) << U64(_BITS)) | (grams[inside] & _LOW)]
    for m in range(1, n):
        short = np.flatnonzero(length == m)
        if len(short):
            h = mix(hashes[offsets[short]] + U64(m))
            for j in range(1, m):
                h = mix(h * U64(31) + hashes[offsets[short] + j])
            keys.append((short.astype(U64) << U64(_BITS)) | (h & _LOW))
    flat = np.sort(np.concatenate(keys))
    if len(flat):
        flat = flat[np.r_[True, flat[1:] != flat[:-1]]]
    edges = np.searchsorted(flat, np.arange(count + 1).astype(U64) << U64(_BITS))
    return edges, flat & _LOW


class Bands:
    """Size bands and the blocks of each; the same on every worker, whatever the data."""

    def __init__(self, threshold: float):
        self.ratio = 1.0 / threshold
        self.slack = (1.0 - threshold) / (1.0 + threshold)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(sizes, 1)) / math.log(self.ratio) + 1e-9).astype(np.int64)

    def groups(self, band: np.ndarray) -> np.ndarray:
        """Groups of blocks of a band: a group is lost to a pair if the two differ in more than GROUP - AGREE of its blocks."""
        differ = np.floor(self.slack * 2 * np.floor(self.ratio ** (band + 1.0) + 1e-6) + 1e-9)
        return (differ // (GROUP - AGREE + 1) + 1).astype(np.int64)

    def agree(self, band: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Blocks in which similar texts of so many elements together agree, in one group of their band at least."""
        return GROUP - np.minimum(np.floor(self.slack * both + 1e-9) // self.groups(band), GROUP - AGREE).astype(np.int64)

    def least(self, band: np.ndarray) -> np.ndarray:
        """The same for the largest texts of a band."""
        return self.agree(band, 2 * np.floor(self.ratio ** (band + 1.0) + 1e-6))


def cells(grams: np.ndarray) -> np.ndarray:
    """Where an n-gram is counted in the table of document frequencies."""
    return (mix(grams ^ U64(0x6A09E667F3BCC909)) % U64(CELLS)).astype(np.int64)


def block_rows(edges: np.ndarray, grams: np.ndarray, threshold: float, telling: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, text, signatures (_WORDS columns), size, own) for each block that each text sends, in its own and the next band.

    telling: by cell, how much an n-gram there says (whole numbers; all alike by default). signatures: a byte for each block of the group that says less than
    the one sent, 0 for the others and itself. Which of two blocks says less depends on the two alone, so texts that agree in both have them in the same order.
    own: 1 in the text's own band.
    """
    bands = Bands(threshold)
    sizes = np.diff(edges)
    text = np.repeat(np.arange(len(sizes)), sizes)
    bit = mix(grams ^ U64(0x51ED270B7F4A7C15))  # the bit that a gram flips: its block, and its place there
    code = mix(bit >> U64(64 - _BITS))
    says = telling[cells(grams)] if telling is not None else np.ones(len(grams))
    out = []
    for up in (0, 1):
        band = bands.of(sizes) + up
        groups = bands.groups(band)
        groups[sizes == 0] = 0
        blocks = groups * GROUP
        base = np.r_[0, np.cumsum(blocks)]
        flat = base[text] + (bit % np.maximum(blocks, 1).astype(U64)[text]).astype(np.int64)
        total = np.zeros(base[-1], U64)
        order = np.argsort(flat, kind="stable")
        cell = flat[order]
        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        if len(heads):
            total[cell[heads]] = np.bitwise_xor.reduceat(code[order], heads)
        told = np.minimum(np.bincount(flat, weights=says, minlength=base[-1]), (1 << 20) - 1).astype(U64)
        rank = np.argsort(((told << U64(44)) | (total >> U64(20))).reshape(-1, GROUP), axis=1, kind="stable")
        owner = np.repeat(np.arange(len(sizes)), groups)
        sent = np.empty((len(rank), GROUP), bool)
        np.put_along_axis(sent, rank, np.arange(GROUP) >= bands.least(band)[owner][:, None] - 1, axis=1)
        place_of = np.empty(rank.shape, np.uint8)
        np.put_along_axis(place_of, rank, np.arange(GROUP, dtype=np.uint8), axis=1)
        row = np.nonzero(sent)[0]
        byte = np.maximum(mix(total ^ U64(0x2545F4914F6CDD1D)).astype(np.uint8), 1).reshape(-1, GROUP)
        signature = (byte[row] * (place_of[row] < place_of[sent][:, None])).view(U64)
        whole = mix(total).reshape(-1, GROUP)
        number = np.arange(len(rank)) - (base[:-1] // GROUP)[owner]
        place = mix((band[owner].astype(U64) << U64(40)) + (number.astype(U64) << U64(3)))
        key = mix(whole + (place[:, None] ^ np.arange(GROUP, dtype=U64)))
        wide = lambda x: np.broadcast_to(x[:, None], sent.shape)[sent]
        text_of = wide(owner)
        out.append((key[sent], text_of, *signature.T, sizes[text_of].astype(np.uint32), np.full(len(text_of), 1 - up, np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _blobs(kind: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[kind, "rows"])


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the long sketch of a set: two or more for each element."""
    return np.maximum(SKETCH_BITS, 1 << (np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1))


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Sketches (rows of bytes) of more bits as they would be with fewer: their parts laid over each other."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, bits // 8), axis=1)


def _profile(n: int):
    """Size and long sketch of each text; a task's document frequencies, in slices, come last with tid NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for piece in chunked(batch, "text", 1 << 20):
                edges, grams = gram_sets(piece.column("text"), n)
                count = len(edges) - 1
                seen += np.bincount(cells(grams), minlength=CELLS)
                sizes = np.diff(edges)
                wide = sketch_bits(sizes)
                begin = np.r_[0, np.cumsum(wide)]
                bits = np.repeat(begin[:-1], sizes) + (mix(grams ^ U64(0x3C6EF372FE94F82B)) & np.repeat(wide - 1, sizes).astype(U64)).astype(np.int64)
                long = np.packbits(np.bincount(bits, minlength=begin[-1]).astype(np.uint8) & 1)
                blobs = [long[a:b] for a, b in zip(begin[:-1] // 8, begin[1:] // 8)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("tid"), pa.array(sizes, pa.int32()), pa.array([b.tobytes() for b in blobs], pa.binary())], names=["tid", "size", "long"]
                )
        parts = seen.reshape(_SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(_SLICES, pa.int64()), pa.array(range(_SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["tid", "size", "long"]
        )

    return trimmed(run)


def _add_up(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.int64) for b in table["long"].to_pylist()], axis=0)
    return pa.table({"size": pa.array([table["size"][0].as_py()], pa.int32()), "long": pa.array([total.tobytes()], pa.binary())})


def _telling(profiles: DataFrame) -> np.ndarray:
    """How much an n-gram says, by cell: sixteenths of bits. The table that comes to the driver and to all tasks has CELLS numbers, whatever the corpus."""
    counts = profiles.filter("tid IS NULL").select("size", "long", F.pmod(F.xxhash64("long"), F.lit(64)).alias("salt"))
    added = counts.groupBy("size", "salt").applyInArrow(lambda t: _add_up(t.select(["size", "long"])), "size int, long binary")
    slices = added.groupBy("size").applyInArrow(_add_up, "size int, long binary").collect()
    seen = np.concatenate([np.frombuffer(r["long"], np.int64) for r in sorted(slices, key=lambda r: r["size"])]) if slices else np.zeros(CELLS, np.int64)
    return np.round(16 * np.log2((seen.max() + 1) / (seen + 1))) + 1


def _emit(parts: int, n: int, threshold: float, telling: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            key, *rest = (np.concatenate(x) for x in zip(*held))
            columns = [((key // U64(parts)) & U64(0xFFFFFFFF)).astype(np.uint32), *rest]
            return _blobs("part", [(p, packed(c)) for p, c in by_part((key % U64(parts)).astype(np.int64), columns)])

        for batch in batches:
            for piece in chunked(batch, "text", 1 << 20):
                edges, grams = gram_sets(piece.column("text"), n)
                key, owner, *rest = block_rows(edges, grams, threshold, telling)
                held.append((key, piece.column("tid").to_numpy()[owner], *rest))
                size += len(key)
                if size > FLUSH_ROWS:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return trimmed(run)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes other than 0 a and b (their words along the first axis) agree."""
    low, count = U64(0x7F7F7F7F7F7F7F7F), np.uint8(0)
    for x, y in zip(a, b):
        z = x ^ y
        some = (((x & low) + low) | x) & ~low
        count = count + np.bitwise_count(some & ~(((z & low) + low) | z))
    return count


class Run:
    """The texts that have one block in common, of one band: their signatures (words along the first axis), sizes, and whether the band is their own."""

    def __init__(self, signature: np.ndarray, size: np.ndarray, own: np.ndarray, band: int, threshold: float):
        self.signature, self.size, self.own = signature, size.astype(np.int32), own > 0
        self.low = np.floor(threshold * self.size - 1e-3).astype(np.int32)
        self.high = np.ceil(self.size / threshold + 1e-3).astype(np.int32)
        both = np.arange(2 * int(self.size.min()), 2 * int(self.size.max()) + 1)
        need = Bands(threshold).agree(np.full(len(both), band), both) - 1  # besides the block that they meet on
        self.need = need[0]
        self.eased = np.repeat(both[1:], need[:-1] - need[1:]).astype(np.int32)  # from so many elements together on, one less is needed

    def hits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of x may be similar to which of y."""
        other = self.size[y]
        count = _agreeing(self.signature[:, x, None], self.signature[:, None, y])
        for least in self.eased:
            count += other >= (least - self.size[x])[:, None]
        return (count >= self.need) & (other >= self.low[x][:, None]) & (other <= self.high[x][:, None]) & (self.own[x][:, None] | self.own[y])

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (x, y) of the texts that hit fewer than RUN_TEXTS others, and for each text the first of its component of those that hit more, -1 for the rest."""
        n = len(self.size)
        found, busy = np.zeros(n, np.int64), np.arange(n)
        pairs, at, step = [np.zeros((2, 0), np.int64)], 0, 2 * RUN_TEXTS
        while at < n:  # few steps settle most texts of a group of copies
            y = np.arange(at, min(n, at + step))
            for c in range(0, len(busy), max(1, CELLS_AT_ONCE // len(y))):
                x = busy[c : c + max(1, CELLS_AT_ONCE // len(y))]
                i, j = np.nonzero(self.hits(x, y))
                i, j = x[i], y[j]
                i, j = i[i != j], j[i != j]
                found += np.bincount(i, minlength=n)
                pairs.append(np.stack([i, j]))
            busy = busy[found[busy] < RUN_TEXTS]
            at, step = at + step, min(2 * step, 4096)
        x, y = np.concatenate(pairs, axis=1)
        few = found[x] < RUN_TEXTS
        label, left = np.full(n, -1), np.flatnonzero(found >= RUN_TEXTS)
        while len(left):
            front, left = left[:1], left[1:]
            root, step = front[0], 1
            label[root] = root
            while len(front) and len(left):
                some, front = front[:step], front[step:]
                hit = self.hits(some, left).any(axis=0)
                label[left[hit]] = root
                front, left = np.r_[front, left[hit]], left[~hit]
                step = min(2 * step, max(1, CELLS_AT_ONCE // max(len(left), 1)))
        return x[few], y[few], label


def _tied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edges (a, b) as stars: each end that isn't the least of its component, with that."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == low).all() and (label[v] == low).all():
            break
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
    moved = label < np.arange(len(nodes))
    return np.stack([nodes[label[moved]], nodes[moved]], axis=1)


def _meet(threshold: float):
    """Texts that have a block in common and agree in enough blocks of its group: pairs, and stars (a, the least text; star true) of those that agree with many."""
    bands = Bands(threshold)

    def run(table: pa.Table) -> pa.Table:
        key, tid, *words, size, own = (np.concatenate(x) for x in zip(*(unpacked(b, _KINDS) for b in table["rows"].to_pylist())))
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        twin = np.zeros(len(k), bool)
        twin[1:] |= same
        twin[:-1] |= same
        order = order[twin]
        order = order[np.lexsort((tid[order], key[order]))]
        one = np.r_[True, (key[order][1:] != key[order][:-1]) | (tid[order][1:] != tid[order][:-1])][: len(order)]  # copies of a text are one
        order = order[one]
        key, tid, size, own = (x[order] for x in (key, tid, size, own))
        signature = np.stack([w[order] for w in words])
        del words
        size = size.astype(np.int64)
        band = bands.of(size) + 1 - own
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        ends = np.r_[heads[1:], len(key)]
        part = np.repeat(heads, ends - heads)
        ties, out = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(ends - heads > RUN_TEXTS):
            x = slice(heads[i], ends[i])
            part[x] = -1
            for b in np.unique(band[x]):  # one, but for keys that agree by chance
                y = heads[i] + np.flatnonzero(band[x] == b)
                one, other, label = Run(signature[:, y], size[y], own[y], b, threshold).split()
                out.append(np.stack([tid[y[one]], tid[y[other]]], axis=1))
                many = label >= 0
                ties.append(np.stack([tid[y[label[many]]], tid[y[many]]], axis=1))
        order = np.flatnonzero(part >= 0)
        part, tid, size, own, band = (x[order] for x in (part, tid, size, own, band))
        signature = signature[:, order]
        at, step = np.arange(len(part)), 1
        while len(at):  # pairs `step` apart within their part of a block's run: there are at most RUN_TEXTS steps
            at = at[: np.searchsorted(at, len(part) - step)]
            at = at[part[at] == part[at + step]]
            for c in range(0, len(at), 1 << 18):
                x = at[c : c + (1 << 18)]
                y = x + step
                good = (_agreeing(signature[:, x], signature[:, y]) >= bands.agree(band[x], size[x] + size[y]) - 1) & (own[x] | own[y] > 0)
                good &= np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-6
                out.append(np.stack([tid[x[good]], tid[y[good]]], axis=1))
            step += 1
        pairs = np.concatenate(out)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        edges = np.concatenate(ties)
        edges = _tied(edges[:, 0], edges[:, 1])
        star = np.r_[np.zeros(len(pairs), bool), np.ones(len(edges), bool)]
        pairs = np.concatenate([pairs, edges])
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "star": star})

    return group_trimmed(run)


def _sets(n: int, wanted: Callable[[pa.Array], pa.Array] | None):
    """Sets of the rows whose `first` may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted:
                batch = batch.filter(wanted(batch.column("first")))
            for piece in chunked(batch, "text", 1 << 20):
                edges, grams = gram_sets(piece.column("text"), n)
                six = np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :6]  # a hash has 44 bits
                blobs = [six[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("tid"), piece.column("doc_id"), pa.array(np.diff(edges), pa.int32()), pa.array(blobs, pa.binary())], names=["tid", "doc_id", "size", "grams"]
                )

    return trimmed(run)


def _verify(threshold: float):
    """Similarity of a tile's pairs from its texts' sets."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("ta", "tb", "doc_a", "doc_b")} | {"jaccard": pa.array([], pa.float64())})
        if not pairs.num_rows or not sets.num_rows:
            return empty
        tid = sets["tid"].to_numpy()
        order = np.argsort(tid)
        head = sets["head"].to_numpy()
        blobs = sets["grams"].to_pylist()
        size = sets["size"].to_numpy()
        edges = np.r_[0, np.cumsum(size)]
        wide = np.zeros((edges[-1], 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
        known, number = np.unique(wide.view(U64).ravel(), return_inverse=True)
        a = order[np.searchsorted(tid, pairs["a"].to_numpy(), sorter=order)]
        b = order[np.searchsorted(tid, pairs["b"].to_numpy(), sorter=order)]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        score = np.zeros(len(a))
        mark = np.zeros(len(known), bool)
        heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for x, y in zip(heads, np.r_[heads[1:], len(a)]):
            own = number[edges[a[x]] : edges[a[x] + 1]]
            mark[own] = True
            for z in range(x, y, 4096):  # partners at a time
                other = b[z : min(y, z + 4096)]
                n = size[other]
                flat = np.repeat(edges[other] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(np.repeat(np.arange(len(other)), n), weights=mark[number[flat]], minlength=len(other))
                score[z : z + len(other)] = both / np.maximum(len(own) + n - both, 1)
            mark[own] = False
        keep = score >= threshold
        a, b = a[keep], b[keep]
        return pa.table({"ta": tid[a], "tb": tid[b], "doc_a": np.minimum(head[a], head[b]), "doc_b": np.maximum(head[a], head[b]), "jaccard": score[keep]})

    return groups_trimmed(run)


def _common(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], known: int) -> np.ndarray:
    """Common elements of each row's and each column's set, from their (set, element) entries: frequent elements by matrix products, rare ones one by one."""
    out = np.zeros(shape, np.float32)
    times = [np.bincount(e, minlength=known) for _, e in (own, other)]
    work = times[0].astype(float) * times[1]
    often = work * 256 >= shape[0] * shape[1]
    columns = np.flatnonzero(often)
    sides = []
    for s, e in (own, other):
        order = np.argsort(e, kind="stable")
        sides.append((s[order], e[order]))
    for c in range(0, len(columns), 1024):
        slab = columns[c : c + 1024]
        wide = []
        for (s, e), n in zip(sides, shape):
            x, y = np.searchsorted(e, [slab[0], slab[-1] + 1])
            s, e = s[x:y], e[x:y]
            s, e = s[often[e]], e[often[e]]
            wide.append(np.zeros((n, len(slab)), np.float32))
            wide[-1][s, np.searchsorted(slab, e)] = 1
        out += wide[0] @ wide[1].T
    (s, e), (t, f) = sides
    edges = np.searchsorted(f, np.arange(known + 1))
    rare = ~often[e] & (work[e] > 0)
    s, e = s[rare], e[rare]
    n = np.diff(edges)[e]
    flat = out.ravel()
    after = np.cumsum(n)
    at = 0
    while at < len(s):
        end = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + (1 << 20))))
        m = n[at:end]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        np.add.at(flat, np.repeat(s[at:end], m) * shape[1] + t[np.repeat(edges[e[at:end]], m) + inner], np.float32(1))
        at = end
    return out


def _connected(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the graph between rows and columns: for each of both a row of its component, -1 for columns without any."""
    turned = np.ascontiguousarray(good.T)
    row, column = np.full(len(good), -1), np.full(len(turned), -1)
    for first in range(len(good)):
        if row[first] >= 0:
            continue
        row[first], now = first, np.array([first])
        while len(now):
            now = np.flatnonzero(good[now].any(axis=0) & (column < 0))
            column[now] = first
            now = np.flatnonzero(turned[now].any(axis=0) & (row < 0))
            row[now] = first
    return row, column


def _compare(threshold: float, pairs: bool):
    """All texts of a tile's row with all of its column: pairs, or each text's links and a text of its component (itself at the least)."""

    def run(table: pa.Table) -> pa.Table:
        row, column = table["row"][0].as_py(), table["column"][0].as_py()
        cell, tid, head, size = (table[c].to_numpy() for c in ("cell", "tid", "head", "size"))
        edges = np.r_[0, np.cumsum(size)]
        wide = np.zeros((edges[-1], 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(table["grams"].to_pylist()), np.uint8).reshape(-1, 6)
        known, number = np.unique(wide.view(U64).ravel(), return_inverse=True)
        del wide
        owner = np.repeat(np.arange(len(size)), size)
        sides = [np.flatnonzero(cell == c) for c in (row, column)]
        place = np.zeros(len(size), np.int64)
        entries = []
        for x in sides:
            place[x] = np.arange(len(x))
            inside = np.isin(cell[owner], cell[x[:1]])
            entries.append((place[owner[inside]], number[inside]))
        a, b = sides
        both = _common(*entries, (len(a), len(b)), len(known))
        good = np.zeros(both.shape, bool)
        for c in range(0, len(a), 256):
            part = both[c : c + 256].astype(float)
            good[c : c + 256] = part / (size[a[c : c + 256]][:, None] + size[b] - part) >= threshold
        if pairs:
            x, y = np.nonzero(good)
            if row == column:
                x, y = x[x < y], y[x < y]
            n = both[x, y].astype(float)
            x, y = a[x], b[y]
            score = n / (size[x] + size[y] - n)
            return pa.table({"ta": tid[x], "tb": tid[y], "doc_a": np.minimum(head[x], head[y]), "doc_b": np.maximum(head[x], head[y]), "jaccard": score})
        first, last = _connected(good)
        if row == column:
            x, links, root = a, good.sum(axis=1) - 1, first
        else:
            x, links, root = np.r_[a, b], np.r_[good.sum(axis=1), good.sum(axis=0)], np.r_[first, last]
        some = links > 0
        return pa.table({"tid": tid[x[some]], "other": tid[a[root[some]]], "links": links[some].astype(np.int64)})

    return group_trimmed(run)


def _hopeful(threshold: float):
    """The texts of a tile that have another in it which their long sketches, folded to a common width, don't rule out."""
    slack = (1 - threshold) / (1 + threshold)

    def run(table: pa.Table) -> pa.Table:
        cell, tid, size = (table[c].to_numpy() for c in ("cell", "tid", "size"))
        size = size.astype(np.int64)
        bits = sketch_bits(size)
        low = int(bits.min())
        blobs = table["long"].to_pylist()
        short = np.empty((len(size), low // 8), np.uint8)
        for w in np.unique(bits):
            at = np.flatnonzero(bits == w)
            for c in range(0, len(at), 1024):
                x = at[c : c + 1024]
                short[x] = folded(np.frombuffer(b"".join(blobs[i] for i in x), np.uint8).reshape(len(x), -1), low)
        a, b = (np.flatnonzero(cell == table[c][0].as_py()) for c in ("row", "column"))
        signs = lambda x: np.float32(1) - np.float32(2) * np.unpackbits(short[x], axis=1).astype(np.float32)
        other, some = signs(b).T, np.zeros(len(size), bool)
        for c in range(0, len(a), 512):
            x = a[c : c + 512]
            far = (low - signs(x) @ other) / 2
            sizes = size[x][:, None] + size[b]
            good = (far <= slack * sizes + 1e-3) & (np.abs(size[x][:, None] - size[b]) <= slack * sizes + 1e-3) & (tid[x][:, None] != tid[b])
            some[x] |= good.any(axis=1)
            some[b] |= good.any(axis=0)
        return pa.table({"tid": tid[some]})

    return group_trimmed(run)


def _grids(group: DataFrame, texts: DataFrame, judge: Callable, result: str) -> DataFrame:
    """What judge says of all texts (tid, size, ...) of each group (tid, group_id) against each other, in a grid of tiles."""
    members = texts.join(group, "tid")
    most = members.groupBy("group_id").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE_TEXTS, F.sum("size") / TILE_GRAMS)).cast("int").alias("grid"))
    celled = members.join(most, "group_id").withColumn("cell", F.pmod(F.xxhash64("tid"), F.col("grid")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("grid") - 1), lambda j: F.struct(F.least("cell", j).alias("row"), F.greatest("cell", j).alias("column")))
    placed = celled.withColumn("tile", F.explode(tiles)).select("group_id", "tile.row", "tile.column", "cell", *texts.columns)
    tile = ["group_id", "row", "column"]
    return placed.repartition(*tile).groupBy(*tile).applyInArrow(judge, result)  # else all tiles of a group stay in the task that the join put it in


def _roots(labels: DataFrame, held: list[str] | None) -> DataFrame:
    """Labels (tid, label), label being a smaller tid or tid itself, followed to their ends by doubling."""
    while True:
        ahead = labels.select(F.col("tid").alias("label"), F.col("label").alias("next"))
        further = durable(labels.join(ahead, "label", "left").select("tid", F.coalesce("next", "label").alias("label"), (F.col("next") < F.col("label")).alias("moved")), held)
        if not further.filter("moved").limit(1).count():
            return labels
        labels = further.drop("moved")


def _far(threshold: float):
    """A tile's pairs that their long sketches don't rule out; the longer of two is folded."""
    slack = (1 - threshold) / (1 + threshold)

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        if not pairs.num_rows or not texts.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b")})
        tid = texts["tid"].to_numpy()
        order = np.argsort(tid)
        size = texts["size"].to_numpy().astype(np.int64)
        bits = sketch_bits(size)
        blobs = texts["long"].to_pylist()
        a, b = (order[np.searchsorted(tid, pairs[c].to_numpy(), sorter=order)] for c in "ab")
        keep = np.zeros(len(a), bool)
        kind = np.maximum(bits[a], bits[b]) * 64 + np.log2(np.minimum(bits[a], bits[b])).astype(np.int64)
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            low = 1 << (int(k) % 64)
            step = max(1, (32 << 20) // (int(k) // 64))
            for c in range(0, len(at), step):
                x = at[c : c + step]
                sides = []
                for side in (a[x], b[x]):
                    out = np.empty((len(x), low // 8), np.uint8)
                    for w in np.unique(bits[side]):
                        rows = np.flatnonzero(bits[side] == w)
                        out[rows] = folded(np.frombuffer(b"".join(blobs[i] for i in side[rows]), np.uint8).reshape(len(rows), -1), low)
                    sides.append(out)
                far = np.bitwise_count((sides[0] ^ sides[1]).view(U64)).sum(axis=1, dtype=np.int64)
                keep[x] = far <= slack * (size[a[x]] + size[b[x]]) + 1e-9
        return pairs.select(["a", "b"]).filter(pa.array(keep))

    return groups_trimmed(run)


def _tiled(pairs: DataFrame, texts: DataFrame, judge: Callable, result: str, held: list[str] | None) -> DataFrame:
    """What judge(pairs of a tile, the texts that they name) says of all pairs (a, b).

    A row of texts (tid, ...) is sent to the tiles of its pairs, not along with each pair. Pairs (a, b) go to the tile of b's label, the text that is
    reached by going on to the least text that a text meets: members of a group of copies mostly share it. A label of many texts is cut into a grid of tiles.
    """
    ends = pairs.select(F.col("a").alias("tid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("tid"), F.col("a").alias("other")))
    labels = ends.groupBy("tid").agg(F.least(F.min("other"), F.first("tid")).alias("label"))
    labels = _roots(durable(labels, held), held)
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE_TEXTS).alias("grid"))
    labelled = durable(labels.join(sizes, "label"), held)
    bins = max(1, labelled.count() // TILE_TEXTS)
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("grid"))
    tile = ["bin", "row", "column"]
    placed = pairs.join(labelled.select(F.col("tid").alias("b"), "label", "grid"), "b").select(
        F.pmod(F.xxhash64("label"), F.lit(bins)).alias("bin"), cell("a").alias("row"), cell("b").alias("column"), "a", "b"
    )
    needed = placed.select(*[F.col(c).alias(f"to_{c}") for c in tile], F.explode(F.array("a", "b")).alias("tid")).distinct().join(texts, "tid")
    return placed.groupBy(*tile).cogroup(needed.groupBy(*[f"to_{c}" for c in tile])).applyInArrow(judge, result)


def _blank(text: Column) -> Column:
    """No character but white space; the few at the front settle it for most texts, and the whole is looked at where they don't."""
    flat = lambda x: F.trim(F.translate(x, "\t\n\r\x0b\x0c", "     ")) == ""
    return flat(F.substring(text, 1, 64)) & flat(text)


def _known(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tid, text) of the rows that can be in a pair."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.filter(~_blank(F.col("text")))


def _candidates(real: DataFrame, n: int, threshold: float, held: list[str] | None) -> tuple[DataFrame, DataFrame | None]:
    """(a, b): pairs of texts that agree in enough blocks of a group and that long sketches don't rule out; and (tid, group_id): groups of texts that are to
    be compared with all others of their group, without those that long sketches rule out (None: there are none). No similar pair is in neither, none in both.
    """
    _, size = text_size(real, "text")
    profiles = durable(real.select("tid", "text").mapInArrow(_profile(n), "tid long, size int, long binary"), held)
    per_word = 4.5 * (1 - threshold) / (1 + threshold)
    parts = max(1, int(size / 6 * per_word) // PART_ROWS)
    rows = real.select("tid", "text").mapInArrow(_emit(parts, n, threshold, _telling(profiles)), "part int, rows binary")
    met = durable(rows.groupBy("part").applyInArrow(_meet(threshold), "a long, b long, star boolean").distinct(), held)
    pairs, group = met.filter("NOT star").select("a", "b"), None
    if met.filter("star").limit(1).count():
        tied = met.filter("star").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
        group = durable(components(tied).select(F.col("doc_id").alias("tid"), "group_id"), held)
        for c in "ab":
            pairs = pairs.join(group.select(F.col("tid").alias(c), F.col("group_id").alias(f"group_{c}")), c, "left")
        pairs = durable(pairs.filter("group_a IS NULL OR group_b IS NULL OR group_a <> group_b").select("a", "b"), held)
    longs = profiles.filter("tid IS NOT NULL").dropDuplicates(["tid"])
    if group is not None:
        hopeful = durable(_grids(group, longs, _hopeful(threshold), "tid long").distinct(), held)
        group = durable(group.join(hopeful, "tid"), held)
    return _tiled(pairs, longs, _far(threshold), "a long, b long", held), group


def _near(real: DataFrame, threshold: float, n: int, held: list[str] | None, whole: bool = False) -> DataFrame:
    """Links of different texts. whole: (ta, tb, doc_a, doc_b, jaccard), pairs by text and by the smallest doc_id that has it. Otherwise
    (tid, other, links), so many rows as texts and not as pairs: a text has as many links as its rows say, and tid and other connect what the pairs connect.
    """
    pairs, group = _candidates(real, n, threshold, held)
    pairs = durable(pairs, held)
    named = pairs.select(F.explode(F.array("a", "b")).alias("tid"))
    named = named if group is None else named.unionByName(group.select("tid"))
    heads = real.groupBy("tid").agg(F.min("doc_id").alias("head"))
    wanted = durable(named.distinct().join(heads, "tid").select(F.xxhash64("tid", "head").alias("first")), held)
    # Of copies of a text only the one with the smallest doc_id passes (and a few others, by chance).
    some = real.withColumn("first", F.xxhash64("tid", "doc_id"))
    sets = some.mapInArrow(_sets(n, may_be_in(wanted, "first")), "tid long, doc_id long, size int, grams binary").groupBy("tid").agg(F.min("doc_id").alias("head"), F.first("size").alias("size"), F.first("grams").alias("grams"))
    sets = durable(sets, held)
    found = _tiled(pairs, sets, _verify(threshold), "ta long, tb long, doc_a long, doc_b long, jaccard double", held)
    if whole:
        return found if group is None else found.unionByName(_grids(group, sets, _compare(threshold, True), "ta long, tb long, doc_a long, doc_b long, jaccard double"))
    ends = F.explode(F.array(F.struct(F.col("ta").alias("tid"), F.col("tb").alias("other")), F.struct(F.col("tb").alias("tid"), F.col("ta").alias("other")))).alias("e")
    links = found.select(ends).select("e.tid", "e.other", F.lit(1).cast("long").alias("links"))
    return links if group is None else links.unionByName(_grids(group, sets, _compare(threshold, False), "tid long, other long, links long"))


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, doc_id: str = "doc_id", text: str = "text", held: list[str] | None = None) -> DataFrame:
    """Pairs of near copies: (doc_a, doc_b, jaccard) with doc_a < doc_b and jaccard at least `threshold`.

    The Jaccard similarity is that of the sets of word n-grams (words split at white space; a text of
    fewer than n words is one gram). Documents of one text form a group: its smallest doc_id stands
    for it in the pairs with other texts, and every other member is paired with that one (jaccard 1), so that
    thousands of copies don't make millions of pairs; all other pairs follow from these. Texts are told apart by hashes of
    64 bits, n-grams by hashes of 44 bits; apart from these no pair is missed. Rows grow with the square of a group of near copies: near_classes
    gives a row for each document instead. held gets the paths of the tables in the shared folder that the result reads.

    NULL, empty and blank texts are in no pair. Rows with a NULL doc_id are left out. Rows with one doc_id and text
    count once; a doc_id with several texts stands for each of them (a pair of ids may then come more than once), and isn't
    paired with itself. Very long texts are
    compared whole. Empty tables: no rows. Other columns are ignored, whatever their names.
    """
    real = _known(docs, doc_id, text)
    near = _near(real, threshold, n, held, whole=True).filter("doc_a <> doc_b").select("doc_a", "doc_b", "jaccard")
    heads = real.groupBy("tid").agg(F.min("doc_id").alias("head"))
    copies = real.select("doc_id", "tid").distinct().join(heads, "tid").filter("doc_id <> head")
    return near.unionByName(copies.select(F.col("head").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, doc_id: str = "doc_id", text: str = "text", held: list[str] | None = None) -> DataFrame:
    """The class of near copies of each document: (doc_id, class_id, n_links), one row for each doc_id and text.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams is at least `threshold`, as in similar_pairs; all links are found and
    counted. n_links: other texts that the document's text is linked with; copies of a text are one text. class_id: the smallest doc_id that has a text
    of the connected component, copies included; a document without near copies is its own class.

    NULL, empty and blank texts are linked with none and are classes of their own. Rows with a NULL doc_id are left out. Rows with one doc_id and text
    count once; a doc_id with several texts has a row for each. Empty tables: no rows. Other columns are ignored, whatever their names.
    """
    real = _known(docs, doc_id, text)
    links = durable(_near(real, threshold, n, held), held)
    group = components(links.select(F.col("tid").alias("doc_a"), F.col("other").alias("doc_b"))).select(F.col("doc_id").alias("tid"), "group_id")
    heads = real.groupBy("tid").agg(F.min("doc_id").alias("head"))
    placed = durable(links.groupBy("tid").agg(F.sum("links").alias("n_links")).join(group, "tid").join(heads, "tid"), held)
    classes = placed.groupBy("group_id").agg(F.min("head").alias("class_id"))
    linked = placed.join(classes, "group_id").select("tid", "class_id", "n_links")
    known = real.select("doc_id", "tid").distinct().join(heads, "tid").join(linked, "tid", "left")
    blank = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL").filter(F.col("text").isNull() | _blank(F.col("text")))
    alone = blank.distinct().select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.select("doc_id", F.coalesce("class_id", "head").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).unionByName(alone)


def components(pairs: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(doc_id, group_id) of all documents in pairs (doc_a, doc_b): connected components, named by the smallest doc_id.

    Alternating large-star and small-star steps; each round is written to the shared folder, and the one before it deleted, as
    are the tables in `held`, which only the pairs read.
    """
    spent: list[str] = []
    edges = durable(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct(), spent)
    discard(pairs.sparkSession, held or [])
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        fresh: list[str] = []
        edges = durable(small.filter("u <> v").distinct(), fresh)
        discard(pairs.sparkSession, spent)
        spent = fresh
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("doc_id")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(roots.select("doc_id", F.col("doc_id").alias("group_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group of near copies (the smallest doc_id), all columns kept.

    Groups are the connected components of texts that similar_pairs finds similar. Of a group's rows those stay that have its smallest
    doc_id and the text (of the least hash, if it has several there) that comes with it; a row with another text under the same id is judged by its own group.
    Rows that similar_pairs leaves out (NULL ids, no words) stay. Texts are only shuffled if they may be near copies.
    """
    held: list[str] = []
    real = _known(docs, doc_id, text)
    near = _near(real, threshold, n, held).select(F.col("tid").alias("doc_a"), F.col("other").alias("doc_b"))
    spent: list[str] = []
    group = durable(components(near, held).select(F.col("doc_id").alias("tid"), "group_id"), spent)
    heads = real.groupBy("tid").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    placed = heads.join(group, "tid", "left").withColumn("group_id", F.coalesce("group_id", "tid"))
    first = placed.groupBy("group_id").agg(F.min(F.struct("head", "tid")).alias("winner"), F.sum("n").alias("n")).filter("n > 1")
    gone = durable(placed.join(first, "group_id").select("tid", (F.col("tid") == F.col("winner.tid")).alias("stays"), F.col("winner.head").alias("head")), spent)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("key"), F.when(F.col(text).isNotNull() & F.col(doc_id).isNotNull(), F.xxhash64(text)).alias("tid"))
    maybe = maybe_in(gone, "tid")("tid")
    judged = keyed.filter(maybe).join(gone, "tid", "left").filter("stays IS NULL OR (stays AND key = head)")
    return keyed.filter(~maybe).select("row.*").unionAll(judged.select("row.*"))


def pairs_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for similar_pairs over documents, n = 1."""
    flat = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    return f"""
WITH t AS (SELECT text, min(doc_id) AS head FROM documents WHERE doc_id IS NOT NULL AND {flat} <> '' GROUP BY text),
g AS (SELECT DISTINCT head, unnest(string_split({flat}, ' ')) AS gram FROM t),
n AS (SELECT head, count(*) AS n FROM g GROUP BY head),
i AS (SELECT x.head AS a, y.head AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.head < y.head GROUP BY ALL),
p AS (SELECT a AS doc_a, b AS doc_b, common / (p.n + q.n - common)::DOUBLE AS jaccard FROM i JOIN n p ON p.head = a JOIN n q ON q.head = b
  UNION ALL SELECT head, doc_id, 1.0 FROM documents d JOIN t ON d.text = t.text WHERE doc_id <> head)
SELECT doc_a::BIGINT AS doc_a, doc_b::BIGINT AS doc_b, max(jaccard)::DOUBLE AS jaccard FROM p WHERE jaccard >= {threshold} GROUP BY ALL
"""


def classes_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for near_classes over documents, n = 1."""
    flat = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    return f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT text, min(doc_id) AS head, row_number() OVER (ORDER BY text) AS tid FROM d WHERE {flat} <> '' GROUP BY text),
g AS (SELECT DISTINCT tid, unnest(string_split({flat}, ' ')) AS gram FROM t),
n AS (SELECT tid, count(*) AS n FROM g GROUP BY tid),
i AS (SELECT x.tid AS a, y.tid AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.tid <> y.tid GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.tid = a JOIN n q ON q.tid = b WHERE common / (p.n + q.n - common)::DOUBLE >= {threshold}),
r AS (SELECT tid, tid AS other FROM t UNION SELECT r.tid, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT r.tid, min(o.head) AS class_id FROM r JOIN t o ON o.tid = r.other GROUP BY r.tid),
k AS (SELECT a AS tid, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(c.class_id, d.doc_id)::BIGINT AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.tid = t.tid LEFT JOIN k ON k.tid = t.tid
"""
