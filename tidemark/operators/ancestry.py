"""Questions about ancestors, answered project by project without a table of all pairs (GR1 to GR3, AGG30, JN10, WIN6 to WIN8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a batch on its way out of a worker holds, about.
PAIRS = 1 << 20
#: Kinds of rows that a project's group is made of.
COMMIT, EDGE, ASKED, LISTED = range(4)
_NONE = -(1 << 63)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first column; each holds as many as end in a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut or (held and last != keys[0]):
            if cut:
                held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


class Graph:
    """One project's commits by number, and what each reaches, itself included, as a bit set."""

    def __init__(self, child: list[int], parent: list[int | None], place: dict[int, int] | None = None):
        """place: commits by number where an order is asked for; others follow. Without one no commit comes before what it reaches."""
        parents: dict[int, set[int]] = {}
        for c, p in zip(child, parent):
            own = parents.get(c)
            if own is None:
                own = parents[c] = set()
            if p is not None:
                own.add(p)
                if p not in parents:
                    parents[p] = set()
        self.names: list[int] = []
        number = self.number = place or {}
        if place:
            self.names = [*place, *(c for c in parents if c not in place)]
            for i, c in enumerate(self.names):
                number[c] = i
        reach = self.reach = {}
        for start in parents:  # depth first without recursion: histories are deep
            if start in reach:
                continue
            stack = [start]
            while stack:
                c = stack[-1]
                open_ = [p for p in parents[c] if p not in reach]
                if open_ and c not in reach:
                    stack.extend(open_)
                    continue
                stack.pop()
                if c in reach:
                    continue
                if not place:
                    number[c] = len(self.names)
                    self.names.append(c)
                bits = 1 << number[c]
                for p in parents[c]:
                    bits |= reach[p]
                reach[c] = bits

    def mask(self, commits: list[int]) -> int:
        out = 0
        for c in commits:
            if c in self.number:
                out |= 1 << self.number[c]
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a descendant, number of an ancestor), in pieces."""
        n = len(self.names)
        width, step = (n + 7) // 8, max(1, PAIRS // max(1, n))
        for at in range(0, n, step):
            some = self.names[at : at + step]
            raw = b"".join(self.reach[c].to_bytes(width, "little") for c in some)
            d, a = np.nonzero(np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), width), axis=1, count=n, bitorder="little"))
            yield d + at, a


def by_project(rows: DataFrame, answer: Callable[[dict[str, list]], Iterator[list]], schema: str, order: tuple[str, ...] = ("kind",)) -> DataFrame:
    """answer() of each project's rows (their columns as lists, project the first), without a group function's cost for each project.

    Rows of many projects come in one batch, those of a project next to each other and in order (by default of their column kind); answer yields columns in the
    schema's order.
    """
    names = rows.columns
    types = [(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in (c.split() for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        size = 0
        for table in whole_groups(batches):
            keys = pc.fill_null(table.column(0), _NONE).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            columns = [c.to_pylist() for c in table.columns]
            for i, j in zip(starts, starts[1:]):
                for part in answer({n: c[i:j] for n, c in zip(names, columns)}):
                    out.append(part)
                    size += len(part[0])
                    if size >= PAIRS:
                        yield _batch(out, types)
                        out, size = [], 0
            if out:
                yield _batch(out, types)
                out, size = [], 0

    return rows.repartition("project").sortWithinPartitions("project", *order).mapInArrow(run, schema)


def _batch(parts: list[list], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = [pa.concat_arrays([pa.array(p[k], t) for p in parts]) for k, (_, t) in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in types])


def _rows(kind: int, df: DataFrame, **columns: str) -> DataFrame:
    """Rows of one kind: project and up to three numbers a to c. A NULL a names no commit."""
    rows = df.select(F.col("project").cast("long").alias("project"), F.lit(kind).alias("kind"), *[F.expr(columns.get(c, "NULL")).cast("long").alias(c) for c in "abc"])
    return rows if kind == ASKED else rows.filter("a IS NOT NULL")


def _asked(commits: DataFrame, edges: DataFrame, *more: DataFrame, **extra: str) -> DataFrame:
    rows = _rows(COMMIT, commits, a="commit_id", **extra).unionByName(_rows(EDGE, edges, a="child", b="parent"))
    for m in more:
        rows = rows.unionByName(m)
    return rows


def _split(g: dict[str, list]) -> list[int]:
    """Where the rows of each kind begin."""
    kinds, out = g["kind"], [0]
    for k in range(4):
        at = out[-1]
        out.append(at + kinds[at:].count(k))
    return out


def _graph(g: dict[str, list], s: list[int], place: dict[int, int] | None = None) -> Graph:
    commits = g["a"][: s[1]]
    return Graph(commits + g["a"][s[1] : s[2]], [None] * len(commits) + g["b"][s[1] : s[2]], place)


def _positions(g: dict[str, list], s: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """Commits numbered by their C position, and these positions."""
    at = {c: x for c, x in zip(g["a"][: s[1]], g["c"][: s[1]]) if x is not None}
    order = sorted(at, key=at.get)
    return {c: i for i, c in enumerate(order)}, at


def closure(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR1: (project, descendant, ancestor), each commit its own ancestor."""

    def answer(g: dict[str, list]) -> Iterator[list]:
        graph = _graph(g, _split(g))
        names = np.array(graph.names, np.int64)
        for d, a in graph.pairs():
            yield [[None] * len(d) if g["project"][0] is None else np.full(len(d), g["project"][0], np.int64), names[d], names[a]]

    return by_project(_asked(commits, edges), answer, "project long, descendant long, ancestor long")


def distances(indexed: DataFrame, edges: DataFrame) -> DataFrame:
    """WIN6: traversal distance and C distance of every (descendant, ancestor) pair of indexed commits (W.c_index)."""

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        place = dict(zip(g["a"][: s[1]], range(s[1])))
        graph = _graph(g, s, place)
        n = len(set(g["a"][: s[1]]))
        names, position, c_position = np.array(graph.names, np.int64), np.zeros(len(graph.names), np.int64), np.zeros(len(graph.names), np.int64)
        for c, x, y in zip(g["a"][: s[1]], g["b"], g["c"]):
            position[graph.number[c]], c_position[graph.number[c]] = x, y
        for d, a in graph.pairs():
            if n < len(names):  # commits that only an edge names have no place
                known = (d < n) & (a < n)
                d, a = d[known], a[known]
            yield [names[d], names[a], position[d] - position[a], c_position[d] - c_position[a]]

    return by_project(_asked(indexed, edges, b="position", c="c_position"), answer, "descendant long, ancestor long, distance long, c_distance long")


def related(pairs: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR2: for pairs (project, a, b): whether a descends from b, b from a, or either."""

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        graph = _graph(g, s)
        a, b = g["a"][s[2] : s[3]], g["b"][s[2] : s[3]]
        down = [x in graph.reach and y in graph.reach and bool(graph.reach[x] >> graph.number[y] & 1) for x, y in zip(a, b)]
        up = [x in graph.reach and y in graph.reach and bool(graph.reach[y] >> graph.number[x] & 1) for x, y in zip(a, b)]
        if a:
            yield [a, b, down, up, [x or y for x, y in zip(down, up)]]

    return by_project(_asked(commits, edges, _rows(ASKED, pairs, a="a", b="b")), answer, "a long, b long, descends boolean, precedes boolean, related boolean")


def without_listed_ancestor(listed: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR3: listed commits (project, commit_id) that have no other listed commit as an ancestor."""

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        graph, own = _graph(g, s), g["a"][s[3] :]
        mask = graph.mask(own)
        out = [c for c in own if not (graph.reach.get(c, 0) & mask & ~graph.mask([c]))]
        if out:
            yield [out]

    return by_project(_asked(commits, edges, _rows(LISTED, listed, a="commit_id")), answer, "commit_id long")


def listed_ancestors(commits: DataFrame, listed: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG30: how many of the listed commits (project, commit_id) are ancestors of each commit, itself included."""

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        graph, own = _graph(g, s), g["a"][: s[1]]
        mask = graph.mask(g["a"][s[3] :])
        if own:
            yield [own, [(graph.reach[c] & mask).bit_count() for c in own]]

    return by_project(_asked(commits, edges, _rows(LISTED, listed, a="commit_id")), answer, "commit_id long, n long")


def _changed(graph: Graph, uids: list, commits: list[int]) -> dict:
    """Bit set of the commits that changed each function."""
    out: dict = {}
    for u, c in zip(uids, commits):
        if u is not None and c in graph.number:
            out[u] = out.get(u, 0) | 1 << graph.number[c]
    return out


def nearest_changes(starts: DataFrame, changes: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """JN10: the newest changing ancestors of each start commit: those that no other changing ancestor descends from.

    starts: (project, uid, start_commit); changes: (project, uid, commit_id).
    """

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        graph = _graph(g, s)
        changed = _changed(graph, g["b"][s[3] :], g["a"][s[3] :])
        out: list[list] = [[], [], []]
        for start, uid in dict.fromkeys(zip(g["a"][s[2] : s[3]], g["b"][s[2] : s[3]])):
            left = changed.get(uid, 0) & graph.reach.get(start, 0) & ~graph.mask([start])
            while left:  # no commit comes before what it reaches: the last one is reached by no other
                c = graph.names[left.bit_length() - 1]
                left &= ~graph.reach[c]
                for column, x in zip(out, (uid, start, c)):
                    column.append(x)
        if out[0]:
            yield out

    asked = _asked(commits, edges, _rows(ASKED, starts, a="start_commit", b="uid"), _rows(LISTED, changes, a="commit_id", b="uid"))
    return by_project(asked, answer, "uid long, start_commit long, commit_id long")


def ages(starts: DataFrame, changes: DataFrame, indexed: DataFrame, edges: DataFrame) -> DataFrame:
    """WIN7, WIN8: AGE and LAST_EDIT of functions at start commits, see windows.ages.

    starts: (project, uid, start_commit, older); changes: (project, uid, commit_id); indexed: commits with c_position (W.c_index).
    """

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        place, at = _positions(g, s)
        known = list(place)
        graph = _graph(g, s, place)
        changed = _changed(graph, g["b"][s[3] :], [c if c in at else None for c in g["a"][s[3] :]])
        age, last = [], []
        for start, uid, older in zip(g["a"][s[2] : s[3]], g["b"][s[2] : s[3]], g["c"][s[2] : s[3]]):
            hits = changed.get(uid, 0) & graph.reach[start] & ~(1 << place[start]) if start in at else 0
            if hits:  # numbers follow C positions: the first and the last one are the farthest and the nearest
                age.append(at[start] - at[known[(hits & -hits).bit_length() - 1]])
                last.append(at[start] - at[known[hits.bit_length() - 1]])
            else:
                age.append(None if older else 0)
                last.append(age[-1])
        if age:
            yield [g["b"][s[2] : s[3]], g["a"][s[2] : s[3]], age, last]

    asked = _asked(indexed, edges, _rows(ASKED, starts, a="start_commit", b="uid", c="CAST(older AS INT)"), _rows(LISTED, changes, a="commit_id", b="uid"), c="c_position")
    return by_project(asked, answer, "uid long, start_commit long, age long, last_edit long")


def joint_rows(indexed: DataFrame, edges: DataFrame, snapshots: DataFrame, changes: DataFrame, window: int) -> DataFrame:
    """What windows and the time before did to functions (facts.joint_data), each project's tables being brought together once.

    A function exists from the first snapshot in which it was changed. indexed: commits with c_position; snapshots: (project, snapshot_index,
    start_commit); changes: (project, uid, commit_id, snapshot_index, mod_type, added, deleted), as far as they lie in a snapshot.
    """

    def answer(g: dict[str, list]) -> Iterator[list]:
        s = _split(g)
        place, at = _positions(g, s)
        known = list(place)
        graph, project = _graph(g, s, place), g["project"][0]
        starts = dict(zip(g["b"][s[2] : s[3]], g["a"][s[2] : s[3]]))
        n = len(starts)
        whole = [(i, at.get(starts[i]), graph.reach[starts[i]] & ~(1 << place[starts[i]]) if starts[i] in at else 0) for i in sorted(starts) if i + window <= n]
        functions: dict[int, list[tuple]] = {}
        for row in zip(g["b"][s[3] :], g["c"][s[3] :], g["a"][s[3] :], g["real"][s[3] :], g["added"][s[3] :], g["deleted"][s[3] :]):
            functions.setdefault(row[0], []).append(row)
        functions.pop(None, None)
        out = []
        for uid, rows in functions.items():
            born, hits_of = rows[0][1], 0
            first: dict[int, int] = {}
            per: dict[int, list] = {}  # by snapshot: commits, lines added, lines deleted
            for _, index, commit, real, added, deleted in rows:
                born = min(born, index)
                if commit in at:
                    hits_of |= 1 << place[commit]
                if real:
                    sums = per.setdefault(index, [set(), 0, 0])
                    sums[0].add(commit)
                    sums[1] += added or 0
                    sums[2] += deleted or 0
                    first[commit] = min(index, first.get(commit, index))
            for index, position, reach in whole:
                if index < born:
                    continue
                commits = plus = minus = before = lines = 0
                for k, (own, x, y) in per.items():
                    if k < index:
                        lines += x + y
                    elif k < index + window:
                        commits, plus, minus = commits + len(own), plus + x, minus + y
                for k in first.values():
                    before += k < index
                age = last = None if born < index else 0
                hits = hits_of & reach
                if hits:
                    age, last = position - at[known[(hits & -hits).bit_length() - 1]], position - at[known[hits.bit_length() - 1]]
                out.append((uid, index, age, last, commits, plus, minus, before, lines, project))
        if out:
            yield list(zip(*out))

    zero = {c: F.lit(None).cast("long") for c in ("real", "added", "deleted")}
    rows = _asked(indexed, edges, _rows(ASKED, snapshots, a="start_commit", b="snapshot_index"), c="c_position").withColumns(zero)
    own = changes.select(
        F.col("project").cast("long").alias("project"), F.lit(LISTED).alias("kind"), F.col("commit_id").cast("long").alias("a"), F.col("uid").cast("long").alias("b"),
        F.col("snapshot_index").cast("long").alias("c"), F.col("mod_type").isin("MOD", "MOVE").cast("long").alias("real"), F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"),
    )
    out = "uid long, snapshot_index int, age long, last_edit long, commits long, lines_added long, lines_deleted long, previous_commits long, previous_lines_changed long, project long"
    return by_project(rows.unionByName(own), answer, out)
