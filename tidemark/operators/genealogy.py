"""Identity of functions across renames, branches and merges (GR7 to GR10, GR22, AGG31)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ancestry import by_project
from tidemark.operators.shared import kept as _kept


def equivalence_classes(pairs: DataFrame) -> DataFrame:
    """GR7: (id, class) of everything in pairs (a, b), class being the smallest id that is connected.

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of a chain's length.
    """
    edges = _kept(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _kept(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        spread = labels.join(near, "a").select("a", F.least("label", "l").alias("label"))
        jump = spread.select(F.col("a").alias("label"), F.col("label").alias("j"))
        new = _kept(spread.join(jump, "label", "left").select("a", F.coalesce("j", "label").alias("label")))
        if not new.join(labels.withColumnRenamed("label", "old"), "a").filter("label <> old").limit(1).count():
            return new.select(F.col("a").alias("id"), F.col("label").alias("class"))
        labels = new


class Classes:
    """Functions by number, and which of them are the same (union-find, the lower number stands for a class)."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def new(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, f: int) -> int:
        while self.up[f] != f:
            self.up[f] = self.up[self.up[f]]
            f = self.up[f]
        return f

    def join(self, f: int, g: int) -> None:
        low, high = sorted((self.root(f), self.root(g)))
        self.up[high] = low


class Line:
    """What one line of history knows: living functions by id, the last deletion note of each id, and its renames.

    A note is [function, commit, branch, deleted?]; a note that isn't `deleted` says that the commit left the id alive.
    """

    def __init__(self, name: int, classes: Classes, log: list[tuple], parents: tuple[Line, ...] = ()):
        self.name, self.classes, self.log, self.parents = name, classes, log, parents
        self.living: dict[str, int] = {}
        self.notes: dict[str, list] = {}
        self.renamed: dict[str, list[tuple]] = {}

    def copy(self) -> Line:
        other = Line(self.name, self.classes, self.log, self.parents)
        other.living, other.notes = dict(self.living), dict(self.notes)  # notes are replaced, never changed
        other.renamed = {k: list(v) for k, v in self.renamed.items()}
        return other

    def child(self, name: int) -> Line:
        """A new line that starts where this one ends."""
        other = Line(name, self.classes, self.log, (self,))
        other.living, other.notes = dict(self.living), dict(self.notes)
        return other

    def _note(self, key: str, f: int, commit: int, deleted: bool) -> None:
        self.notes[key] = [f, commit, self.name, deleted]

    def _alive(self, key: str, f: int, commit: int) -> None:
        self._note(key, f, commit, False)

    def _revive(self, key: str, commit: int) -> int | None:
        note = self.notes.get(key)
        if note is None:
            return None
        if note[3]:
            self._note(key, note[0], commit, False)
        return note[0]

    def _elsewhere(self, key: str) -> int | None:
        """The function of that id in the nearest line before this one."""
        queue, seen = list(self.parents), set()
        while queue:
            line = queue.pop(0)
            if id(line) in seen:
                continue
            if key in line.living:
                return line.living[key]
            seen.add(id(line))
            queue.extend(line.parents)
        return None

    def apply(self, row: dict) -> None:
        _KINDS[row["mod_type"]](self, row)

    def _assign(self, row: dict, f: int) -> None:
        self.log.append((row["commit_id"], row["hunk"], row["mod_type"], row["id"], f))

    def add(self, row: dict) -> None:
        key = row["id"]
        f = self.living.get(key)
        if f is None:
            f = self._revive(key, row["commit_id"])
            if f is None:
                f = self.classes.new()
                self._alive(key, f, row["commit_id"])
            self.living[key] = f
        else:
            self._alive(key, f, row["commit_id"])
        self._assign(row, f)

    def mod(self, row: dict) -> None:
        key, f = row["id"], self.living.get(row["id"])
        if f is None:
            note = self.notes.get(key)
            if note and note[3] and note[2] == self.name:
                return  # deleted earlier on this line
            f = next((self.living[new] for new, *_ in reversed(self.renamed.get(key, [])) if new in self.living), None)
            if f is None:
                f = self._revive(key, row["commit_id"])
                if f is None:
                    f = self._elsewhere(key)
                self.living[key] = f = self.classes.new() if f is None else f
        self._assign(row, f)
        self._alive(key, f, row["commit_id"])

    def move(self, row: dict) -> None:
        old, new, commit = row["id"], row["new_id"], row["commit_id"]
        if old == new:
            return self.mod(row)
        f, there = self.living.pop(old, None), self.living.get(new)
        again = f is None and there is not None and any(n == new for n, *_ in self.renamed.get(old, []))
        if not again:
            if f is None:
                f = there
                for key in (old, new):
                    if f is None:
                        f = self._revive(key, commit)
                if f is None:
                    f = self.classes.new()
            if there is not None and there != f:
                self.classes.join(there, f)  # two functions under one id are one
            self._assign(row, f)
            self.living[new] = f
            self._note(old, f, commit, True)
            self._alive(new, f, commit)
        self.renamed.setdefault(old, []).append((new, commit, row.get("previous")))

    def delete(self, row: dict) -> None:
        key = row["id"]
        f, note = self.living.pop(key, None), self.notes.get(key)
        if f is None:
            if note and note[3]:
                return
            f = self.classes.new()
        self._note(key, f, row["commit_id"], True)
        self._assign(row, f)

    def synchronise(self, actual: set[str]) -> None:
        """GR10: functions that really exist are created where missing, others go."""
        for key in set(self.living) - actual:
            del self.living[key]
        for key in sorted(actual - set(self.living)):
            self.living[key] = self.classes.new()


_KINDS = {"ADD": Line.add, "MOD": Line.mod, "MOVE": Line.move, "DEL": Line.delete}


def merged(name: int, before: list[Line], tips: list[int], rows: list[dict], older: Callable[[int, int], bool]) -> Line:
    """GR9, GR22: the line after a merge of lines that end at the commits `tips`.

    The merge commit's rows go to the line of their previous revision. Of an id's deletion notes those count that no other note's
    commit descends from; the id is dead if all of them say so. Functions that share a living id are the same.
    """
    sides = [line.copy() for line in before]
    for r in rows:
        side = next((s for s, t in zip(sides, tips) if t == r["previous"]), None)
        if side is None or (r["mod_type"] == "MOD" and r["id"] not in side.living):
            continue  # no such parent, or a MOD of a function that it doesn't have
        side.apply(r)
    out = Line(name, before[0].classes, before[0].log, tuple(before))
    notes: dict[str, list] = {}
    for s in sides:
        for key, note in s.notes.items():
            notes.setdefault(key, []).append(note)
    dead = set()
    for key, found in notes.items():
        commits = {n[1] for n in found}
        last = found if len(commits) == 1 else [n for n in found if not any(c != n[1] and older(n[1], c) for c in commits)] or found
        states = {n[3] for n in last}
        if len(states) == 1:
            out.notes[key] = last[-1]
            if states == {True}:
                dead.add(key)
    for s in sides:
        for key, f in s.living.items():
            if key not in dead:
                if key in out.living:
                    out.classes.join(out.living[key], f)
                else:
                    out.living[key] = f
    return out


def genealogy_pandas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Classes of one project's changes; rows: commits in `ord` with parents, and their changes or existing functions."""
    rows = pdf.sort_values(["ord", "hunk", "rank", "id"], kind="stable").to_dict("records")
    out = [(pdf["project"].iloc[0], *r) for r in assigned(rows)]
    return pd.DataFrame(out, columns=["project", "commit_id", "hunk", "mod_type", "id", "uid"])


def assigned(rows: Iterable[dict]) -> list[tuple]:
    """(commit_id, hunk, mod_type, id, uid) of one project's changes, from its rows in order."""
    parents: dict[int, list[int]] = {}
    changes: dict[int, list[dict]] = {}
    exists: dict[int, set[str]] = {}
    order: list[int] = []
    for r in rows:
        c = r["commit_id"]
        if c not in parents:
            order.append(c)
            parents[c] = [int(p) for p in (r["parents"] if r["parents"] is not None else [])]
        if r["mod_type"] == "EXISTS":
            exists.setdefault(c, set()).add(r["id"])
        elif r["mod_type"] is not None and r["mod_type"] == r["mod_type"]:
            changes.setdefault(c, []).append(r)
    kids: dict[int, int] = {}
    for ps in parents.values():
        for p in ps:
            kids[p] = kids.get(p, 0) + 1
    reach: dict[int, int] = {}
    number = {c: i for i, c in enumerate(order)}
    classes, log, lines = Classes(), [], {}
    for c in order:
        ps = [p for p in parents[c] if p in lines]
        reach[c] = (1 << number[c]) | sum_bits(reach[p] for p in ps)
        own = changes.get(c, [])
        if not ps:
            line = Line(c, classes, log)
        elif len(ps) == 1:
            line = lines[ps[0]] if kids[ps[0]] == 1 else lines[ps[0]].child(c)
        else:
            line = merged(c, [lines[p] for p in ps], ps, own, lambda a, b: bool(reach[b] >> number[a] & 1))
            own = []
        if c in exists:
            line.synchronise(exists[c])
        for r in own:
            line.apply(r)
        lines[c] = line
    return [(c, h, m, i, classes.root(f)) for c, h, m, i, f in log]


def sum_bits(sets: Iterable[int]) -> int:
    out = 0
    for s in sets:
        out |= s
    return out


def genealogy(commits: DataFrame, changes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """GR8: (project, commit_id, hunk, mod_type, id, uid): every change with the function it belongs to, across renames and merges.

    commits: (project, commit_id, ord, parents); changes: (commit_id, hunk, mod_type, id, new_id, previous; without it, commits have one for all their changes); existing: functions
    (commit_id, id) that exist at a snapshot's first commit. Within a commit rows go by hunk, kind (ADD, MOVE, MOD, DEL) and id. uid is a label
    within the project. The state is sequential, so a project is gone through by one task, many projects in a batch.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in ("ADD", "MOVE", "MOD", "DEL")]), F.col("mod_type"))
    whose = [] if "previous" in changes.columns else ["previous"]
    rows = changes.select("commit_id", "hunk", "mod_type", "id", "new_id", *([] if whose else ["previous"]))
    if existing is not None:
        rows = rows.unionByName(existing.select("commit_id", F.lit(-2).alias("hunk"), F.lit("EXISTS").alias("mod_type"), "id"), allowMissingColumns=True)
    joined = commits.select("project", "commit_id", "ord", "parents", *whose).join(rows, "commit_id", "left").withColumn("rank", rank)
    names = ["commit_id", "parents", "hunk", "mod_type", "id", "new_id", "previous"]

    def answer(g: dict[str, list]) -> Iterator[list]:
        out = assigned(dict(zip(names, r)) for r in zip(*(g[n] for n in names)))
        if out:
            yield [g["project"][: 1] * len(out), *zip(*out)]

    out = "project long, commit_id long, hunk int, mod_type string, id string, uid long"
    return by_project(joined.select("project", "ord", "rank", *names), answer, out, ("ord", "hunk", "rank", "id"))
