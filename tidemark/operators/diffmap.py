"""From line edits and function spans to change rows (GR13 to GR21)."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.derived import similarity

COMMIT = ["commit_id", "parent"]
HUNK = "commit_id long, parent long, hunk int, mod_type string, id string, name string, file string, added int, deleted int, new_id string, new_file string"
#: Sources from this similarity on may be one function's (FN1, JN11).
SIMILAR = 0.6


def classified_diffs(diffs: DataFrame) -> DataFrame:
    """GR19: what a file diff is: ADD, DEL, RENAME or EDIT, by its C sides; diffs without a C side are dropped."""
    old, new = F.col("old_path").rlike(r"\.[cC]$"), F.col("new_path").rlike(r"\.[cC]$")
    has = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(has(old) & has(new), F.when(F.col("old_path") == F.col("new_path"), "EDIT").otherwise("RENAME")).when(has(new), "ADD").when(has(old), "DEL")
    return diffs.withColumn("kind", kind).filter("kind IS NOT NULL")


def shifted_starts(edits: DataFrame) -> DataFrame:
    """GR18: where each edit starts on the A side once the edits before it are applied: begin_a + what they added."""
    earlier = Window.partitionBy(*COMMIT, "file").orderBy("edit_no").rowsBetween(Window.unboundedPreceding, -1)
    grown = (F.col("end_b") - F.col("begin_b")) - (F.col("end_a") - F.col("begin_a"))
    return edits.withColumn("adjusted_a", F.col("begin_a") + F.coalesce(F.sum(grown).over(earlier), F.lit(0)))


def pseudo_changes(appeared: DataFrame, disappeared: DataFrame, treated: DataFrame) -> DataFrame:
    """GR16: ADD and DEL rows (hunk -1) of functions that came or went without an edit of their own."""
    key = [*COMMIT, "id", "mod_type"]
    rows = appeared.withColumn("mod_type", F.lit("ADD")).unionByName(disappeared.withColumn("mod_type", F.lit("DEL")))
    left = rows.join(treated.select(*key), key, "left_anti")
    lines = F.col("loc")
    return left.select(
        *COMMIT, F.lit(-1).alias("hunk"), "mod_type", "id", F.when(F.col("mod_type") == "ADD", lines).otherwise(0).alias("added"), F.when(F.col("mod_type") == "DEL", lines).otherwise(0).alias("deleted")
    )


def signature_changes(sides: DataFrame) -> DataFrame:
    """GR15: edits whose signature part touches exactly one function on either side.

    The same id on both sides is a MOD with the sides' lines summed; the same name under another id is a MOVE; other edits
    aren't signature changes. sides: (commit_id, parent, file, edit_no, side, id, name, lines).
    """
    key = [*COMMIT, "file", "edit_no"]
    one = sides.groupBy(*key).agg(
        F.count_if(F.col("side") == "A").alias("na"), F.count_if(F.col("side") == "B").alias("nb"),
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s.lower()}") for s in "AB" for c in ("id", "name", "lines")],
    ).filter("na = 1 AND nb = 1")
    kind = F.when(F.col("id_a") == F.col("id_b"), "MOD").when(F.col("name_a") == F.col("name_b"), "MOVE")
    return one.withColumn("mod_type", kind).filter("mod_type IS NOT NULL").select(*key, "mod_type", "id_a", "id_b", F.col("lines_a").alias("deleted"), F.col("lines_b").alias("added"))


def merged_mods(changes: DataFrame) -> DataFrame:
    """GR21: the MOD rows of a function in one edit are summed; other rows pass."""
    key = [*COMMIT, "file", "edit_no", "id"]
    mods = changes.filter("mod_type = 'MOD'").groupBy(*key).agg(F.sum("added").cast("int").alias("added"), F.sum("deleted").cast("int").alias("deleted")).withColumn("mod_type", F.lit("MOD"))
    return changes.filter("mod_type <> 'MOD'").select(*key, "added", "deleted", "mod_type").unionByName(mods)


def match_moves(gone: list[dict], came: list[dict], similar: dict[tuple[str, str], float]) -> list[tuple[int, int]]:
    """GR13: pairs (place of a DEL, place of an ADD) of one commit and parent that are moves.

    Functions of one name first: within a file the ADD that starts where the DEL was, then the first one there, then what is left in
    order. Then functions of other names whose sources are similar (by the ids of a DEL and an ADD), the most similar first; a name is used once. Ties go by file
    and id.
    """
    last = lambda x: (x is None, "" if x is None else x)
    order = lambda rows: sorted(rows, key=lambda r: (last(r["file"]), last(r["hunk"]), last(r["id"])))
    gone, came = order(gone), order(came)
    pairs, used, taken = [], set(), set()
    named: dict[str, tuple[list, list]] = {}
    for side, rows in enumerate((gone, came)):
        for r in rows:
            if r["name"] is not None:
                named.setdefault(r["name"], ([], []))[side].append(r)
    for dels, adds in named.values():
        # Each test is a queue of ADDs by what it compares, so that many functions of one name aren't compared all with all.
        for key in (lambda r: (r["file"], r["start"]), lambda r: r["file"], lambda r: 0):
            queues: dict = {}
            for x in adds:
                if x["at"] not in used:
                    queues.setdefault(key(x), deque()).append(x["at"])
            for d in dels:
                if d["at"] not in taken and (queue := queues.get(key(d))):
                    hit = queue.popleft()
                    used.add(hit)
                    taken.add(d["at"])
                    pairs.append((d["at"], hit))
    partners: dict[str, list[str]] = {}
    for d, a in similar:
        partners.setdefault(d, []).append(a)
    place = {r["at"]: i for i, r in enumerate(came)}
    adds: dict[str, list[dict]] = {}
    for r in came:
        if r["at"] not in used:
            adds.setdefault(r["id"], []).append(r)
    fuzzy = [
        (-similar[d["id"], i], last(d["file"]), last(d["id"]), last(a["file"]), last(a["id"]), n, place[a["at"]], d, a)
        for n, d in enumerate(gone) if d["at"] not in taken for i in partners.get(d["id"], ()) for a in adds.get(i, ())
    ]
    names: set[tuple[str, str]] = set()
    for *_, d, a in sorted(fuzzy, key=lambda x: x[:7]):
        if ("d", d["name"]) in names or ("a", a["name"]) in names or a["at"] in used or d["at"] in taken:
            continue
        names |= {("d", d["name"]), ("a", a["name"])}
        used.add(a["at"])
        taken.add(d["at"])
        pairs.append((d["at"], a["at"]))
    return pairs


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("d", T.IntegerType()), T.StructField("a", T.IntegerType())])))
def _matches(commits: pa.Array) -> pa.Array:
    """match_moves of each commit; NULL for one in which nothing can match."""
    out = []
    for c in commits.to_pylist():
        if c is None:
            out.append(None)
            continue
        similar: dict[tuple[str, str], float] = {}
        for s in c["scored"]:
            similar[s["deleted"], s["added"]] = max(s["similarity"], similar.get((s["deleted"], s["added"]), 0.0))
        out.append([{"d": d, "a": a} for d, a in match_moves(c["gone"], c["came"], similar)])
    return pa.array(out, pa.list_(pa.struct([("d", pa.int32()), ("a", pa.int32())])))


def moves_merged(changes: DataFrame) -> DataFrame:
    """GR13: change rows in which matching ADD and DEL rows of a commit and parent have become one MOVE.

    changes: HUNK's columns up to deleted, with start and source. The rows of a commit and parent are brought together once, as an array; similar
    sources are scored there by the JVM (their lengths rule most pairs out), and only commits in which a DEL and an ADD have a name in common or
    similar sources go through the greedy choice.
    """
    plain = [c.split()[0] for c in HUNK.split(", ")[2:-2]]
    kind = lambda m: lambda r: r.mod_type == m
    row = F.struct(*plain, "start", F.coalesce("source", F.lit("")).alias("source"))
    rows = changes.repartition(*COMMIT).groupBy(*COMMIT).agg(F.collect_list(row).alias("all_"))
    side = lambda m: F.filter(F.transform("all_", lambda r, i: F.struct(i.alias("at"), *[r[c].alias(c) for c in ("mod_type", "name", "file", "hunk", "start", "id", "source")])), kind(m))
    known = F.col("commit_id").isNotNull() & F.col("parent").isNotNull() & F.exists("all_", kind("DEL")) & F.exists("all_", kind("ADD"))
    sides = rows.withColumns({"gone_": F.when(known, side("DEL")), "came_": F.when(known, side("ADD"))})

    def scores(d: Column) -> Column:
        """What of the ADDs is similar to a DEL."""
        short = lambda a: F.least(F.length(d.source), F.length(a.source)) / F.greatest(F.length(d.source), F.length(a.source), F.lit(1))
        near = F.transform(F.filter("came_", lambda a: short(a) >= SIMILAR), lambda a: F.struct(d.id.alias("deleted"), a.id.alias("added"), similarity(d.source, a.source).alias("similarity")))
        return F.filter(near, lambda s: s.similarity >= SIMILAR)

    scored = sides.withColumn("scored_", F.flatten(F.transform("gone_", scores)))
    may = (F.size("scored_") > 0) | F.arrays_overlap(F.transform("gone_", lambda r: r["name"]), F.transform("came_", lambda r: r["name"]))
    bare = lambda c: F.transform(c, lambda r: r.dropFields("source", "mod_type"))
    asked = F.when(may, F.struct(bare("gone_").alias("gone"), bare("came_").alias("came"), F.col("scored_").alias("scored")))
    matched = scored.select(*COMMIT, "all_", asked.alias("asked_")).withColumn("pairs_", _matches("asked_"))
    none = F.lit(None).cast("string")
    at = lambda i: F.element_at("all_", i + 1)
    spent = lambda i: F.array_contains(F.concat(F.transform("pairs_", lambda p: p.d), F.transform("pairs_", lambda p: p.a)), i)
    left = F.filter("all_", lambda r, i: F.coalesce(~spent(i), F.lit(True)))
    kept = F.transform(left, lambda r: F.struct(*[r[c].alias(c) for c in plain], none.alias("new_id"), none.alias("new_file")))

    def move(p: Column) -> Column:
        own = {"mod_type": F.lit("MOVE"), "added": at(p.a).added}
        return F.struct(*[own.get(c, at(p.d)[c]).alias(c) for c in plain], at(p.a).id.alias("new_id"), at(p.a).file.alias("new_file"))

    moved = F.coalesce(F.transform("pairs_", move), F.array().cast(f"array<struct<{', '.join(c.replace(' ', ': ') for c in HUNK.split(', ')[2:])}>>"))
    out = matched.select(*COMMIT, F.explode(F.concat(kept, moved)).alias("r_"))
    return out.select(*COMMIT, *[f"r_.{c}" for c in (*plain, "new_id", "new_file")])


def reattributed(changes: DataFrame) -> DataFrame:
    """GR14: MODs around a MOVE of their function: those after it belong to the new function, those before to the old.

    A MOD that several moves match comes once for each.
    """
    moves = changes.filter("mod_type = 'MOVE'").select(*[F.col(c).alias(f"m_{c}") for c in COMMIT], F.col("hunk").alias("at"), F.col("id").alias("old"), F.col("new_id").alias("new"))
    mods = changes.filter("mod_type = 'MOD'")
    same = (F.col("m_commit_id") == F.col("commit_id")) & F.col("m_parent").eqNullSafe(F.col("parent"))
    late = same & (F.col("id") == F.col("old")) & (F.col("hunk") > F.col("at"))
    early = same & (F.col("id") == F.col("new")) & (F.col("hunk") < F.col("at"))
    after = mods.join(moves, late).withColumn("id", F.col("new")).select(*changes.columns)
    before = mods.join(moves, early).withColumn("id", F.col("old")).select(*changes.columns)
    kept = mods.join(moves, late, "left_anti").join(moves, early, "left_anti")
    return changes.filter("mod_type <> 'MOD'").unionByName(kept).unionByName(after).unionByName(before)
