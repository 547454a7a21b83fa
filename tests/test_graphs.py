"""Hand-made commit graphs."""

import pandas as pd
import pytest

from tidemark.operators import dag as G
from tidemark.operators import windows as W

NAMES = "root A B C D E F G H I J K L M".split()
NUMBER = {n: i for i, n in enumerate(NAMES)}
#: child -> parent
EDGES = [e.split(">") for e in "A>root B>A C>B D>C E>D E>M F>E G>I G>F H>G I>J J>K K>A L>A M>L".split()]


def edges(spark):
    return spark.createDataFrame([(0, NUMBER[c], NUMBER[p]) for c, p in EDGES], "project long, child long, parent long")


def commits(spark):
    return spark.createDataFrame([(0, i, f"2020-01-{i + 1:02d}") for i in range(len(NAMES))], "project long, commit_id long, ts string")


@pytest.fixture(scope="module")
def reach(spark):
    return {(NAMES[r.descendant], NAMES[r.ancestor]) for r in G.closure(commits(spark), edges(spark)).collect()}


@pytest.mark.parametrize("child,ancestor,yes", [("J", "C", False), ("A", "A", True), ("H", "L", True), ("H", "root", True), ("B", "K", False), ("G", "M", True), ("root", "A", False), ("E", "L", True)])
def test_reachability(reach, child, ancestor, yes):
    assert ((child, ancestor) in reach) == yes


def test_closure_is_reflexive_and_transitive(reach):
    assert all((n, n) in reach for n in NAMES)
    assert all((a, d) in reach for a, b in reach for c, d in reach if b == c)


def test_walk_puts_parents_first(spark):
    place = {r.commit_id: r.ord for r in G.walk(commits(spark), edges(spark)).collect()}
    assert sorted(place.values()) == list(range(len(NAMES)))
    assert all(place[NUMBER[p]] < place[NUMBER[c]] for c, p in EDGES)


def test_branch_kinds(spark):
    kind = {NAMES[r.commit_id]: r.kind for r in G.branch_kinds(commits(spark), edges(spark)).collect()}
    assert kind["root"] == "root" and kind["E"] == "merge" and kind["G"] == "merge" and kind["B"] == "split" and kind["C"] == "continue"


def test_a_deep_chain_closes_without_recursion():
    n = 3000
    pdf = pd.DataFrame({"project": 0, "child": range(n), "parent": [None, *range(n - 1)]})
    assert len(G.closure_pandas(pdf)) == n * (n + 1) // 2


def test_snapshots_end_with_their_last_relevant_commit(spark):
    rows = spark.createDataFrame([(0, i, f"2020-01-0{1 + i // 3}", i % 2 == 0) for i in range(9)], "project long, commit_id long, ts string, is_c boolean").withColumnRenamed("commit_id", "ord")
    got = {r.ord: r.snapshot_index for r in W.snapshots(rows, rows.is_c, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1}


def test_days_always_grow(spark):
    rows = spark.createDataFrame([(0, i, d) for i, d in enumerate(["2020-01-05", "2020-01-05", "2020-01-04", "2020-01-09", "2020-01-08"])], "project int, i int, d string")
    days = [str(r.day) for r in W.increasing_days(rows.selectExpr("project", "i", "to_date(d) AS d"), "d", "project", "i").orderBy("i").collect()]
    assert days == ["2020-01-05", "2020-01-06", "2020-01-07", "2020-01-09", "2020-01-10"]


def test_moves_by_name_then_by_source(spark):
    from tidemark.operators.diffmap import moves_merged

    rows = [
        (1, 0, 0, "DEL", "a/f", "f", "a.c", 0, 9, 3, "int f() { return 1; }"), (1, 0, 1, "ADD", "b/f", "f", "b.c", 7, 0, 8, "something else"),
        (1, 0, 2, "DEL", "a/g", "g", "a.c", 0, 5, 20, "int g(int x) { return x + 1; }"), (1, 0, 3, "ADD", "a/h", "h", "a.c", 6, 0, 20, "int h(int x) { return x + 1; }"),
        (1, 0, 4, "DEL", "a/k", "k", "a.c", 0, 5, 40, "zzzzzzzz"), (1, 0, 5, "MOD", "a/m", "m", "a.c", 1, 1, 60, None), (2, 0, 0, "DEL", "a/f", "f", "a.c", 0, 9, 3, None),
    ]
    schema = "commit_id long, parent long, hunk int, mod_type string, id string, name string, file string, added int, deleted int, start int, source string"
    got = sorted((r.commit_id, r.mod_type, r.id, r.new_id, r.added, r.deleted) for r in moves_merged(spark.createDataFrame(rows, schema)).fillna("-").collect())
    assert got == [(1, "DEL", "a/k", "-", 0, 5), (1, "MOD", "a/m", "-", 1, 1), (1, "MOVE", "a/f", "b/f", 7, 9), (1, "MOVE", "a/g", "a/h", 6, 5), (2, "DEL", "a/f", "-", 0, 9)]


def test_moves_take_no_python_group_for_each_commit(spark):
    from tidemark.operators.diffmap import moves_merged

    schema = "commit_id long, parent long, hunk int, mod_type string, id string, name string, file string, added int, deleted int, start int, source string"
    both = [(7, 0, h, m, f"{m}{h}", "f", f"{h % 2}.c", h, h, h, "x") for m in ("DEL", "ADD") for h in range(40)]
    rows = both + [(c, 0, 0, "MOD", "m", "m", "a.c", 1, 1, 1, None) for c in range(100, 200)] + [(8, None, 0, "DEL", "a", "n", "a.c", 1, 1, 1, "y"), (8, None, 1, "ADD", "b", "n", "a.c", 1, 1, 1, "y")]
    out = moves_merged(spark.createDataFrame(rows, schema))
    got = out.collect()
    assert sorted((r.id, r.new_id) for r in got if r.mod_type == "MOVE") == sorted((f"DEL{h}", f"ADD{h}") for h in range(40))
    assert len(got) == 40 + 100 + 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "CoGroups" not in plan


def two_projects(spark):
    """The hand-made graph, and a copy of it in another project."""
    e = spark.createDataFrame([(p, 100 * p + NUMBER[c], 100 * p + NUMBER[q]) for p in (0, 1) for c, q in EDGES], "project long, child long, parent long")
    c = spark.createDataFrame([(p, 100 * p + i, i, i % 2 == 0) for p in (0, 1) for i in range(len(NAMES))], "project long, commit_id long, ord long, is_c boolean")
    return c, e


def test_ancestors_are_found_without_a_table_of_pairs(spark, reach):
    c, e = two_projects(spark)
    number = {(100 * p + NUMBER[d], 100 * p + NUMBER[a]) for d, a in reach for p in (0, 1)}
    starts, changes = [(p, 100 * p + i, i % 2) for p in (0, 1) for i in range(len(NAMES))], [(p, i % 2, 100 * p + i) for p in (0, 1) for i in range(0, len(NAMES), 3)]
    s = spark.createDataFrame([(*x, x[1] % 4 == 0) for x in starts], "project long, start_commit long, uid long, older boolean")
    x = spark.createDataFrame(changes, "project long, uid long, commit_id long")
    hits = {(u, d): {a for q, v, a in changes if v == u and (d, a) in number and a != d} for _, d, u in starts}
    nearest = G.nearest_changes(s, x, c, e)
    assert {(r.uid, r.start_commit, r.commit_id) for r in nearest.collect()} == {(u, d, a) for (u, d), h in hits.items() for a in h if not any((o, a) in number and o != a for o in h)}
    indexed = W.c_index(c)
    at = {r.commit_id: r.c_position for r in indexed.collect()}
    ages = G.ages_by_project(s, x, indexed, e)
    want = {(u, d): (max(at[d] - at[a] for a in h), min(at[d] - at[a] for a in h)) if h else (None, None) if d % 4 == 0 else (0, 0) for (u, d), h in hits.items()}
    assert {(r.uid, r.start_commit): (r.age, r.last_edit) for r in ages.collect()} == want
    pairs = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (0, 3, 11), (0, None, 1), (0, 1, 100), (1, 105, 101)], "project long, a long, b long")
    related = G.related(pairs, c, e)
    assert {(r.a, r.b, r.descends, r.precedes, r.related) for r in related.collect()} == {(a, b, (a, b) in number, (b, a) in number, (a, b) in number or (b, a) in number) for _, a, b in pairs.collect()}
    listed = c.filter("commit_id % 100 IN (2, 3, 12)").select("project", "commit_id")
    mine = {r.commit_id for r in listed.collect()}
    first = G.without_listed_ancestor(listed, c, e)
    assert {r.commit_id for r in first.collect()} == {d for d in mine if not any((d, a) in number for a in mine - {d})}
    counts = G.listed_ancestors(c, listed, e)
    assert {r.commit_id: r.n for r in counts.collect()} == {d: sum((d, a) in number for a in mine) for d in at}
    apart = G.distances(indexed, e)
    assert {(r.descendant, r.ancestor): r.c_distance for r in apart.collect()} == {(d, a): at[d] - at[a] for d, a in number}
    for df in (nearest, ages, related, first, counts, apart):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
