"""Hand-made histories: which changes belong to one function."""

import pandas as pd
import pytest

from tidemark.operators.genealogy import genealogy, genealogy_pandas

RANK = {"ADD": 1, "MOVE": 2, "MOD": 3, "DEL": 4}


def history(commits, rows):
    """commits: {id: parents}; rows: (commit, kind, id, new_id, previous)."""
    out = []
    for o, (c, ps) in enumerate(commits.items()):
        own = [r for r in rows if r[0] == c] or [(c, None, None, None, None)]
        for h, (_, kind, i, new, prev) in enumerate(own):
            out.append({"project": 0, "commit_id": c, "ord": o, "parents": ps, "hunk": h, "rank": RANK.get(kind, 0), "mod_type": kind, "id": i, "new_id": new, "previous": prev})
    got = genealogy_pandas(pd.DataFrame(out).astype({"mod_type": object, "previous": object}))
    return {(r.commit_id, r.id, r.mod_type): r.uid for r in got.itertuples()}


def test_a_renamed_function_stays_one():
    u = history({1: [], 2: [1], 3: [2], 4: [3]}, [(1, "ADD", "f", None, None), (2, "MOD", "f", None, 1), (3, "MOVE", "f", "g", 2), (4, "MOD", "g", None, 3)])
    assert len(set(u.values())) == 1 and len(u) == 4


def test_a_deleted_function_comes_back():
    u = history({1: [], 2: [1], 3: [2]}, [(1, "ADD", "f", None, None), (2, "DEL", "f", None, 1), (3, "ADD", "f", None, 2)])
    assert len(set(u.values())) == 1


def test_a_mod_after_a_deletion_is_dropped():
    u = history({1: [], 2: [1], 3: [2]}, [(1, "ADD", "f", None, None), (2, "DEL", "f", None, 1), (3, "MOD", "f", None, 2)])
    assert (3, "f", "MOD") not in u


def test_a_mod_of_the_old_name_on_the_same_line_is_dropped():
    u = history({1: [], 2: [1], 3: [2]}, [(1, "ADD", "f", None, None), (2, "MOVE", "f", "g", 1), (3, "MOD", "f", None, 2)])
    assert (3, "f", "MOD") not in u  # the old id counts as deleted on this line


def test_a_move_onto_an_existing_id_joins_both():
    u = history({1: [], 2: [1]}, [(1, "ADD", "f", None, None), (1, "ADD", "g", None, None), (2, "MOVE", "f", "g", 1)])
    assert len(set(u.values())) == 1


def test_branches_keep_apart_until_they_merge():
    commits = {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [4]}
    rows = [(2, "ADD", "f", None, 1), (3, "ADD", "f", None, 1), (3, "ADD", "h", None, 1), (5, "MOD", "f", None, 4), (5, "MOD", "h", None, 4)]
    u = history(commits, rows)
    assert u[2, "f", "ADD"] == u[3, "f", "ADD"] == u[5, "f", "MOD"] != u[5, "h", "MOD"] == u[3, "h", "ADD"]
    apart = history({1: [], 2: [1], 3: [1]}, rows[:3])
    assert len(set(apart.values())) == 3


def test_rows_of_a_merge_go_to_their_parent():
    commits = {1: [], 2: [1], 3: [1], 4: [2, 3]}
    u = history(commits, [(1, "ADD", "f", None, None), (2, "MOVE", "f", "g", 1), (4, "MOD", "g", None, 2), (4, "MOD", "x", None, 3)])
    assert u[4, "g", "MOD"] == u[1, "f", "ADD"] and (4, "x", "MOD") not in u


@pytest.mark.parametrize("both", [True, False])
def test_a_function_is_dead_after_a_merge_only_if_all_sides_say_so(both):
    commits = {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [4]}
    rows = [(1, "ADD", "f", None, None), (2, "DEL", "f", None, 1), (3, "DEL" if both else "MOD", "f", None, 1), (5, "ADD", "f", None, 4)]
    u = history(commits, rows)
    assert u[5, "f", "ADD"] == u[1, "f", "ADD"]


def test_on_spark(spark):
    commits = spark.createDataFrame([(0, 1, 0, []), (0, 2, 1, [1])], "project long, commit_id long, ord long, parents array<long>")
    changes = spark.createDataFrame([(1, 0, "ADD", "f", None, None), (2, 0, "MOVE", "f", "g", 1)], "commit_id long, hunk int, mod_type string, id string, new_id string, previous long")
    existing = spark.createDataFrame([(1, "z")], "commit_id long, id string")
    got = genealogy(commits, changes, existing).collect()
    assert len({r.uid for r in got}) == 1 and len(got) == 2


def test_many_projects_share_a_batch(spark):
    n = 300
    commits = spark.createDataFrame([(p, 2 * p, 0, [], None) for p in range(n)] + [(p, 2 * p + 1, 1, [2 * p], 2 * p) for p in range(n)], "project long, commit_id long, ord long, parents array<long>, previous long")
    changes = spark.createDataFrame([(2 * p, 0, "ADD", "f", None) for p in range(n)] + [(2 * p + 1, 0, "MOVE", "f", "g") for p in range(n)], "commit_id long, hunk int, mod_type string, id string, new_id string")
    out = genealogy(commits, changes)
    got = {}
    for r in out.collect():
        got.setdefault(r.project, []).append(r.uid)
    assert len(got) == n and all(len(u) == 2 and len(set(u)) == 1 for u in got.values())
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
