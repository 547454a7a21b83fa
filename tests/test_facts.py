"""The joint table on a small history worked out by hand."""

from tidemark.operators.facts import METRICS, joint_data


def test_joint_data(spark):
    m = ", ".join(f"{c} int" for c in METRICS)
    existing = spark.createDataFrame([(1, s, "f()" if s < 2 else "g()", "a.c", *range(8)) for s in range(3)] + [(2, 1, "h()", "b.c", *range(8))], f"uid long, snapshot_index int, signature string, file string, {m}")
    changes = spark.createDataFrame(
        [(1, 10, 0, "ADD", 5, 0), (1, 11, 0, "MOD", 2, 1), (1, 11, 0, "MOD", 1, 1), (1, 20, 1, "MOVE", 3, 0), (1, 31, 2, "MOD", 1, 1), (2, 21, 1, "MOD", 4, 4), (2, 31, 2, "MOD", 9, 9), (3, 11, 0, "MOD", 7, 7)],
        "uid long, commit_id long, snapshot_index int, mod_type string, added int, deleted int",
    )
    snapshots = spark.createDataFrame([(0, "2020-01-01", 10), (1, "2020-02-01", 20), (2, "2020-03-01", 30)], "snapshot_index int, snapshot_date string, start_commit long")
    line = [10, 11, 20, 21, 30, 31]
    distance = spark.createDataFrame([(d, a, i - j) for i, d in enumerate(line) for j, a in enumerate(line) if j <= i], "descendant long, ancestor long, c_distance long")
    got = {(r.function_uid, r.snapshot_index): r for r in joint_data(existing, changes, snapshots, distance, window=2).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 1)}
    r = got[1, 0]
    assert (r.commits, r.lines_added, r.lines_deleted, r.lines_changed, r.previous_commits, r.age, r.last_edit, r.function_signature) == (2, 6, 2, 8, 0, 0, 0, "f()")
    r = got[1, 1]
    assert (r.commits, r.lines_changed, r.previous_commits, r.previous_lines_changed, r.age, r.last_edit) == (2, 5, 1, 5, 2, 1)
    r = got[2, 1]
    assert (r.commits, r.lines_changed, r.previous_commits, r.age) == (1, 8, 0, 0)  # the function doesn't exist at snapshot 2


def test_the_joint_table_needs_no_table_of_pairs(spark):
    from tidemark.plans.catalogue import QUERIES

    plan = QUERIES["joint_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ancestor" not in plan and "InPandas" not in plan
