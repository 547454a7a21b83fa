"""The joint table: one row for each function and window of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rollups import history_before, window_measures
from tidemark.operators.windows import ages

METRICS = ["loc", "loac", "lofc", "fl", "fc_dup", "fc_nondup", "cnd", "neg"]


def joint_data(existing: DataFrame, changes: DataFrame, snapshots: DataFrame, distance: DataFrame, window: int = 10, slide: int = 1) -> DataFrame:
    """Functions existing at the first snapshot of each complete window, with what the window and the time before it did to them.

    With a column project in existing and snapshots, every project has snapshots of its own; uids are unique over all of them.
    existing: (uid, snapshot_index, signature, file, METRICS) at each snapshot's start; changes: (uid, commit_id, snapshot_index,
    mod_type, added, deleted); snapshots: (snapshot_index, snapshot_date, start_commit); distance: (descendant, ancestor,
    c_distance). Sums take MOD and MOVE rows, of later snapshots only where the function exists at their start; commits add up the
    snapshots' distinct counts. Metrics are those of the first snapshot, signature and file those of the function's first one.
    Functions that exist at no snapshot's start are dropped with their changes. AGE and LAST_EDIT count C commits back to the
    oldest and newest change before the start; without one, NULL if the function has an older entry, else 0.
    """
    if "project" not in existing.columns:
        existing, snapshots = existing.withColumn("project", F.lit(0)), snapshots.withColumn("project", F.lit(0))
    top = existing.groupBy("project").agg((F.max("snapshot_index") + 1).alias("n"))
    starts = F.expr(f"filter(sequence(snapshot_index - {window} + 1, snapshot_index), s -> s >= 0 AND s % {slide} = 0 AND s + {window} <= n)")
    known = changes.join(existing.select("uid").distinct(), "uid", "left_semi")
    measured = existing.select("project", "uid", "snapshot_index").join(window_measures(known), ["uid", "snapshot_index"], "left").fillna(0)
    spread = measured.join(top, "project").withColumn("start", F.explode(starts))
    sums = [F.sum(c).alias(c) for c in ("commits", "lines_changed", "lines_added", "lines_deleted")]
    first = F.max((F.col("snapshot_index") == F.col("start")).cast("int")).alias("there")
    totals = spread.groupBy("project", "uid", "start").agg(first, *sums).filter("there = 1").drop("there")
    before = history_before(known, totals.select("uid", "start"))
    heads = snapshots.select("project", F.col("snapshot_index").alias("start"), "snapshot_date", "start_commit")
    begun = totals.select("project", "uid", "start").join(heads, ["project", "start"]).drop("project")
    entries = existing.select("uid", F.col("snapshot_index").alias("at")).unionByName(known.select("uid", F.col("snapshot_index").alias("at"))).groupBy("uid").agg(F.min("at").alias("at"))
    older = begun.join(entries, "uid").filter(F.col("at") < F.col("start")).select("uid", "start_commit")
    aged = ages(begun.select("uid", "start_commit"), known.select("uid", "commit_id").distinct(), distance, older)
    names = existing.groupBy("uid").agg(F.min_by(F.struct("signature", "file"), "snapshot_index").alias("name"))
    at_start = existing.select("uid", F.col("snapshot_index").alias("start"), *METRICS)
    return (
        totals.join(begun, ["uid", "start"]).join(before, ["uid", "start"]).join(aged, ["uid", "start_commit"]).join(names, "uid").join(at_start, ["uid", "start"])
        .select(
            "snapshot_date", F.col("start").alias("snapshot_index"), F.col("uid").alias("function_uid"), F.col("name.signature").alias("function_signature"), F.col("name.file").alias("file"), "age", "last_edit",
            "commits", "lines_changed", "lines_added", "lines_deleted", "previous_commits", F.col("previous_lines").alias("previous_lines_changed"), *METRICS,
        )
    )
