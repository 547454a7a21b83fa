"""Windows over ordered commits and snapshots (WIN operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshots(commits: DataFrame, relevant: Column, size: int, by: str = "project", order: str = "ord") -> DataFrame:
    """WIN1: windows that end with their size-th relevant commit; an unfinished last window is dropped."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(relevant, 1).otherwise(0)
    indexed = commits.withColumn("snapshot_index", F.floor(F.coalesce(F.sum(mark).over(earlier), F.lit(0)) / size).cast("int")).withColumn("rel_", mark)
    whole = F.sum("rel_").over(Window.partitionBy(by, "snapshot_index"))
    return indexed.withColumn("n_", whole).filter(F.col("n_") >= size).drop("rel_", "n_")


def snapshot_dates(windows: DataFrame, by: str = "project", order: str = "ord", ts: str = "ts") -> DataFrame:
    """WIN2: each snapshot's start commit and date, pushed forward to at least a day after the one before."""
    first = windows.groupBy(by, "snapshot_index").agg(F.min_by("commit_id", order).alias("start_commit"), F.min_by(F.to_date(ts), order).alias("d"))
    return increasing_days(first, "d", by, "snapshot_index").select(by, "snapshot_index", "start_commit", F.col("day").alias("snapshot_date"))


def increasing_days(rows: DataFrame, date: str, by: str, order: str) -> DataFrame:
    """WIN2, WIN10 in closed form: day_i = i + max over j <= i of (date_j - j)."""
    w = Window.partitionBy(by).orderBy(order)
    i = F.row_number().over(w)
    number = F.datediff(F.col(date), F.lit("1970-01-01"))
    slack = rows.withColumn("i_", i).withColumn("s_", number - F.col("i_"))
    top = F.max("s_").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return slack.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), (top + F.col("i_")).cast("int"))).drop("i_", "s_")


def sliding_starts(indexes: DataFrame, size: int, slide: int) -> DataFrame:
    """WIN3: first snapshots of all complete windows."""
    return indexes.agg(F.max("snapshot_index").alias("m")).select(F.explode(F.expr(f"CASE WHEN m + 1 >= {size} THEN sequence(0, m + 1 - {size}, {slide}) END")).alias("start"))


def window_sums(measures: DataFrame, size: int, slide: int) -> DataFrame:
    """WIN4, WIN5: sums over windows of snapshots for functions that exist at the first one.

    commits adds up the snapshots' distinct counts. Each row joins the few windows that hold it, so nothing is a range join.
    """
    top = measures.agg(F.max("snapshot_index").alias("top"))
    starts = F.expr(f"filter(sequence(snapshot_index - {size} + 1, snapshot_index), s -> s >= 0 AND s % {slide} = 0 AND s + {size} <= top + 1)")
    rows = measures.crossJoin(top).withColumn("start", F.explode(starts))
    return (
        rows.groupBy("uid", "start")
        .agg(F.max((F.col("snapshot_index") == F.col("start")).cast("int")).alias("exists"), F.sum("commits").alias("commits"), F.sum("lch").alias("lch"))
        .filter("exists = 1")
        .drop("exists")
    )


def c_index(commits: DataFrame, by: str = "project", order: str = "ord") -> DataFrame:
    """WIN6: position of a commit in the traversal, and how many C commits come before it."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.sum(F.col("is_c").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return commits.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("c_position", before)


def ages(starts: DataFrame, changes: DataFrame, distance: DataFrame, older: DataFrame) -> DataFrame:
    """WIN7, WIN8: AGE and LAST_EDIT of functions at start commits.

    starts: (uid, start_commit); changes: (uid, commit_id); older: starts that have an older entry of the function. AGE is the
    largest, LAST_EDIT the least C distance to an ancestor that changed the function (not the start itself); without
    one, NULL where an older entry exists and 0 elsewhere.
    """
    hits = starts.join(changes, "uid").join(distance, (F.col("start_commit") == F.col("descendant")) & (F.col("commit_id") == F.col("ancestor"))).filter("commit_id <> start_commit")
    found = hits.groupBy("uid", "start_commit").agg(F.max("c_distance").alias("age"), F.min("c_distance").alias("last_edit"))
    known = older.select("uid", "start_commit", F.lit(True).alias("older")).distinct()
    fallback = F.when(F.col("older"), F.lit(None)).otherwise(F.lit(0))
    return (
        starts.join(found, ["uid", "start_commit"], "left").join(known, ["uid", "start_commit"], "left")
        .select("uid", "start_commit", F.coalesce("age", fallback).cast("long").alias("age"), F.coalesce("last_edit", fallback).cast("long").alias("last_edit"))
    )


def branch_positions(commits: DataFrame, branch: str, order: str) -> DataFrame:
    """WIN9: positions within a branch once other commits than C commits are dropped; branches numbered by their first time."""
    kept = commits.filter("is_c")
    roots = kept.groupBy("project", branch).agg(F.min("ts").alias("root_ts"))
    number = F.dense_rank().over(Window.partitionBy("project").orderBy("root_ts", branch)).cast("long")
    position = F.row_number().over(Window.partitionBy("project", branch).orderBy(order)).cast("long")
    return kept.withColumn("branch_position", position).join(roots.withColumn("branch_number", number).drop("root_ts"), ["project", branch])
