"""Aggregations of change rows (AGG, SET, TOP and SMP operators)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.derived import is_mod_or_move, java_round
from tidemark.operators.shared import kept as _kept

def _mod() -> Column:
    return is_mod_or_move(F.col("mod_type"))


def _sum(c: str | Column) -> Column:
    return F.sum(c).cast("long")


def hunks_to_commits(hunks: DataFrame) -> DataFrame:
    """AGG1: hunks and line sums by function, gross size, commit and bug-fix flag."""
    return hunks.groupBy("signature", "file", "gross_loc", "commit_id", "bugfix").agg(
        F.count("hunk").alias("hunks"), _sum(F.col("added") - F.col("deleted")).alias("line_delta"), _sum("deleted").alias("lines_deleted"), _sum("added").alias("lines_added")
    )


def commits_to_snapshot(commits: DataFrame) -> DataFrame:
    """AGG2: by function; commits counts rows, so a commit with two gross sizes counts twice."""
    return commits.groupBy("signature", "file").agg(
        F.max("gross_loc").alias("gross_loc"), _sum("hunks").alias("hunks"), F.count("commit_id").alias("commits"), _sum("bugfix").alias("bugfixes"),
        _sum("line_delta").alias("line_delta"), _sum("lines_deleted").alias("lines_deleted"), _sum("lines_added").alias("lines_added"),
    )


def window_measures(changes: DataFrame) -> DataFrame:
    """AGG3, AGG4: distinct commits and line sums of MOD and MOVE rows by function and snapshot."""
    return changes.groupBy("uid", "snapshot_index").agg(
        F.count_distinct(F.when(_mod(), F.col("commit_id"))).alias("commits"),
        _sum(F.when(_mod(), F.col("added")).otherwise(0)).alias("lines_added"),
        _sum(F.when(_mod(), F.col("deleted")).otherwise(0)).alias("lines_deleted"),
        _sum(F.when(_mod(), F.col("added") + F.col("deleted")).otherwise(0)).alias("lines_changed"),
    )


def change_stats(changes: DataFrame, parts: int | None = None) -> DataFrame:
    """AGG5: commits count all rows, line sums skip ADD and DEL. A function's rows of one commit are summed first; parts: partitions after that."""
    lines = changes.groupBy("commit_id", "uid").agg(_sum(F.when(_mod(), F.col("added") + F.col("deleted")).otherwise(0)).alias("lines"))
    return (lines.repartition(parts, "uid") if parts else lines).groupBy("uid").agg(F.count("commit_id").alias("commits"), _sum("lines").alias("lines_changed"))


def history(changes: DataFrame, parts: int | None = None) -> DataFrame:
    """AGG6 before each snapshot in which a function was changed (history_before with those starts): changes are shuffled by function once."""
    first = F.min(F.when(_mod(), F.col("snapshot_index"))).over(Window.partitionBy("commit_id", "uid"))
    lines = changes.withColumn("new", _mod() & (F.col("snapshot_index") == first))
    own = lines.groupBy("commit_id", "uid", "snapshot_index").agg(F.max(F.col("new").cast("int")).alias("new"), _sum(F.when(_mod(), F.col("added") + F.col("deleted"))).alias("lines"))
    sums = (own.repartition(parts, "uid") if parts else own).groupBy("uid", F.col("snapshot_index").alias("start")).agg(_sum("new").alias("new"), _sum("lines").alias("lines"))
    earlier = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    known = lambda c: F.coalesce(F.sum(F.when(F.col("start").isNotNull(), F.col(c))).over(earlier), F.lit(0))
    return sums.select("uid", "start", known("new").alias("previous_commits"), known("lines").alias("previous_lines"))


def history_before(changes: DataFrame, starts: DataFrame) -> DataFrame:
    """AGG6: distinct commits and changed lines of a function before each of its window starts (uid, start).

    A commit counts from the first snapshot in which it changed the function: so the distinct count before a start is a sum over
    first occurrences, and both sums are running sums over the function's own snapshots.
    """
    real = changes.filter(_mod())
    first = real.groupBy("uid", "commit_id").agg(F.min("snapshot_index").alias("at")).groupBy("uid", "at").agg(F.count(F.lit(1)).alias("new"))
    lines = real.groupBy("uid", F.col("snapshot_index").alias("at")).agg(_sum(F.col("added") + F.col("deleted")).alias("lines"))
    events = first.select("uid", "at", "new", F.lit(0).cast("long").alias("lines"), F.lit(False).alias("start")).unionByName(
        lines.select("uid", "at", F.lit(0).cast("long").alias("new"), "lines", F.lit(False).alias("start"))
    )
    marks = starts.select("uid", F.col("start").alias("at"), F.lit(0).cast("long").alias("new"), F.lit(0).cast("long").alias("lines"), F.lit(True).alias("start"))
    earlier = Window.partitionBy("uid").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    return (
        events.unionByName(marks)
        .withColumn("previous_commits", F.coalesce(F.sum("new").over(earlier), F.lit(0)))
        .withColumn("previous_lines", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
        .filter("start")
        .select("uid", F.col("at").alias("start"), "previous_commits", "previous_lines")
    )


def word_counts(messages: DataFrame, words: Column) -> DataFrame:
    """AGG7"""
    return messages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def commits_per_file(changes: DataFrame) -> DataFrame:
    """AGG8: distinct commits by file name."""
    return changes.select("file", "commit_id").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("commits"))


def ordered_changes(changes: DataFrame) -> DataFrame:
    """AGG9, SRT3: a commit's changes in order of hunk and kind of change."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("ADD", "MOVE", "MOD", "DEL")]), F.col("mod_type"))
    rows = F.sort_array(F.collect_list(F.struct("hunk", rank.alias("rank"), "uid", "mod_type")))
    return changes.groupBy("commit_id").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r.hunk, r.mod_type, r.uid)), " ").alias("changes"))


def upper_fraction_threshold(rows: DataFrame, value: str, fraction: float, by: list[str]) -> DataFrame:
    """AGG16: the score from which on the upper `fraction` of all scores lie."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.least(F.greatest(n - java_round(n * fraction), F.lit(0)), n - 1)
    return rows.withColumn("r", F.row_number().over(w) - 1).withColumn("at", at).filter("r = at").select(*by, F.col(value).alias("threshold"))


def large_threshold(rows: DataFrame, value: str, percent: float, by: list[str]) -> DataFrame:
    """AGG17: the size from which on files are among the largest `percent` percent."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.least(java_round(n - n * percent / 100), n - 1)
    return rows.withColumn("r", F.row_number().over(w) - 1).withColumn("at", at).filter("r = at").select(*by, F.col(value).alias("threshold"))


def averages(rows: DataFrame, value: str, by: list[str], digits: int = 4) -> DataFrame:
    """AGG18, ST11: mean, median, extremes, and the values of least and greatest size."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.round(F.avg(v), digits).alias("mean"), F.round(F.median(v), digits).alias("median"), F.round(F.min(v), digits).alias("min"), F.round(F.max(v), digits).alias("max"),
        F.round(F.min(F.abs(v)), digits).alias("absmin"), F.round(F.max(F.abs(v)), digits).alias("absmax"),
    )


def mean_sd_se(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AGG19"""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.stddev_samp(v) / F.sqrt(F.count(v)), 6).alias("se")
    )


def binary_stats(rows: DataFrame, flag: Column) -> DataFrame:
    """AGG20: counts, odds and likelihood of a flag."""
    yes, no = F.count_if(flag), F.count_if(~flag)
    return rows.agg(no.alias("n_false"), yes.alias("n_true"), F.round(F.try_divide(yes, no), 6).alias("odds"), F.round(F.try_divide(yes, yes + no), 6).alias("likelihood"))


def metric_stats(rows: DataFrame, values: list[str]) -> DataFrame:
    """AGG21: mean, median and sd of several variables."""
    long = rows.select(*[F.col(v).cast("double").alias(v) for v in values]).unpivot([], values, "variable", "value")
    return long.groupBy("variable").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def ratios_by_level(rows: DataFrame, level: str, dependent: str, scale: str | None, by: str) -> DataFrame:
    """AGG22: a dependent sum over its scale for level 0, 1, and 2 or more, by window."""
    marks = {"none": F.col(level) == 0, "one": F.col(level) == 1, "more": F.col(level) >= 2}
    whole = lambda c: F.count_if(c) if scale == "COUNT" else F.sum(F.when(c, F.col(scale))) if scale else F.lit(1)
    wide = rows.groupBy(by).agg(*[F.round(F.try_divide(F.sum(F.when(c, F.col(dependent))).cast("double"), whole(c)), 6).alias(k) for k, c in marks.items()])
    return wide.unpivot([by], list(marks), "marker", "value")


def box_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AGG25: five numbers and n."""
    p = F.percentile(F.col(value), F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), p.alias("p")).select(*by, "n", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("low", "q1", "mid", "q3", "high"))])


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """AGG24"""
    return rows.select(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def fold_averages(folds: DataFrame, by: list[str]) -> DataFrame:
    """AGG28: mean and sd of p and effect over folds; the sd of one fold is 0."""
    mean = lambda c: F.round(F.avg(c), 6) + 0.0  # noqa: E731  (no negative zero)
    sd = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6)
    return folds.groupBy(*by).agg(mean("p").alias("p"), sd("p").alias("sd_p"), mean("effect").alias("effect"), sd("effect").alias("sd_effect"))


def contingency(files: DataFrame, by: str, predicates: dict[str, str]) -> DataFrame:
    """AGG14, AGG15: for each group and smell predicate the 2x2 table against fixes, fix sums and sizes.

    All predicates of a row are taken in one pass: rows are exploded to (predicate, holds) and aggregated once.
    """
    marks = F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(v).alias("smelly")) for k, v in predicates.items()])
    rows = files.withColumn("m", F.explode(marks)).select(by, "m.metric", "m.smelly", (F.col("fixes") > 0).alias("fixed"), "fixes", "sloc")
    s, f = F.col("smelly"), F.col("fixed")
    mean = lambda c: java_round(F.avg(F.when(c, F.col("sloc"))))
    median = lambda c: java_round(F.median(F.when(c, F.col("sloc"))))
    return rows.groupBy(by, "metric").agg(
        F.count_if(s & f).alias("fs"), F.count_if(~s & f).alias("fns"), F.count_if(s & ~f).alias("nfs"), F.count_if(~s & ~f).alias("nfns"),
        _sum(F.when(s, F.col("fixes")).otherwise(0)).alias("fixes_smelly"), _sum(F.when(~s, F.col("fixes")).otherwise(0)).alias("fixes_clean"),
        mean(s).alias("mean_sloc_smelly"), mean(~s).alias("mean_sloc_clean"), median(s).alias("median_sloc_smelly"), median(~s).alias("median_sloc_clean"),
    )


def numbered(rows: DataFrame, order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 in order, without one task that sees them all: ranges are sorted apart, their sizes added up first."""
    keyed = rows.repartitionByRange(*([parts] if parts else []), *order).withColumn("part_", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    placed = _kept(keyed.withColumn("at_", within))
    sizes = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    offsets = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "before_")
    return placed.join(offsets, "part_").withColumn(name, F.col("at_") + F.col("before_")).drop("part_", "at_", "before_")


def resized(rows: DataFrame, by: list[str], size: int, order: list[Column]) -> DataFrame:
    """SMP2: exactly `size` rows of each group: the first ones in order, or, from a smaller group, its rows again and again (copy counts from 0)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = rows.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("n_", n).filter(F.col("r_") < size)
    times = F.floor((F.lit(size - 1) - F.col("r_")) / F.col("n_")).cast("long")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("r_", "n_")


def top_features(features: DataFrame, percents: dict[str, float]) -> DataFrame:
    """TOP1: names among the top percent by any of the given measures; 0 percent takes none. Ties go by name."""
    n = features.count()
    taken = None
    for measure, p in percents.items():
        start = math.floor(n - n * p / 100 + 0.5)
        part = numbered(features.select(measure, "name"), [measure, "name"], "r").filter(F.col("r") > start).select("name")
        taken = part if taken is None else taken.unionByName(part)
    return taken.distinct()


def balanced(rows: DataFrame, flag: Column, order: list[Column]) -> DataFrame:
    """SMP3: as many rows of either class as the smaller one has, first in the given order. A larger class is numbered by ranges, not in one task."""
    rows = _kept(rows)
    counts = {r["flag_"]: r["c"] for r in rows.groupBy(flag.alias("flag_")).agg(F.count(F.lit(1)).alias("c")).collect()}
    out = rows.limit(0)
    for value, c in counts.items():
        own = rows.filter(flag.isNull() if value is None else flag == F.lit(value))
        if c > min(counts.values()):
            own = numbered(own, order, "rank_").filter(F.col("rank_") <= min(counts.values())).drop("rank_")
        out = out.unionByName(own)
    return out


def folds(rows: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """SMP5: rows dealt to max(1, floor(n / size)) folds in turn."""
    n = max(1, rows.count() // size)
    return numbered(rows, order, "fold").withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(n)).cast("long"))
