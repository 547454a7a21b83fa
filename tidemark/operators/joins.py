"""Joins and set operations between snapshots, functions, edits and files (JN, SET operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.derived import similarity
from tidemark.operators.rollups import numbered
from tidemark.operators.shared import kept

KEY = ["signature", "file"]
#: Lines of a stretch of a file, while edits are joined with functions.
BIN = 256


def lookup_or_fail(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """JN1: rows with their commit's columns; a row whose commit is unknown is an error."""
    known = commits.withColumn("known_", F.lit(True))
    joined = rows.join(known, "commit_id", "left")
    ok = F.when(F.col("known_"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown commit "), F.col("commit_id").cast("string"))).cast("boolean"))
    return joined.filter(ok).drop("known_")


def full_coverage(functions: DataFrame, metrics: DataFrame, values: list[str]) -> DataFrame:
    """JN2, PRJ19: functions with their metrics, 0 where there are none; functions that only the metrics know stay."""
    m = metrics.select(*KEY, F.col("loc").alias("loc_"), *values)
    return functions.select(*KEY, "loc").join(m, KEY, "full_outer").select(*KEY, F.coalesce("loc_", "loc").alias("loc"), *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """Each function row of a snapshot next to that of the following snapshot, by (signature, file); either side may miss."""
    old = snapshots.select(F.col("snapshot_index").alias("older"), *KEY, F.struct("*").alias("old"))
    new = snapshots.select((F.col("snapshot_index") - 1).alias("older"), *KEY, F.struct("*").alias("new"))
    return old.join(new, ["older", *KEY], "full_outer")


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """JN3, JN4, SET2, PRJ20, FN16: functions before, now, identical, added, removed between snapshots, and how much sizes changed.

    One full outer join serves all counts of all snapshot pairs.
    """
    pairs = snapshot_pairs(snapshots)
    old, new = F.col("old").isNotNull(), F.col("new").isNotNull()
    change = F.when(old & new & (F.col("old.lch") > 0), F.try_divide(F.abs(F.col("old.lch") - F.col("new.lch")) * 100.0, F.col("old.lch").cast("double")))
    counts = pairs.groupBy("older").agg(
        F.count_if(old).alias("func_before"), F.count_if(new).alias("func_now"), F.count_if(old & new).alias("func_identical"), F.count_if(new & ~old).alias("func_added"),
        F.count_if(old & ~new).alias("func_removed"), F.round(F.median(change), 2).alias("median_perc_change"),
    )
    both = counts.filter("func_before > 0 AND func_now > 0")
    return both.withColumn("perc_add_rem", F.expr("((func_added + func_removed) * 100) DIV func_before"))


def added_functions(snapshots: DataFrame, parts: int) -> DataFrame:
    """JN4: functions that the snapshot before didn't have; the snapshots' rows are worked out once and compared in so many partitions."""
    rows, on = kept(snapshots.select("snapshot_index", *KEY)), ["snapshot_index", *KEY]
    before = rows.withColumn("snapshot_index", F.col("snapshot_index") + 1)
    return without(rows.filter("snapshot_index > 0").repartition(parts, *on), before.repartition(parts, *on), on)


def changed_metric(snapshots: DataFrame, metric: str) -> DataFrame:
    """JN5: functions in two snapshots in a row whose metric differs though they were changed in the older one."""
    old = snapshots.select((F.col("snapshot_index") + 1).alias("snapshot_index"), *KEY, F.col(metric).alias("old"), F.col("commits").alias("old_commits"))
    return snapshots.join(old.filter("old_commits > 0"), ["snapshot_index", *KEY]).filter(F.col(metric) != F.col("old")).select("snapshot_index", *KEY, "old", F.col(metric).alias("new"))


def overlaps(edits: DataFrame, spans: DataFrame) -> DataFrame:
    """JN9, FLT18, GR17: functions that an edit touches on the A side, how, and the lines that fall to each.

    An equi-join on the file and a stretch of BIN lines, so that a file of many edits and functions isn't joined all with all; a pair is taken in the
    stretch where the later of the two begins. Edits are 0-based and end-exclusive; the span [start1, end1] is
    1-based, so a function takes lines start1-1 to end1-1. An edit that starts inside a function and passes its end
    counts to end1-1.
    """
    begin, end, low, high = F.col("begin_a"), F.col("end_a"), F.col("start1") - 1, F.col("end1") - 1
    stretch = lambda c: F.floor(c / BIN).cast("long")
    lines = (
        F.when((begin <= low) & (end > high), high - low + 1)
        .when((begin >= low) & (end <= high), end - begin)
        .when(begin > low, high - begin)
        .otherwise(end - low)
    )
    return (
        edits.withColumn("bin_", F.explode(F.sequence(stretch(begin), stretch(F.greatest(begin, end)))))
        .join(spans.withColumn("bin_", F.explode(F.sequence(stretch(low), stretch(F.greatest(low, F.col("end1")))))), ["file", "bin_"])
        .filter((begin < F.col("end1")) & (end > low) & (F.col("bin_") == stretch(F.greatest(begin, low))))
        .select(
            "commit_id", "file", "begin_a", "end_a", "signature", lines.alias("lines"),
            ((begin <= low) & (end > high)).alias("covers"), ((begin < low + F.col("sig_loc")) & (end > low)).alias("touches_signature"),
        )
    )


def similar_moves(deleted: DataFrame, added: DataFrame, key: list[str], text: str, least: float = 0.6) -> DataFrame:
    """JN11: pairs of deleted and added functions of a commit whose sources are similar.

    Lengths rule most pairs out before the edit distance is computed: similarity is at most their ratio.
    """
    d = deleted.select(*key, F.col("id").alias("deleted"), F.col(text).alias("a"))
    a = added.select(*key, F.col("id").alias("added"), F.col(text).alias("b"))
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"), F.lit(1))
    return d.join(a, key).filter(short / long >= least).withColumn("similarity", similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least).drop("a", "b")


def same_name_moves(deleted: DataFrame, added: DataFrame, key: list[str], name: str) -> DataFrame:
    """JN12: deleted and added functions of a commit with one name."""
    return deleted.select(*key, name, F.col("id").alias("deleted")).join(added.select(*key, name, F.col("id").alias("added")), [*key, name]).select(*key, name, "deleted", "added")


def pivoted(rows: DataFrame, key: str, by: str, value: str, order: str, names: tuple[str, ...]) -> DataFrame:
    """JN7: the first value of each name side by side; a key without one of the names is dropped, but for the last name."""
    wide = rows.filter(F.col(by).isin(*names)).groupBy(key).pivot(by, list(names)).agg(F.min_by(value, order))
    return wide.dropna(subset=list(names[:-1]))


def rename_candidates(logged: DataFrame) -> DataFrame:
    """SRT7: distinct logged renames (old, new), those that only just stay within their threshold last; place numbers the order."""
    distance = F.levenshtein(F.lower("old"), F.lower("new")).cast("long")
    limit = F.greatest(F.lit(1), F.floor(F.least(F.length("old"), F.length("new")) / 3 + 0.5)).cast("long")
    rows = logged.distinct().withColumns({"distance": distance, "threshold": limit})
    return numbered(rows.withColumn("slack", F.col("threshold") - F.col("distance")), ["slack", "old", "new"], "place").drop("slack")


def by_basename(files: DataFrame, counts: DataFrame, count: str) -> DataFrame:
    """JN13: counts kept by bare file name, attached to full paths; 0 where there is none."""
    named = files.withColumn("name", F.substring_index("file", "/", -1))
    return named.join(counts, "name", "left").select("file", "name", F.coalesce(count, F.lit(0)).alias(count))


def without(rows: DataFrame, gone: DataFrame, on: list[str] | Column) -> DataFrame:
    """JN4, SET1, SET2, FLT17: rows that have no partner."""
    return rows.join(gone, on, "left_anti")


def moved_functions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SET3: under a file's rename, functions on both sides are moved, the others deleted or created."""
    o, n = old.select(*key, F.lit(1).alias("o")), new.select(*key, F.lit(1).alias("n"))
    status = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), "moved").when(F.col("o").isNotNull(), "deleted").otherwise("created")
    return o.join(n, key, "full_outer").select(*key, status.alias("status"))


def tracking_errors(computed: DataFrame, actual: DataFrame, key: list[str], by: str) -> DataFrame:
    """AGG12, SET4: functions matching, missing and superfluous by group, and their percentages of the actual ones."""
    c, a = computed.select(*key, F.lit(1).alias("c")).distinct(), actual.select(*key, F.lit(1).alias("a")).distinct()
    has_c, has_a = F.col("c").isNotNull(), F.col("a").isNotNull()
    counts = c.join(a, key, "full_outer").groupBy(by).agg(
        F.count_if(has_c & has_a).alias("matching"), F.count_if(has_a & ~has_c).alias("missing"), F.count_if(has_c & ~has_a).alias("superfluous")
    )
    whole = F.col("matching") + F.col("missing")
    return counts.withColumn("perc_missing", F.when(whole > 0, F.floor(100.0 * F.col("missing") / whole + 0.5))).withColumn(
        "perc_superfluous", F.when(whole > 0, F.floor(100.0 * F.col("superfluous") / whole + 0.5))
    )
