"""Scans of the stored CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas


def scan(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """SRC1: CSV with a header that must match the schema; empty fields are NULL."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def stacked(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """SRC17: several files of one table as one."""
    return scan(spark, paths, schema)


def by_date(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """SRC8: <root>/<date>/<name> with the directory's date as column SNAPSHOT_DIR_DATE; dates prune files by glob."""
    at = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1))
    return scan(spark, f"{root}/*/{name}", schema).withColumn("SNAPSHOT_DIR_DATE", at)


def change_hunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC2: hunks; NEW_FUNCTION_SIGNATURE and NEW_FILE come together or not at all, counts are mandatory."""
    rows = scan(spark, path, schemas.CHANGE_HUNKS)
    paired = F.col("NEW_FUNCTION_SIGNATURE").isNull() == F.col("NEW_FILE").isNull()
    counted = F.col("HUNK").isNotNull() & F.col("LINES_ADDED").isNotNull() & F.col("LINES_DELETED").isNotNull()
    message = F.lit("hunk row with half a new function or without its counts")
    return rows.filter(F.when(paired & counted, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def static_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC3: static metrics, bound by header name as their column order is not fixed."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.STATIC_METRICS])


def all_functions(spark: SparkSession, root: str) -> DataFrame:
    """SRC4: functions of all snapshots."""
    return scan(spark, f"{root}/*/all_functions.csv", schemas.ALL_FUNCTIONS)


def commit_edges(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: distinct (commit, ts, parent) rows, columns located by name."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    return raw.select(F.col("COMMIT").alias("commit_id"), F.col("TIMESTAMP").alias("ts"), F.col("PARENT").alias("parent")).distinct()


def c_commits(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: commits listed in a revisions table; header names in any case, extra columns allowed."""
    raw = spark.read.option("header", True).csv(path)
    name = next(c for c in raw.columns if c.upper() == "COMMIT_ID")
    return raw.select(F.col(name).alias("commit_id")).distinct()


def snapshots(spark: SparkSession, overview: str, root: str) -> DataFrame:
    """SRC7: snapshots with their commits."""
    commits = scan(spark, f"{root}/*/snapshot_commits.csv", schemas.SNAPSHOT_COMMITS)
    return scan(spark, overview, schemas.SNAPSHOTS).join(commits, "SNAPSHOT_INDEX")


def smell_scores(spark: SparkSession, path: str, smell: str) -> DataFrame:
    """SRC9: file and score of one smell; the score is the fourth column for AB, else the second."""
    raw = spark.read.option("header", True).csv(path)
    score = raw.columns[3 if smell == "AB" else 1]
    return raw.select(F.col(raw.columns[0]).alias("file"), F.lit(smell).alias("smell"), F.col(score).cast("double").alias("score"))


def feature_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: columns 1, 6, 8 and 10 (from 0) of a features table."""
    raw = spark.read.option("header", True).csv(path)
    at = [raw.columns[i] for i in (1, 6, 8, 10)]
    return raw.select(F.col(at[0]).alias("name"), *[F.col(c).cast("int").alias(n) for c, n in zip(at[1:], ("loc", "occurrences", "compilation_units"))])


def feature_files(spark: SparkSession, path: str, row_tag: str = "feature") -> DataFrame:
    """SRC11: XML documents of features with the files they appear in: (feature, file)."""
    schema = _feature_schema()
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return raw.select(F.col("_name").alias("feature"), F.explode("file").alias("file")).distinct()


def parsed_features(rows: DataFrame, xml: str) -> DataFrame:
    """SRC11 on documents in a column: (feature, file)."""
    parsed = rows.select(F.from_xml(xml, _feature_schema()).alias("f"))
    return parsed.select(F.col("f._name").alias("feature"), F.explode("f.file").alias("file")).distinct()


def _feature_schema() -> T.StructType:
    return T.StructType.fromDDL("_name string, file array<string>")


def c_files(spark: SparkSession, root: str, pattern: str = r"\.[cC]$") -> DataFrame:
    """SRC14: files below root whose path matches."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return listed.filter(F.col("path").rlike(pattern))


def commit_ids(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: whitespace-separated commit ids of a text file."""
    return split_ids(spark.read.text(path), "value").select("commit_id")


def split_ids(rows: DataFrame, text: str) -> DataFrame:
    """SRC18 on texts in a column: a row for each id."""
    return rows.withColumn("commit_id", F.explode(F.split(text, r"\s+"))).filter("commit_id <> ''")
