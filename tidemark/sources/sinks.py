"""Writers of the result tables (SNK operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import scan


def write(rows: DataFrame, path: str, force: bool = False, form: str = "csv") -> None:
    """SNK2, SNK4, SNK7, SNK9: a table as CSV with a header, or as Parquet; one that is there is only replaced by force.

    Spark commits a table when all of its tasks are done, so a failed job leaves nothing to be read.
    """
    rows.write.mode("overwrite" if force else "errorifexists").option("header", True).format(form).save(path)


def write_snapshots(snapshots: DataFrame, commits: DataFrame, overview: str, bridge: str, force: bool = False) -> None:
    """SNK1: the snapshots' overview and their commits; both are read back and must hold the same rows."""
    for rows, path in ((snapshots, overview), (commits, bridge)):
        write(rows, path, force)
        back = scan(rows.sparkSession, path, rows.schema)
        if rows.exceptAll(back).limit(1).count() or back.exceptAll(rows).limit(1).count():
            raise ValueError(f"{path} doesn't hold what was written")


def write_by_snapshot(rows: DataFrame, path: str, by: str = "snapshot_date") -> None:
    """SNK5: one folder a snapshot; those of the snapshots in rows are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(by).csv(path)


def append(rows: DataFrame, path: str) -> None:
    """SNK6: rows added to an overview."""
    rows.write.mode("append").option("header", True).csv(path)


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table that write or append made, with the types of another."""
    return scan(spark, path, like.schema)
