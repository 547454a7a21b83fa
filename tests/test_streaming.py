"""Streams give what the batch operators give."""

import os

import pytest

from tidemark.operators.windows import snapshots
from tidemark.sources.views import tables
from tidemark.streaming.snapshots import hunk_counts, snapshot_stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_snapshots(spark, tmp_path):
    commits = tables(spark, SF, "commits").selectExpr("CAST(project AS BIGINT) AS project", "CAST(commit_id AS BIGINT) AS commit_id", "ord", "is_c")
    source = str(tmp_path / "in")
    for i in range(3):
        commits.filter(f"ord > {150 * i} AND ord <= {150 * (i + 1)}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(commits.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = snapshot_stream(stream, 20).writeStream.format("memory").queryName("snaps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.commit_id, r.snapshot_index) for r in spark.table("snaps").collect()}
    seen = commits.filter("ord <= 450")
    want = {(r.commit_id, r.snapshot_index) for r in snapshots(seen, seen.is_c, 20).collect()}
    assert want and want <= got


def test_hunk_counts_match_the_batch(spark, tmp_path):
    rows = tables(spark, SF, "lineitem").selectExpr("CAST(l_shipdate AS TIMESTAMP) AS ts", "CAST(l_partkey % 5 AS STRING) AS file", "CAST(l_quantity AS INT) AS added", "1 AS deleted")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = hunk_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, hunk_counts(rows).collect()))
