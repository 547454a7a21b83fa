"""CSV scans and fixed schemas."""

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import derived as D
from tidemark.sources import tables as T

HEADER = "FUNCTION_SIGNATURE,FILE,FUNCTION_GROSS_LOC,COMMIT_ID,HUNK,LINE_DELTA,LINES_DELETED,LINES_ADDED,MOD_TYPE,NEW_FUNCTION_SIGNATURE,NEW_FILE,PREVIOUS_REVISION_ID\n"


def test_hunks(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(HEADER + "f(),a.c,10,c1,0,2,1,3,MOD,,,\nf(),a.c,10,c1,1,0,0,0,MOVE,g(),b.c,c0\n")
    rows = T.change_hunks(spark, str(p)).orderBy("HUNK").collect()
    assert [r.LINES_ADDED for r in rows] == [3, 0] and rows[0].NEW_FILE is None and rows[1].NEW_FILE == "b.c"


def test_half_a_new_function_is_an_error(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(HEADER + "f(),a.c,10,c1,0,2,1,3,MOVE,g(),,\n")
    with pytest.raises(Exception, match="half a new function"):
        T.change_hunks(spark, str(p)).collect()


def test_a_wrong_header_is_an_error(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("SNAPSHOT_INDEX,DAY,START_COMMIT_HASH\n0,2020-01-01,c\n")
    with pytest.raises(Exception):
        T.scan(spark, str(p), schemas.SNAPSHOTS).collect()


def test_metrics_bind_by_name(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("LOC,FILE,FUNCTION_SIGNATURE,NONEG,LOAC,LOFC,NOFL,NOFC_Dup,NOFC_NonDup,NONEST\n7,a.c,f(),1,2,3,4,5,6,0\n")
    r = T.static_metrics(spark, str(p)).first()
    assert (r.LOC, r.FILE, r.NONEG, r.NOFC_NonDup) == (7, "a.c", 1, 6)


def test_partitioned_by_date(spark, tmp_path):
    for d, n in (("2020-01-01", 1), ("2020-02-01", 2)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "all_functions.csv").write_text("SNAPSHOT_DATE,FUNCTION_SIGNATURE,FILE,FUNCTION_LOC\n" + f"{d},f{n}(),a.c,{n}\n")
    got = T.by_date(spark, str(tmp_path), "all_functions.csv", schemas.ALL_FUNCTIONS).orderBy("FUNCTION_LOC").collect()
    assert [str(r.SNAPSHOT_DIR_DATE) for r in got] == ["2020-01-01", "2020-02-01"]


def test_features_from_xml(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<fs><feature name="A"><file>x.c</file><file>y.c</file></feature><feature name="B"><file>x.c</file></feature></fs>')
    assert {(r.feature, r.file) for r in T.feature_files(spark, str(tmp_path / "f.xml")).collect()} == {("A", "x.c"), ("A", "y.c"), ("B", "x.c")}


def test_rounding(spark):
    r = spark.range(1).select(D.rounded_int(F.lit(2.5)).alias("even"), D.java_round(F.lit(-2.5)).alias("java")).first()
    assert (r.even, r.java) == (2, -2)


def test_sinks(spark, tmp_path):
    import pytest

    from tidemark.sources import sinks

    rows = spark.createDataFrame([(0, "2020-01-01", 5), (1, "2020-02-01", None)], "snapshot_index int, snapshot_date string, n int")
    commits = spark.createDataFrame([(0, "a"), (1, "b")], "snapshot_index int, commit_id string")
    sinks.write_snapshots(rows, commits, str(tmp_path / "overview"), str(tmp_path / "bridge"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write(rows, str(tmp_path / "overview"))
    sinks.write(rows.limit(1), str(tmp_path / "overview"), force=True)
    assert sinks.read_back(spark, str(tmp_path / "overview"), rows).count() == 1
    sinks.append(rows, str(tmp_path / "overview"))
    assert sinks.read_back(spark, str(tmp_path / "overview"), rows).count() == 3
    sinks.write_by_snapshot(rows, str(tmp_path / "by"))
    sinks.write_by_snapshot(rows.filter("snapshot_index = 1").withColumn("n", rows.snapshot_index + 8), str(tmp_path / "by"))
    assert sorted(r.n for r in spark.read.option("header", True).schema("snapshot_index int, n int, snapshot_date string").csv(str(tmp_path / "by")).collect()) == [5, 9]


def test_common_lines_of_long_texts_take_time_by_their_lines(spark):
    import time

    from pyspark.sql import functions as F

    from tidemark.functions.derived import common_lines

    long = "\n".join(f"line {i}" for i in range(40000))
    rows = [(0, long, long + "\nmore\n"), (1, "a b\r\n\tc\n\n", "c\nab\nab"), (2, "", " \n"), (3, None, "a"), (4, "x\nx\ny", "x\ny\ny\nz")]
    texts = spark.createDataFrame(rows, "id int, a string, b string")
    texts.select(common_lines(F.col("b"), F.col("b"))).filter("false").collect()
    began = time.time()
    got = {r.id: r.s for r in texts.select("id", common_lines(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {0: 80000 / 80001, 1: 4 / 5, 2: 1.0, 3: None, 4: 4 / 7}
    assert time.time() - began < 15


def test_narrow_plans_agree_with_sql_on_keys_that_occur_again(spark, tmp_path, monkeypatch):
    import re

    import duckdb

    from tidemark.operators import shared
    from tidemark.plans.catalogue import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        more = {"orders": "SELECT * REPLACE (o_orderdate + INTERVAL 800 DAY AS o_orderdate) FROM x WHERE o_orderkey % 7 = 0", "lineitem": "SELECT * REPLACE (NULL AS l_quantity) FROM x WHERE l_orderkey % 5 = 0",
                "part": "SELECT * REPLACE (p_size + 1 AS p_size) FROM x WHERE p_partkey % 3 = 0"}[t]
        c.execute(f"COPY (WITH x AS (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet') SELECT * FROM x UNION ALL {more}) TO '{tmp_path}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    monkeypatch.setattr(shared, "TASK_BYTES", 10000)
    plain = lambda rows: sorted((tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in rows), key=repr)
    for name in ("agg5_change_stats", "agg6_history_before", "flt9_zero_filled", "jn4_added_functions", "prj10_whole_medians"):
        df = QUERIES[name](spark, str(tmp_path))
        cursor = c.execute(ORACLES[name])
        assert plain(df.select(*[d[0] for d in cursor.description]).collect()) == plain(cursor.fetchall()), name
        if name[:3] == "agg":  # more files, more partitions
            assert max(map(int, re.findall(r"hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))) > 5
