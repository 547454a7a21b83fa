"""Views of the stand-in tables in the shape of the change-history tables.

Each is one SQL text that Spark and DuckDB both run; {name} refers to a table or another view. For joint Spark has a plan of its own (narrow.py).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "commits": """
SELECT o_orderkey AS commit_id, o_custkey - o_custkey % 10 AS project, o_orderdate AS ts, o_orderpriority <> '5-LOW' AS is_c,
  CAST(row_number() OVER (PARTITION BY o_custkey - o_custkey % 10 ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ord
FROM {orders}""",
    "dag": """
SELECT commit_id, project, ts, is_c, ord, lag(commit_id) OVER (PARTITION BY project, commit_id % 3 ORDER BY ord) AS first_parent,
  CASE WHEN ord % 10 = 0 THEN lag(commit_id) OVER (PARTITION BY project ORDER BY ord) END AS other_parent
FROM {commits}""",
    "edges": """
SELECT DISTINCT project, child, parent FROM (
  SELECT project, commit_id AS child, first_parent AS parent FROM {dag} UNION ALL SELECT project, commit_id, other_parent FROM {dag})
WHERE parent IS NOT NULL""",
    "hunks": """
SELECT 'f' || CAST(l_partkey AS STRING) AS signature, p_brand || '/' || p_type || '.c' AS file, p_size AS gross_loc, l_orderkey AS commit_id,
  l_linenumber AS hunk, CAST(l_quantity AS INT) AS added, CAST(round(l_discount * 100) AS INT) AS deleted,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'ADD' WHEN 'RO' THEN 'MOVE' WHEN 'RF' THEN 'DEL' ELSE 'MOD' END AS mod_type,
  l_suppkey % 2 AS bugfix, l_partkey AS uid
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "functions": """
SELECT 'f' || CAST(p_partkey AS STRING) AS signature, p_brand || '/' || p_type || '.c' AS file, p_size AS loc, p_partkey AS uid FROM {part}""",
    "metrics": """
SELECT 'f' || CAST(p_partkey AS STRING) AS signature, p_brand || '/' || p_type || '.c' AS file, p_size AS loc, p_size % 7 AS loac, p_size % 5 AS lofc,
  p_size % 4 AS nofl, p_size % 3 AS nofc_dup, p_size % 3 AS nofc_nondup, p_size % 2 AS nonest, p_partkey % 2 AS noneg
FROM {part} WHERE p_size % 4 > 0""",
    "snapshots": """
SELECT DISTINCT CAST(extract(YEAR FROM o_orderdate) AS INT) - 1992 AS snapshot_index, CAST(date_trunc('year', o_orderdate) AS DATE) AS snapshot_date FROM {orders}""",
    "changes": """
SELECT h.*, CAST(extract(YEAR FROM o_orderdate) AS INT) - 1992 AS snapshot_index FROM {hunks} h JOIN {orders} ON commit_id = o_orderkey""",
    "joint": """
SELECT snapshot_index, uid, c.signature, c.file, p_size AS loc, p_size % 7 AS loac, p_size % 5 AS lofc, p_size % 4 AS fl, p_size % 3 AS fc, p_size % 2 AS cnd,
  uid % 2 AS neg, CASE WHEN uid % 11 = 0 THEN NULL ELSE uid % 97 END AS age, CASE WHEN uid % 11 = 0 THEN NULL ELSE uid % 13 END AS mrc,
  CAST(count(DISTINCT CASE WHEN mod_type IN ('MOD', 'MOVE') THEN commit_id END) AS BIGINT) AS commits,
  CAST(sum(CASE WHEN mod_type IN ('MOD', 'MOVE') THEN added + deleted ELSE 0 END) AS BIGINT) AS lch, uid % 5 AS pc
FROM {changes} c JOIN {part} ON uid = p_partkey GROUP BY snapshot_index, uid, c.signature, c.file, p_size""",
    "smells": """
SELECT d.doc_id, d.source || '/' || CAST(d.doc_id AS STRING) || '.c' AS file, d.source AS snapshot, d.n_chars AS sloc, CAST(coalesce(l.quality, 0) * (1 + d.doc_id % 3) AS INT) AS ab, CAST(coalesce(l.toxic, 0) AS INT) AS af,
  CAST(CASE WHEN d.doc_id % 4 = 0 THEN 1 + d.doc_id % 5 % 2 ELSE 0 END AS INT) AS lf, d.doc_id % 3 AS fixes, d.doc_id % 5 AS changes, CAST(d.doc_id % 17 AS DOUBLE) AS score
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "edits": """
SELECT l_orderkey AS commit_id, l_partkey - l_partkey % 20 AS file, CAST(l_quantity AS INT) * 20 + l_linenumber AS begin_a, CAST(l_quantity AS INT) * 20 + l_linenumber + l_suppkey % 9 AS end_a,
  CAST(l_quantity AS INT) * 20 AS begin_b, CAST(l_quantity AS INT) * 20 + CAST(round(l_discount * 100) AS INT) AS end_b
FROM {lineitem}""",
    "spans": """
SELECT DISTINCT p_partkey - p_partkey % 20 AS file, 'f' || CAST(p_partkey AS STRING) AS signature, p_size * 20 + 1 AS start1, p_size * 20 + 1 + p_partkey % 17 AS end1, 2 AS sig_loc FROM {part}""",
    "filediffs": """
SELECT l_orderkey AS commit_id, l_orderkey % 3 AS parent, l_linenumber AS diff_no, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'f' || CAST(l_partkey % 50 AS STRING) || CASE WHEN l_suppkey % 5 = 0 THEN '.h' ELSE '.c' END END AS old_path,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'f' || CAST((l_partkey + CAST(l_partkey % 13 = 0 AS INT)) % 50 AS STRING) || CASE WHEN l_suppkey % 6 = 0 THEN '.h' ELSE '.c' END END AS new_path
FROM {lineitem}""",
    "numbered": """
SELECT commit_id, commit_id % 3 AS parent, file, begin_a, end_a, begin_b, end_b, CAST(row_number() OVER (PARTITION BY commit_id, file ORDER BY begin_a, end_a, begin_b, end_b) AS BIGINT) AS edit_no FROM {edits}""",
    "sides": """
SELECT commit_id, commit_id % 3 AS parent, file, edit_no, CASE WHEN n = 0 THEN 'A' ELSE 'B' END AS side, 'f' || CAST((begin_a + n * CAST(end_b % 3 = 0 AS INT)) % 40 AS STRING) AS id,
  'n' || CAST(begin_a % 5 + n * CAST(end_b % 4 = 0 AS INT) AS STRING) AS name, 1 + n + begin_a % 4 AS lines FROM {numbered}, (SELECT 0 AS n UNION ALL SELECT 1 AS n) WHERE n = 0 OR end_b % 5 > 0""",
    "moves": """
SELECT commit_id, commit_id % 3 AS parent, hunk, mod_type, 'f' || CAST(uid % 30 AS STRING) AS id, CASE WHEN mod_type = 'MOVE' THEN 'f' || CAST((uid + 1) % 30 AS STRING) END AS new_id, added, deleted FROM {hunks}""",
    "models": """
SELECT 'dep' || CAST(p_size % 3 AS STRING) AS d, p_type AS i, p_brand AS system, p_partkey % 7 AS formula, CAST((p_retailprice - 1000) / 2000 AS DOUBLE) AS coef,
  CAST(CAST(p_partkey % 100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS DOUBLE) AS p, CASE WHEN p_partkey % 9 = 0 THEN 'algorithm did not converge' WHEN p_partkey % 9 = 1 THEN '' END AS warning, CAST(p_size - 25 AS DOUBLE) / CAST(25 AS DOUBLE) AS rho
FROM {part}""",
}


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table, or a view of one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "joint":
        from tidemark.sources import narrow

        return narrow.joint(*[tables(spark, sf_dir, t) for t in ("orders", "lineitem", "part")])
    text = VIEWS[name]
    used = {n: tables(spark, sf_dir, n) for n in set(re.findall(r"{(\w+)}", text))}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it refers to by {name} in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"{(\w+)}", text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda t: re.sub(r"{(\w+)}", r"\1", t)
    head = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not head:
        return body
    if body[:14].upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body[:4].upper() == "WITH" else f"WITH {head} {body}"
