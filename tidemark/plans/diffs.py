"""Queries that map diffs to functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diffmap as M
from tidemark.operators import joins as J
from tidemark.plans.registry import query

C = F.col

query("gr13_moves_merged")(lambda v: M.moves_merged(v.hunks.join(v.part.select(C("p_partkey").alias("uid"), "p_name"), "uid").select(
    C("commit_id").cast("long").alias("commit_id"), (C("commit_id") % 3).cast("long").alias("parent"), "hunk", "mod_type", C("signature").alias("id"), C("file").alias("name"), "file", "added", "deleted", C("hunk").alias("start"), C("p_name").alias("source"))))
_MOVES = "m AS (SELECT commit_id, parent, hunk AS spot, id AS old, new_id AS new FROM {moves} WHERE mod_type = 'MOVE'), d AS (SELECT * FROM {moves} WHERE mod_type = 'MOD')"
query("gr14_reattributed", f"""WITH {_MOVES} SELECT * FROM {{moves}} WHERE mod_type <> 'MOD' UNION ALL
  SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.commit_id = d.commit_id AND m.parent = d.parent AND ((d.id = old AND hunk > spot) OR (d.id = new AND hunk < spot))) UNION ALL
  SELECT d.commit_id, d.parent, hunk, mod_type, new AS id, new_id, added, deleted FROM d JOIN m ON m.commit_id = d.commit_id AND m.parent = d.parent AND d.id = old AND hunk > spot UNION ALL
  SELECT d.commit_id, d.parent, hunk, mod_type, old AS id, new_id, added, deleted FROM d JOIN m ON m.commit_id = d.commit_id AND m.parent = d.parent AND d.id = new AND hunk < spot""")(lambda v: M.reattributed(v.moves))
query("gr15_signature_changes", """WITH s AS (SELECT commit_id, parent, file, edit_no, max(id) FILTER (side = 'A') AS id_a, max(id) FILTER (side = 'B') AS id_b, max(name) FILTER (side = 'A') AS na, max(name) FILTER (side = 'B') AS nb,
  max(lines) FILTER (side = 'A') AS deleted, max(lines) FILTER (side = 'B') AS added FROM {sides} GROUP BY ALL HAVING count(*) FILTER (side = 'A') = 1 AND count(*) FILTER (side = 'B') = 1)
  SELECT commit_id, parent, file, edit_no, CASE WHEN id_a = id_b THEN 'MOD' ELSE 'MOVE' END AS mod_type, id_a, id_b, deleted, added FROM s WHERE id_a = id_b OR na = nb""")(lambda v: M.signature_changes(v.sides))
query("gr16_pseudo_changes", """WITH t AS (SELECT DISTINCT commit_id, id, mod_type FROM {moves} WHERE hunk < 3), r AS (SELECT DISTINCT commit_id, parent, id, CASE WHEN hunk % 2 = 0 THEN 'ADD' ELSE 'DEL' END AS mod_type FROM {moves})
  SELECT commit_id, parent, -1 AS hunk, mod_type, id, CASE WHEN mod_type = 'ADD' THEN 7 ELSE 0 END AS added, CASE WHEN mod_type = 'DEL' THEN 7 ELSE 0 END AS deleted FROM r
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.commit_id = r.commit_id AND t.id = r.id AND t.mod_type = r.mod_type)""")(
    lambda v: M.pseudo_changes(*[v.moves.filter(w).select("commit_id", "parent", "id").distinct().withColumn("loc", F.lit(7)) for w in ("hunk % 2 = 0", "hunk % 2 = 1")], v.moves.filter("hunk < 3")))
query("gr17_line_attribution", """SELECT e.commit_id, signature, CAST(sum(CASE WHEN begin_a <= start1 - 1 AND end_a > end1 - 1 THEN end1 - start1 + 1 WHEN begin_a >= start1 - 1 AND end_a <= end1 - 1 THEN end_a - begin_a
  WHEN begin_a > start1 - 1 THEN end1 - 1 - begin_a ELSE end_a - (start1 - 1) END) AS BIGINT) AS lines FROM {edits} e JOIN {spans} s ON e.file = s.file AND begin_a < end1 AND end_a > start1 - 1 GROUP BY e.commit_id, signature""")(
    lambda v: J.overlaps(v.edits, v.spans).groupBy("commit_id", "signature").agg(F.sum("lines").cast("long").alias("lines")))
query("gr18_shifted_starts", """SELECT *, CAST(begin_a + coalesce(sum((end_b - begin_b) - (end_a - begin_a)) OVER (PARTITION BY commit_id, parent, file ORDER BY edit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS adjusted_a FROM {numbered}""")(
    lambda v: M.shifted_starts(v.numbered).withColumn("adjusted_a", C("adjusted_a").cast("long")))
query("gr19_classified_diffs", """SELECT * FROM (SELECT *, CASE WHEN coalesce(old_path LIKE '%.c', false) AND coalesce(new_path LIKE '%.c', false) THEN CASE WHEN old_path = new_path THEN 'EDIT' ELSE 'RENAME' END
  WHEN coalesce(new_path LIKE '%.c', false) THEN 'ADD' WHEN coalesce(old_path LIKE '%.c', false) THEN 'DEL' END AS kind FROM {filediffs}) WHERE kind IS NOT NULL""")(lambda v: M.classified_diffs(v.filediffs))
query("gr21_merged_mods", """WITH c AS (SELECT commit_id, parent, uid_ AS file, hunk AS edit_no, id, added, deleted, mod_type FROM (SELECT *, CAST(substr(id, 2) AS INT) % 3 AS uid_ FROM {moves}))
  SELECT commit_id, parent, file, edit_no, id, added, deleted, mod_type FROM c WHERE mod_type <> 'MOD' UNION ALL
  SELECT commit_id, parent, file, edit_no, id, CAST(sum(added) AS INT), CAST(sum(deleted) AS INT), 'MOD' FROM c WHERE mod_type = 'MOD' GROUP BY ALL""")(
    lambda v: M.merged_mods(v.moves.select("commit_id", "parent", (F.substring("id", 2, 9).cast("int") % 3).alias("file"), C("hunk").alias("edit_no"), "id", "added", "deleted", "mod_type")))
query("gr7_function_classes", """WITH RECURSIVE e AS (SELECT DISTINCT a.uid AS x, b.uid AS y FROM {hunks} a JOIN {hunks} b ON a.commit_id = b.commit_id AND a.mod_type = 'MOVE' AND b.mod_type = 'MOVE' AND a.uid - a.uid % 20 = b.uid - b.uid % 20),
  r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS uid, min(y) AS class FROM r GROUP BY x""")(lambda v: _classes(v))


def _classes(v):
    from tidemark.operators.genealogy import equivalence_classes

    moved = v.hunks.filter("mod_type = 'MOVE'").select("commit_id", (C("uid") - C("uid") % 20).alias("block"), "uid")
    pairs = moved.join(moved.select("commit_id", "block", C("uid").alias("other")), ["commit_id", "block"]).select(C("uid").alias("a"), C("other").alias("b"))
    return equivalence_classes(pairs).select(C("id").alias("uid"), C("class"))


def _genealogy(v):
    from tidemark.operators.genealogy import genealogy

    # Both parents of a commit are columns of dag, so that its edges needn't be joined to it again.
    parents = F.array_sort(F.array_distinct(F.array_compact(F.array("first_parent", "other_parent"))))
    commits = v.dag.select("project", "commit_id", "ord", parents.alias("parents"), C("first_parent").alias("previous"))
    changes = v.moves.select("commit_id", "hunk", "mod_type", "id", "new_id")
    return genealogy(commits, changes)


query("gr8_genealogy")(_genealogy)
query("gr9_merged_lines")(lambda v: _genealogy(v).groupBy("project", "uid").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("id").alias("ids")))
