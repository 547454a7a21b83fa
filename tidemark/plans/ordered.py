"""Queries of windows over commits and snapshots, graphs, diffs and statistics."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions import derived as D
from tidemark.operators import dag as G
from tidemark.operators import joins as J
from tidemark.operators import rollups as R
from tidemark.operators import stats as S
from tidemark.operators import windows as W
from tidemark.operators.shared import kept
from tidemark.plans.registry import query

C = F.col
N = 50
WIN1 = f"""SELECT commit_id, project, ts, ord, snapshot_index FROM (SELECT *, sum(CAST(is_c AS INT)) OVER (PARTITION BY project, snapshot_index) AS n FROM (
  SELECT *, CAST(floor(coalesce(sum(CAST(is_c AS INT)) OVER (PARTITION BY project ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {N}) AS INT) AS snapshot_index FROM {{commits}})) WHERE n >= {N}"""
query("win1_snapshots", f"SELECT commit_id, project, snapshot_index FROM ({WIN1})")(lambda v: W.snapshots(v.commits, C("is_c"), N).select("commit_id", "project", "snapshot_index"))
query("win2_snapshot_dates", f"""WITH f AS (SELECT project, snapshot_index, arg_min(commit_id, ord) AS start_commit, datediff('day', DATE '1970-01-01', CAST(arg_min(ts, ord) AS DATE)) AS d FROM ({WIN1}) GROUP BY 1, 2),
  s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY snapshot_index) AS i FROM f)
  SELECT project, snapshot_index, start_commit, DATE '1970-01-01' + CAST(max(d - i) OVER (PARTITION BY project ORDER BY i) + i AS INT) AS snapshot_date FROM s""")(lambda v: W.snapshot_dates(W.snapshots(v.commits, C("is_c"), N)))
query("win3_sliding_starts", "SELECT CAST(unnest(range(0, (SELECT max(snapshot_index) FROM {snapshots}) + 2 - 3, 2)) AS INT) AS start")(lambda v: W.sliding_starts(v.snapshots, 3, 2).select(C("start").cast("int").alias("start")))
WIN4 = """SELECT f.uid, f.snapshot_index AS start, CAST(sum(w.commits) AS BIGINT) AS commits, CAST(sum(w.lch) AS BIGINT) AS lch FROM {joint} f JOIN {joint} w ON f.uid = w.uid AND w.snapshot_index BETWEEN f.snapshot_index AND f.snapshot_index + 2
  WHERE f.snapshot_index + 3 <= (SELECT max(snapshot_index) + 1 FROM {joint}) GROUP BY 1, 2"""
query("win4_window_sums", f"SELECT uid, start, lch FROM ({WIN4})")(lambda v: W.window_sums(v.joint, 3, 1).select("uid", "start", "lch"))
query("win5_window_commits", f"SELECT uid, start, commits FROM ({WIN4})")(lambda v: W.window_sums(v.joint, 3, 1).select("uid", "start", "commits"))
INDEX = "SELECT commit_id, project, row_number() OVER (PARTITION BY project ORDER BY ord) - 1 AS position, coalesce(sum(CAST(is_c AS INT)) OVER (PARTITION BY project ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_position FROM {dag}"
REACH = "r AS (SELECT commit_id AS descendant, commit_id AS ancestor FROM {dag} UNION SELECT r.descendant, e.parent FROM r JOIN {edges} e ON e.child = r.ancestor)"
query("win6_distances", f"""WITH RECURSIVE {REACH}, x AS ({INDEX}) SELECT descendant, ancestor, CAST(d.position - a.position AS BIGINT) AS distance, CAST(d.c_position - a.c_position AS BIGINT) AS c_distance
  FROM r JOIN x d ON d.commit_id = descendant JOIN x a ON a.commit_id = ancestor""")(lambda v: G.distances(W.c_index(v.dag), v.edges))
_HITS = f"""WITH RECURSIVE {REACH}, x AS ({INDEX}), s AS (SELECT commit_id AS start_commit, commit_id % 5 AS uid FROM {{dag}} WHERE ord % 4 = 0), c AS (SELECT commit_id, commit_id % 5 AS uid FROM {{dag}} WHERE ord % 3 = 0),
  h AS (SELECT s.uid, s.start_commit, d.c_position - a.c_position AS dist FROM s JOIN c ON s.uid = c.uid JOIN r ON r.descendant = s.start_commit AND r.ancestor = c.commit_id JOIN x d ON d.commit_id = s.start_commit JOIN x a ON a.commit_id = c.commit_id WHERE c.commit_id <> s.start_commit),
  g AS (SELECT s.uid, s.start_commit, CAST(coalesce(max(dist), CASE WHEN s.start_commit % 2 = 0 THEN NULL ELSE 0 END) AS BIGINT) AS age, CAST(coalesce(min(dist), CASE WHEN s.start_commit % 2 = 0 THEN NULL ELSE 0 END) AS BIGINT) AS last_edit FROM s LEFT JOIN h ON s.uid = h.uid AND s.start_commit = h.start_commit GROUP BY 1, 2) """


def _ages(v):
    starts = v.dag.filter("ord % 4 = 0").select("project", C("commit_id").alias("start_commit"), (C("commit_id") % 5).alias("uid"), (C("commit_id") % 2 == 0).alias("older"))
    changes = v.dag.filter("ord % 3 = 0").select("project", "commit_id", (C("commit_id") % 5).alias("uid"))
    return G.ages_by_project(starts, changes, W.c_index(v.dag), v.edges)


query("win7_age", _HITS + "SELECT uid, start_commit, age FROM g")(lambda v: _ages(v).select("uid", "start_commit", "age"))
query("win8_last_edit", _HITS + "SELECT uid, start_commit, last_edit FROM g")(lambda v: _ages(v).select("uid", "start_commit", "last_edit"))
query("win9_branch_positions", """WITH k AS (SELECT *, commit_id % 3 AS lane FROM {commits} WHERE is_c), b AS (SELECT project, lane, dense_rank() OVER (PARTITION BY project ORDER BY min(ts), lane) AS branch_number FROM k GROUP BY project, lane)
  SELECT k.commit_id, b.branch_number, row_number() OVER (PARTITION BY k.project, k.lane ORDER BY ord) AS branch_position FROM k JOIN b ON k.project = b.project AND k.lane = b.lane""")(
    lambda v: W.branch_positions(v.commits.withColumn("lane", C("commit_id") % 3), "lane", "ord").select("commit_id", "branch_number", "branch_position"))
query("win10_spread_days", """WITH f AS (SELECT project, ord, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, row_number() OVER (PARTITION BY project ORDER BY ord) AS i FROM {commits})
  SELECT project, ord, DATE '1970-01-01' + CAST(max(d - i) OVER (PARTITION BY project ORDER BY i) + i AS INT) AS day FROM f""")(
    lambda v: W.increasing_days(v.commits.select("project", "ord", F.to_date("ts").alias("d")), "d", "project", "ord").select("project", "ord", "day"))
query("srt1_by_time", "SELECT commit_id, row_number() OVER (PARTITION BY project ORDER BY ts, commit_id) AS place FROM {commits}")(lambda v: v.commits.select("commit_id", _place("project", ["ts", "commit_id"])))
query("srt2_integer_keys", """WITH e AS (SELECT d.project, d.ts, d.commit_id AS child, e.parent FROM {dag} d LEFT JOIN {edges} e ON e.child = d.commit_id), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, child, parent NULLS FIRST) AS r FROM e),
  a AS (SELECT project, commit_id, min(seen) AS seen FROM (SELECT project, child AS commit_id, r * 2 AS seen FROM r UNION ALL SELECT project, parent, r * 2 + 1 FROM r WHERE parent IS NOT NULL) GROUP BY 1, 2)
  SELECT project, commit_id, row_number() OVER (PARTITION BY project ORDER BY seen) - 1 AS key FROM a""")(
    lambda v: G.integer_keys(v.dag.select("project", "ts", C("commit_id").alias("child")).join(v.edges.drop("project"), "child", "left")))
query("srt3_by_hunk_and_kind", "SELECT uid, commit_id, hunk, mod_type, row_number() OVER (PARTITION BY commit_id ORDER BY hunk, CASE mod_type WHEN 'ADD' THEN 0 WHEN 'MOVE' THEN 1 WHEN 'MOD' THEN 2 ELSE 3 END, uid, added, deleted) AS place FROM {hunks}")(
    lambda v: v.hunks.select("uid", "commit_id", "hunk", "mod_type", _place("commit_id", ["hunk", F.when(C("mod_type") == "ADD", 0).when(C("mod_type") == "MOVE", 1).when(C("mod_type") == "MOD", 2).otherwise(3), "uid", "added", "deleted"])))
query("srt4_by_file", "SELECT signature, row_number() OVER (PARTITION BY file ORDER BY signature) AS place FROM {functions}")(lambda v: v.functions.select("signature", _place("file", ["signature"])))
query("srt5_by_similarity", "SELECT system, d, i, formula, row_number() OVER (PARTITION BY d ORDER BY rho DESC, system, i, formula, coef, p) AS place FROM {models}")(
    lambda v: v.models.select("system", "d", "i", "formula", _place("d", [C("rho").desc(), "system", "i", "formula", "coef", "p"])))
query("srt6_by_date_name", "SELECT file, row_number() OVER (PARTITION BY snapshot ORDER BY sloc, file DESC) AS place FROM {smells}")(lambda v: v.smells.select("file", _place("snapshot", ["sloc", C("file").desc()])))
query("srt7_rename_candidates", """WITH l AS (SELECT DISTINCT a.p_name AS old, b.p_name AS new FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1),
  d AS (SELECT old, new, levenshtein(lower(old), lower(new)) AS distance, greatest(1, floor(least(length(old), length(new)) / 3::DOUBLE + 0.5)) AS threshold FROM l)
  SELECT old, new, distance::BIGINT AS distance, threshold::BIGINT AS threshold, row_number() OVER (ORDER BY threshold - distance, old, new) AS place FROM d""")(
    lambda v: J.rename_candidates(v.part.select(C("p_partkey").alias("k"), C("p_name").alias("old")).join(v.part.select((C("p_partkey") - 1).alias("k"), C("p_name").alias("new")), "k").select("old", "new")))


def _place(by, order):
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long").alias("place")


# --- graphs ---

query("gr1_closure", f"WITH RECURSIVE {REACH} SELECT descendant, ancestor FROM r")(lambda v: G.closure(v.dag, v.edges).select("descendant", "ancestor"))
query("gr2_related", f"""WITH RECURSIVE {REACH}, p AS (SELECT x.commit_id AS a, y.commit_id AS b FROM {{dag}} x JOIN {{dag}} y ON x.project = y.project AND y.ord = x.ord + 2), q AS (SELECT a, b, EXISTS (SELECT 1 FROM r WHERE descendant = a AND ancestor = b) AS descends,
  EXISTS (SELECT 1 FROM r WHERE descendant = b AND ancestor = a) AS precedes FROM p) SELECT *, descends OR precedes AS related FROM q""")(
    lambda v: G.related(v.dag.select("project", "ord", C("commit_id").alias("a")).join(v.dag.select("project", (C("ord") - 2).alias("ord"), C("commit_id").alias("b")), ["project", "ord"]).select("project", "a", "b"), v.dag, v.edges))
query("gr3_no_listed_ancestor", f"WITH RECURSIVE {REACH}, l AS (SELECT commit_id FROM {{dag}} WHERE commit_id % 7 < 3) SELECT commit_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r JOIN l o ON r.ancestor = o.commit_id WHERE r.descendant = l.commit_id AND r.ancestor <> l.commit_id)")(
    lambda v: G.without_listed_ancestor(v.dag.filter("commit_id % 7 < 3").select("project", "commit_id"), v.dag, v.edges))
query("gr4_roots", "SELECT commit_id FROM {dag} WHERE commit_id NOT IN (SELECT child FROM {edges})")(lambda v: G.roots(v.dag.select("commit_id"), v.edges))
query("gr5_topological_walk")(lambda v: G.walk(v.dag, v.edges))
_BRANCH_KINDS = """k AS (SELECT parent, count(DISTINCT child) AS kids FROM {edges} GROUP BY parent), u AS (SELECT child, count(DISTINCT e.parent) AS n, max(kids) AS kids FROM {edges} e JOIN k ON e.parent = k.parent GROUP BY child),
  b AS (SELECT commit_id, CASE WHEN n IS NULL THEN 'root' WHEN n > 1 THEN 'merge' WHEN kids > 1 THEN 'split' ELSE 'continue' END AS kind FROM {dag} LEFT JOIN u ON child = commit_id)"""
query("gr6_branch_kinds", f"WITH {_BRANCH_KINDS} SELECT commit_id, kind FROM b")(lambda v: G.branch_kinds(v.dag, v.edges))
query("gr6_branches", f"""WITH RECURSIVE {_BRANCH_KINDS}, r AS (SELECT commit_id, kind, commit_id AS branch FROM b WHERE kind <> 'continue' UNION ALL
  SELECT b.commit_id, b.kind, r.branch FROM r JOIN {{edges}} e ON e.parent = r.commit_id JOIN b ON b.commit_id = e.child AND b.kind = 'continue') SELECT commit_id, kind, branch FROM r""")(lambda v: G.branches(v.dag, v.edges))
query("gr12_linear_branches")(lambda v: G.linear_branches(v.dag))
query("gr20_rootless_adds", "SELECT h.uid, h.commit_id, 'ADD' AS mod_type FROM {hunks} h JOIN {dag} d ON h.commit_id = d.commit_id WHERE d.first_parent IS NULL AND d.other_parent IS NULL")(
    lambda v: v.hunks.join(G.roots(v.dag, v.edges).select("commit_id"), "commit_id", "left_semi").select("uid", "commit_id", F.lit("ADD").alias("mod_type")))
query("agg10_degrees", """SELECT commit_id, array_to_string(p, ',') AS parents, array_to_string(c, ',') AS children FROM {dag} LEFT JOIN (SELECT child, list_sort(list(DISTINCT parent)) AS p FROM {edges} GROUP BY child) ON child = commit_id
  LEFT JOIN (SELECT parent, list_sort(list(DISTINCT child)) AS c FROM {edges} GROUP BY parent) ON parent = commit_id""")(
    lambda v: G.degrees(v.dag, v.edges).select("commit_id", *[F.array_join(C(c).cast("array<string>"), ",").alias(c) for c in ("parents", "children")]))
query("agg30_listed_ancestors", f"WITH RECURSIVE {REACH} SELECT commit_id, (SELECT count(*) FROM r WHERE descendant = commit_id AND ancestor % 7 < 3) AS n FROM {{dag}}")(
    lambda v: G.listed_ancestors(v.dag, v.dag.filter("commit_id % 7 < 3").select("project", "commit_id"), v.edges))
query("jn10_nearest_changes", f"""WITH RECURSIVE {REACH}, s AS (SELECT commit_id AS start_commit, commit_id % 5 AS uid FROM {{dag}} WHERE ord % 4 = 0), c AS (SELECT commit_id, commit_id % 5 AS uid FROM {{dag}} WHERE ord % 3 = 0),
  h AS (SELECT DISTINCT s.uid, s.start_commit, c.commit_id FROM s JOIN c ON s.uid = c.uid JOIN r ON r.descendant = s.start_commit AND r.ancestor = c.commit_id WHERE c.commit_id <> s.start_commit)
  SELECT uid, start_commit, commit_id FROM h WHERE NOT EXISTS (SELECT 1 FROM h o JOIN r ON r.descendant = o.commit_id AND r.ancestor = h.commit_id WHERE o.uid = h.uid AND o.start_commit = h.start_commit AND o.commit_id <> h.commit_id)""")(
    lambda v: G.nearest_changes(v.dag.filter("ord % 4 = 0").select("project", C("commit_id").alias("start_commit"), (C("commit_id") % 5).alias("uid")), v.dag.filter("ord % 3 = 0").select("project", "commit_id", (C("commit_id") % 5).alias("uid")), v.dag, v.edges))
query("jn3_snapshot_changes", """WITH p AS (SELECT coalesce(o.snapshot_index, n.snapshot_index - 1) AS older, o.signature AS o, n.signature AS n, o.lch AS ol, n.lch AS nl FROM {joint} o FULL JOIN {joint} n ON n.snapshot_index = o.snapshot_index + 1 AND o.signature = n.signature AND o.file = n.file),
  c AS (SELECT older, count(o) AS func_before, count(n) AS func_now, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) AS func_identical, count(*) FILTER (o IS NULL) AS func_added, count(*) FILTER (n IS NULL) AS func_removed,
  round(median(CASE WHEN ol > 0 THEN abs(ol - nl) * 100.0::DOUBLE / ol END), 2) AS median_perc_change FROM p GROUP BY older) SELECT *, (func_added + func_removed) * 100 // func_before AS perc_add_rem FROM c WHERE func_before > 0 AND func_now > 0""")(
    lambda v: J.snapshot_changes(v.joint.select("snapshot_index", "signature", "file", "lch")))

# --- statistics ---

_VARS = ["fc", "fl", "cnd", "neg", "loac", "loacratio", "loc", "age", "mrc", "pc"]
_KNOWN = "(SELECT *, loac / loc::DOUBLE AS loacratio, commits / loc::DOUBLE AS commitsratio, lch / loc::DOUBLE AS lchratio, lofc / loc::DOUBLE AS lofcratio FROM {joint} WHERE age IS NOT NULL AND mrc IS NOT NULL AND pc IS NOT NULL)"
#: As many annotated functions as others: SMP3 over complete rows.
_EVEN = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fl > 0 ORDER BY uid * 7919 % 10007, uid, snapshot_index) AS r_ FROM {_KNOWN}),
  (SELECT min(c) AS c_ FROM (SELECT count(*) AS c FROM {_KNOWN} GROUP BY fl > 0)) WHERE r_ <= c_)"""
_SIZES = "CASE WHEN abs(rho) < 0.2 THEN 'very weak' WHEN abs(rho) < 0.4 THEN 'weak' WHEN abs(rho) < 0.6 THEN 'moderate' WHEN abs(rho) < 0.8 THEN 'strong' ELSE 'very strong' END"


def _tail(density: str, x: str) -> str:
    """Two-sided tail of a density in t beyond x, by Simpson's rule over 400 steps."""
    return f"greatest(0, 1 - 2 * ({x}) / 1200 * list_sum(list_transform(range(0, 401), lambda k: (CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('@', f'(k * ({x}) / 400)')})))"


_NORMAL = "exp(-@ * @ / 2) / sqrt(2 * pi())"
_STUDENT = "exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt((n - 2) * pi()) * pow(1 + @ * @ / (n - 2), -(n - 1) / 2.0::DOUBLE)"


def _rho(d: str, i: str, rows: str, head: str = "", where: str = "true") -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT {head}'{d}' AS d, '{i}' AS i, count(*) AS n, corr(x, y) AS rho FROM (SELECT {rank(i)} AS x, {rank(d)} AS y FROM {rows} WHERE {where})"


def _rhos(parts: list[str], head: str = "") -> str:
    t = "least(abs(rho * sqrt((n - 2) / (1 - rho * rho))), 40)"
    return f"SELECT {head}d, i, n, round(rho, 6) AS rho, round({_tail(_STUDENT, 'tt')}, 6) + 0.0 AS p, {_SIZES} AS magnitude FROM (SELECT *, {t} AS tt FROM ({' UNION ALL '.join(parts)}))"


def _joint(v):
    ratio = lambda c: (C(c) / C("loc")).alias(f"{c}ratio")
    return v.joint.select("*", ratio("loac"), ratio("commits"), ratio("lch"), ratio("lofc"))


def _st1(v):
    rows = kept(S.complete(_joint(v)).select("uid", "snapshot_index", "commits", "lch", *_VARS))
    even = R.balanced(rows, C("fl") > 0, [C("uid") * 7919 % 10007, C("uid"), C("snapshot_index")])
    parts = [S.spearman(x, ["loc", "commits", "lch"], _VARS).withColumn("balanced", F.lit(b)) for x, b in ((rows, "F"), (even, "T"))]
    return parts[0].unionByName(parts[1])


_ST1 = [_rho(d, i, rows, f"'{b}' AS balanced, ") for rows, b in ((_KNOWN, "F"), (_EVEN, "T")) for d in ("loc", "commits", "lch") for i in _VARS if i != d]
query("st1_spearman", _rhos(_ST1, "balanced, "))(_st1)
_EXT = ["cnd", "fc", "fl", "loac", "loc", "neg"]
_SUBSETS = [(0, 0, "true"), (0, 1, "fl > 0"), (1, 0, "commits > 0"), (1, 1, "commits > 0 AND fl > 0")]


def _st2(v):
    rows = kept(v.joint.select("commits", "lch", *_EXT).fillna(0))
    out = [S.spearman(rows.filter(w), ["commits", "lch"], _EXT).select(F.lit(a).alias("changed_only"), F.lit(b).alias("annotated_only"), "d", "i", "n", "rho") for a, b, w in _SUBSETS]
    return functools.reduce(lambda x, y: x.unionByName(y), out)


query("st2_spearman_subsets", "SELECT changed_only, annotated_only, d, i, n, round(rho, 6) AS rho FROM (" + " UNION ALL ".join(_rho(d, i, "{joint}", f"{a} AS changed_only, {b} AS annotated_only, ", w) for a, b, w in _SUBSETS for d in ("commits", "lch") for i in _EXT) + ")")(_st2)
_LEGACY = ["loc", "fl", "fc", "cnd", "neg", "loac", "lofc", "loacratio", "lofcratio"]
query("st3_spearman_ratios", _rhos([_rho(d, i, _KNOWN) for d in ("commits", "lch", "commitsratio", "lchratio") for i in _LEGACY]))(
    lambda v: S.spearman(S.complete(_joint(v)), ["commits", "lch", "commitsratio", "lchratio"], _LEGACY))
_SPLITS = {"fl": "fl > 0", "fc": "fc > 1", "cnd": "cnd > 0", "neg": "neg > 0"}


def _diff(rows: str, head: str = "") -> str:
    one = lambda k, c: f"""SELECT {head}'{k}' AS split, n_trt, n_ctrl, u, (u - n_trt * n_ctrl / 2::DOUBLE - sign(u - n_trt * n_ctrl / 2::DOUBLE) * 0.5) / sqrt(n_trt::DOUBLE * n_ctrl / 12 * ((n_trt + n_ctrl + 1) - t / ((n_trt + n_ctrl)::DOUBLE * (n_trt + n_ctrl - 1)))) AS z,
  round(2 * u / (n_trt::DOUBLE * n_ctrl) - 1, 6) AS delta FROM (SELECT count(*) FILTER ({c}) AS n_trt, count(*) FILTER (NOT ({c})) AS n_ctrl, sum(r) FILTER ({c}) - count(*) FILTER ({c}) * (count(*) FILTER ({c}) + 1) / 2::DOUBLE AS u
  FROM (SELECT *, rank() OVER (ORDER BY lch) + (count(*) OVER (PARTITION BY lch) - 1) / 2.0::DOUBLE AS r FROM {rows})), (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS c FROM {rows} GROUP BY lch))"""  # noqa: E731
    return " UNION ALL ".join(one(k, c) for k, c in _SPLITS.items())


query("st4_mann_whitney", f"SELECT split, n_trt, n_ctrl, u, round(z, 6) AS z, round({_tail(_NORMAL, 'least(abs(z), 12)')}, 6) + 0.0 AS p FROM ({_diff('{joint}')})")(
    lambda v: S.group_differences(v.joint, "lch", {k: F.expr(c) for k, c in _SPLITS.items()}).drop("delta"))
query("st5_cliffs_delta", f"SELECT split, delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM ({_diff('{joint}')})")(
    lambda v: S.group_differences(v.joint, "lch", {k: F.expr(c) for k, c in _SPLITS.items()}).select("split", "delta", D.delta_magnitude(C("delta")).alias("magnitude")))
_FOLDS = 4
query("st5_cliffs_delta_folds", "SELECT split, count(*) AS folds, round(avg(delta), 5) AS delta, round(stddev_samp(delta), 5) AS sd_delta FROM (" + " UNION ALL ".join(f"({_diff(f'(SELECT * FROM {{joint}} WHERE uid * 7919 % 10007 % {_FOLDS} = {k})')})" for k in range(_FOLDS)) + ") GROUP BY split")(
    lambda v: S.group_differences(v.joint.withColumn("fold", C("uid") * 7919 % 10007 % _FOLDS), "lch", {k: F.expr(c) for k, c in _SPLITS.items()}, ["fold"])
    .groupBy("split").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("delta"), 5).alias("delta"), F.round(F.stddev_samp("delta"), 5).alias("sd_delta")))


def _tables(v):
    return v.joint.groupBy("snapshot_index").agg(*[F.count_if(x & y).alias(n) for n, x, y in (("a", C("fl") > 0, C("commits") > 0), ("b", C("fl") > 0, C("commits") == 0), ("c", C("fl") == 0, C("commits") > 0), ("d", C("fl") == 0, C("commits") == 0))])


query("st6_fisher_exact")(lambda v: S.fisher_table(_tables(v), ("a", "b", "c", "d"), ["snapshot_index"]))
query("st7_group_splits", "SELECT count(*) FILTER (fl > 0) AS fl, count(*) FILTER (fc > 1) AS fc, count(*) FILTER (cnd > 0) AS cnd, count(*) FILTER (neg > 0) AS neg, count(*) FILTER (loc > (SELECT median(loc) FROM {joint})) AS loc FROM {joint}")(
    lambda v: v.joint.crossJoin(v.joint.agg(F.median("loc").alias("m"))).agg(*[F.count_if(c).alias(k) for k, c in (("fl", C("fl") > 0), ("fc", C("fc") > 1), ("cnd", C("cnd") > 0), ("neg", C("neg") > 0), ("loc", C("loc") > C("m")))]))
_TERM = "formula int, term string, coef double, odds_ratio double, z double, p double, aic double, mcfadden double, warnings int, warning_messages string"


def _report(v, rows: list[dict], schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    return v.spark.createDataFrame([tuple(float(r[c]) if isinstance(r[c], float) else r[c] for c in names) for r in rows], schema)


def _logit(v):
    rows = S.regressors(S.complete(v.joint).withColumn("changed", (C("commits") > 0).cast("int")), "changed")
    return _report(v, S.logit_models(rows, "changed", S.FORMULAS), _TERM)


def _nb(v):
    rows = S.regressors(S.complete(v.joint), "commits", "lch")
    return _report(v, S.nb_models(rows, ["commits", "lch"], S.FORMULAS), "d string, " + _TERM + ", theta double, chisq double")


query("st8_logit")(_logit)
query("st9_negative_binomial")(_nb)
_C = "log2loc + log2mrc + log2pc + log2age"
query("st10_formulas", f"SELECT * FROM (VALUES (0, '{_C}'), (1, 'cnd + fc + neg + loacratio + {_C}'), (2, 'cnd + fl + neg + loacratio + {_C}'), (3, 'cnd + fc + fl + neg + loacratio + {_C}'), (4, 'log2cnd + log2fc + log2neg + loacratio + {_C}'), (5, 'log2cnd + log2fl + log2neg + loacratio + {_C}'), (6, 'log2cnd + log2fc + log2fl + log2neg + loacratio + {_C}')) t(formula, terms)")(
    lambda v: v.spark.createDataFrame([(k, " + ".join(x)) for k, x in S.FORMULAS.items()], "formula int, terms string"))
query("st11_effect_summaries", "SELECT d, i, round(min(abs(rho)), 4) AS absmin, round(median(rho), 4) AS median, round(max(abs(rho)), 4) AS absmax FROM {models} GROUP BY d, i")(
    lambda v: v.models.groupBy("d", "i").agg(F.round(F.min(F.abs("rho")), 4).alias("absmin"), F.round(F.median("rho"), 4).alias("median"), F.round(F.max(F.abs("rho")), 4).alias("absmax")))
query("st12_plot_inputs", "SELECT CAST(floor(log2(loc + 1)) AS BIGINT) AS x, CAST(floor(log2(lch + 1)) AS BIGINT) AS y, count(*) AS n FROM {joint} GROUP BY 1, 2")(
    lambda v: v.joint.groupBy(F.floor(F.log2(C("loc") + 1)).alias("x"), F.floor(F.log2(C("lch") + 1)).alias("y")).agg(F.count(F.lit(1)).alias("n")))
