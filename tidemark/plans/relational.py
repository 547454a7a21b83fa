"""Queries of projections, filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import derived as D
from tidemark.operators import joins as J
from tidemark.operators import rollups as R
from tidemark.operators import windows as W
from tidemark.operators.shared import task_count
from tidemark.plans.registry import query
from tidemark.plans.smells import SMELLS
from tidemark.sources import narrow as N

C = F.col
KEY = ["signature", "file"]

# --- roll-ups -------------------------------------------------------------------------------------------------

AGG1 = """SELECT signature, file, gross_loc, commit_id, bugfix, count(hunk) AS hunks, CAST(sum(added - deleted) AS BIGINT) AS line_delta,
  CAST(sum(deleted) AS BIGINT) AS lines_deleted, CAST(sum(added) AS BIGINT) AS lines_added FROM {hunks} GROUP BY ALL"""
query("agg1_hunks_to_commits", AGG1)(lambda v: R.hunks_to_commits(v.hunks))
query("agg2_commits_to_snapshot", f"""SELECT signature, file, max(gross_loc) AS gross_loc, CAST(sum(hunks) AS BIGINT) AS hunks, count(commit_id) AS commits, CAST(sum(bugfix) AS BIGINT) AS bugfixes,
  CAST(sum(line_delta) AS BIGINT) AS line_delta, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted, CAST(sum(lines_added) AS BIGINT) AS lines_added FROM ({AGG1}) GROUP BY ALL""")(
    lambda v: R.commits_to_snapshot(R.hunks_to_commits(v.hunks)))
MEASURES = """SELECT uid, snapshot_index, count(DISTINCT commit_id) FILTER (mod_type IN ('MOD', 'MOVE')) AS commits, CAST(coalesce(sum(added) FILTER (mod_type IN ('MOD', 'MOVE')), 0) AS BIGINT) AS lines_added,
  CAST(coalesce(sum(deleted) FILTER (mod_type IN ('MOD', 'MOVE')), 0) AS BIGINT) AS lines_deleted, CAST(coalesce(sum(added + deleted) FILTER (mod_type IN ('MOD', 'MOVE')), 0) AS BIGINT) AS lines_changed
  FROM {changes} GROUP BY uid, snapshot_index"""
query("agg3_distinct_commits", f"SELECT uid, snapshot_index, commits FROM ({MEASURES})")(lambda v: R.window_measures(v.changes).select("uid", "snapshot_index", "commits"))
query("agg4_line_sums", f"SELECT uid, snapshot_index, lines_added, lines_deleted, lines_changed FROM ({MEASURES})")(
    lambda v: R.window_measures(v.changes).drop("commits"))
query("agg5_change_stats", """SELECT uid, count(DISTINCT commit_id) AS commits, CAST(sum(CASE WHEN mod_type IN ('MOD', 'MOVE') THEN added + deleted ELSE 0 END) AS BIGINT) AS lines_changed FROM {changes} GROUP BY uid""")(
    lambda v: N.change_stats(v.orders, v.lineitem, v.part))
query("agg6_history_before", """SELECT s.uid, s.start, count(DISTINCT c.commit_id) AS previous_commits, CAST(coalesce(sum(c.added + c.deleted), 0) AS BIGINT) AS previous_lines
  FROM (SELECT DISTINCT uid, snapshot_index AS start FROM {changes}) s LEFT JOIN {changes} c ON c.uid = s.uid AND c.snapshot_index < s.start AND c.mod_type IN ('MOD', 'MOVE') GROUP BY s.uid, s.start""")(
    lambda v: N.history_before(v.orders, v.lineitem, v.part))
WORDS = """list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')), ' '), lambda w: w <> '')"""
query("agg7_word_count", f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM {{conversations}}) GROUP BY word")(
    lambda v: R.word_counts(v.conversations, D.message_words(C("text"))))
query("agg8_commits_per_file", "SELECT file, count(*) AS commits FROM (SELECT DISTINCT file, commit_id FROM {hunks}) GROUP BY file")(lambda v: R.commits_per_file(v.hunks))
query("agg9_ordered_changes", """SELECT commit_id, string_agg(hunk || ':' || mod_type || ':' || uid, ' ' ORDER BY hunk, CASE mod_type WHEN 'ADD' THEN 1 WHEN 'MOVE' THEN 2 WHEN 'MOD' THEN 3 ELSE 4 END, uid) AS changes
  FROM {hunks} GROUP BY commit_id""")(lambda v: R.ordered_changes(v.hunks))
query("agg11_rounded_metrics", "SELECT file, CAST(floor(avg(loc) + 0.5) AS BIGINT) AS loc, CAST(floor(avg(loac) + 0.5) AS BIGINT) AS loac FROM {metrics} GROUP BY file")(
    lambda v: v.metrics.groupBy("file").agg(D.java_round(F.avg("loc")).alias("loc"), D.java_round(F.avg("loac")).alias("loac")))
query("agg12_tracking_errors", """WITH c AS (SELECT DISTINCT uid, snapshot_index FROM {changes} WHERE mod_type <> 'DEL'), a AS (SELECT DISTINCT uid, snapshot_index FROM {changes} WHERE hunk < 5),
  n AS (SELECT coalesce(c.snapshot_index, a.snapshot_index) AS snapshot_index, count(*) FILTER (c.uid IS NOT NULL AND a.uid IS NOT NULL) AS matching,
  count(*) FILTER (c.uid IS NULL) AS missing, count(*) FILTER (a.uid IS NULL) AS superfluous FROM c FULL JOIN a ON c.uid = a.uid AND c.snapshot_index = a.snapshot_index GROUP BY 1)
  SELECT *, CAST(floor(100.0::DOUBLE * missing / (matching + missing) + 0.5) AS BIGINT) AS perc_missing, CAST(floor(100.0::DOUBLE * superfluous / (matching + missing) + 0.5) AS BIGINT) AS perc_superfluous FROM n""")(
    lambda v: J.tracking_errors(v.changes.filter("mod_type <> 'DEL'"), v.changes.filter("hunk < 5"), ["uid", "snapshot_index"], "snapshot_index"))
query("agg13_request_stats", """SELECT snapshot_index, count(*) AS requests, count(*) FILTER (age IS NULL) AS unknown, CAST(floor(100.0::DOUBLE * count(*) FILTER (age IS NULL) / count(*) + 0.5) AS BIGINT) AS perc_unknown
  FROM {joint} GROUP BY snapshot_index""")(lambda v: v.joint.groupBy("snapshot_index").agg(F.count(F.lit(1)).alias("requests"), F.count_if(C("age").isNull()).alias("unknown"),
    D.java_round(100.0 * F.count_if(C("age").isNull()) / F.count(F.lit(1))).alias("perc_unknown")))
_METRICS = " UNION ALL ".join(f"SELECT snapshot, '{k}' AS metric, {p} AS s, fixes > 0 AS f, fixes, sloc FROM {{smells}}" for k, p in SMELLS.items())
AGG14 = f"""SELECT snapshot, metric, count(*) FILTER (s AND f) AS fs, count(*) FILTER (NOT s AND f) AS fns, count(*) FILTER (s AND NOT f) AS nfs, count(*) FILTER (NOT s AND NOT f) AS nfns,
  CAST(coalesce(sum(fixes) FILTER (s), 0) AS BIGINT) AS fixes_smelly, CAST(coalesce(sum(fixes) FILTER (NOT s), 0) AS BIGINT) AS fixes_clean,
  CAST(floor(avg(sloc) FILTER (s) + 0.5) AS BIGINT) AS mean_sloc_smelly, CAST(floor(avg(sloc) FILTER (NOT s) + 0.5) AS BIGINT) AS mean_sloc_clean,
  CAST(floor(median(sloc) FILTER (s) + 0.5) AS BIGINT) AS median_sloc_smelly, CAST(floor(median(sloc) FILTER (NOT s) + 0.5) AS BIGINT) AS median_sloc_clean FROM ({_METRICS}) GROUP BY snapshot, metric"""
query("agg14_contingency", AGG14)(lambda v: R.contingency(v.smells, "snapshot", D.SMELL_PREDICATES))
query("agg15_rounded_mean_median", "SELECT source, CAST(floor(avg(n_chars) + 0.5) AS BIGINT) AS mean, CAST(floor(median(n_chars) + 0.5) AS BIGINT) AS median FROM {documents} GROUP BY source")(
    lambda v: v.documents.groupBy("source").agg(D.java_round(F.avg("n_chars")).alias("mean"), D.java_round(F.median("n_chars")).alias("median")))
query("agg16_upper_fraction", """WITH r AS (SELECT snapshot, score, row_number() OVER (PARTITION BY snapshot ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY snapshot) AS n FROM {smells})
  SELECT snapshot, score AS threshold FROM r WHERE r = least(greatest(n - floor(n * 0.3::DOUBLE + 0.5), 0), n - 1)""")(lambda v: R.upper_fraction_threshold(v.smells, "score", 0.3, ["snapshot"]))
query("agg17_large_files", """WITH r AS (SELECT snapshot, sloc, row_number() OVER (PARTITION BY snapshot ORDER BY sloc) - 1 AS r, count(*) OVER (PARTITION BY snapshot) AS n FROM {smells})
  SELECT snapshot, sloc AS threshold FROM r WHERE r = least(floor(n - n * 25.0::DOUBLE / 100 + 0.5), n - 1)""")(lambda v: R.large_threshold(v.smells, "sloc", 25.0, ["snapshot"]))
AGG18 = """SELECT d, i, round(avg(rho), 4) AS mean, round(median(rho), 4) AS median, round(min(rho), 4) AS min, round(max(rho), 4) AS max, round(min(abs(rho)), 4) AS absmin, round(max(abs(rho)), 4) AS absmax FROM {models} GROUP BY d, i"""
query("agg18_averages", AGG18)(lambda v: R.averages(v.models, "rho", ["d", "i"]))
query("agg19_mean_sd_se", "SELECT system, count(coef) AS n, round(avg(coef), 6) AS mean, round(stddev_samp(coef), 6) AS sd, round(stddev_samp(coef) / sqrt(count(coef)), 6) AS se FROM {models} GROUP BY system")(
    lambda v: R.mean_sd_se(v.models, "coef", ["system"]))
query("agg20_binary_stats", """SELECT count(*) FILTER (NOT c) AS n_false, count(*) FILTER (c) AS n_true, round(count(*) FILTER (c) / (count(*) FILTER (NOT c))::DOUBLE, 6) AS odds,
  round(count(*) FILTER (c) / count(*)::DOUBLE, 6) AS likelihood FROM (SELECT commits > 0 AS c FROM {joint})""")(lambda v: R.binary_stats(v.joint, C("commits") > 0))
query("agg21_metric_stats", " UNION ALL ".join(f"SELECT '{x}' AS variable, round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round(stddev_samp({x}), 6) AS sd FROM {{joint}}" for x in ("loc", "fl", "commits", "lch", "age")))(
    lambda v: R.metric_stats(v.joint, ["loc", "fl", "commits", "lch", "age"]))
query("agg22_ratios_by_level", " UNION ALL ".join(f"SELECT snapshot_index, '{m}' AS marker, round(CAST(sum(lch) FILTER ({c}) AS DOUBLE) / sum(loc) FILTER ({c}), 6) AS value FROM {{joint}} GROUP BY snapshot_index" for m, c in (("none", "fl = 0"), ("one", "fl = 1"), ("more", "fl >= 2"))))(
    lambda v: R.ratios_by_level(v.joint, "fl", "lch", "loc", "snapshot_index"))
query("agg23_frequencies", "SELECT commits, count(*) AS n FROM {joint} GROUP BY commits")(lambda v: v.joint.groupBy("commits").agg(F.count(F.lit(1)).alias("n")))
query("agg24_histogram", "SELECT CAST(CASE WHEN lch < 0 THEN 0 WHEN lch >= 200 THEN 11 ELSE floor(lch / 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM {joint} GROUP BY 1")(lambda v: R.histogram(v.joint, "lch", 0.0, 200.0, 10))
query("agg25_box_stats", "SELECT fl, count(lch) AS n, " + ", ".join(f"round(quantile_cont(lch, {q}), 6) AS {k}" for q, k in ((0, "low"), (0.25, "q1"), (0.5, "mid"), (0.75, "q3"), (1, "high"))) + " FROM {joint} GROUP BY fl")(
    lambda v: R.box_stats(v.joint, "lch", ["fl"]))
query("agg26_subject_stats", """SELECT min(f.loc) AS min_loc, max(f.loc) AS max_loc, count(DISTINCT f.file) AS files, CAST(sum(f.loc) AS BIGINT) AS loc, count(m.nofl) AS annotated,
  CAST(round(100.0 * count(m.nofl) / count(*)) AS BIGINT) AS perc FROM {functions} f LEFT JOIN {metrics} m ON f.signature = m.signature AND f.file = m.file""")(
    lambda v: v.functions.join(v.metrics.select(*KEY, "nofl"), KEY, "left").agg(F.min("loc").alias("min_loc"), F.max("loc").alias("max_loc"), F.count_distinct("file").alias("files"),
    F.sum("loc").cast("long").alias("loc"), F.count("nofl").alias("annotated"), F.round(100.0 * F.count("nofl") / F.count(F.lit(1))).cast("long").alias("perc")))
query("agg27_significance_tally", "SELECT d, i, count(*) FILTER (p < 0.01) AS significant, count(*) FILTER (p >= 0.01) AS not_significant FROM {models} GROUP BY d, i")(
    lambda v: v.models.groupBy("d", "i").agg(F.count_if(C("p") < 0.01).alias("significant"), F.count_if(C("p") >= 0.01).alias("not_significant")))
query("agg28_fold_averages", "SELECT d, i, formula, round(avg(p), 6) + 0.0 AS p, round(coalesce(stddev_samp(p), 0.0), 6) AS sd_p, round(avg(rho), 6) + 0.0 AS effect, round(coalesce(stddev_samp(rho), 0.0), 6) AS sd_effect FROM {models} GROUP BY d, i, formula")(
    lambda v: R.fold_averages(v.models.withColumn("effect", C("rho")), ["d", "i", "formula"]))
query("agg29_relevant_commits", "SELECT project, count(*) FILTER (is_c) AS relevant FROM {commits} GROUP BY project")(lambda v: v.commits.groupBy("project").agg(F.count_if("is_c").alias("relevant")))
query("agg32_medians_of_changed", "SELECT median(commits) FILTER (commits > 0) AS commits, median(lch) FILTER (commits > 0) AS lch, median(loc) FILTER (commits > 0) AS loc, median(age) FILTER (commits > 0) AS age FROM {joint}")(
    lambda v: v.joint.agg(*[F.median(F.when(C("commits") > 0, C(c))).alias(c) for c in ("commits", "lch", "loc", "age")]))
query("agg33_sloc", "SELECT doc_id, CAST(CASE WHEN length(text) = length(replace(text, chr(10), '')) AND length(text) > 0 THEN 1 ELSE length(text) - length(replace(text, chr(10), '')) END AS BIGINT) AS sloc FROM {documents}")(
    lambda v: v.documents.select("doc_id", D.sloc(C("text")).cast("long").alias("sloc")))
query("agg34_smell_ratios", f"""SELECT snapshot, metric, round(fs / nullif(fs + fns, 0)::DOUBLE, 6) AS fixed_share, round((fs + nfs) / nullif(fs + fns + nfs + nfns, 0)::DOUBLE, 6) AS smelly_share,
  round(fixes_smelly / nullif(fixes_smelly + fixes_clean, 0)::DOUBLE, 6) AS fixes_share FROM ({AGG14})""")(lambda v: R.contingency(v.smells, "snapshot", D.SMELL_PREDICATES).select("snapshot", "metric",
    F.round(F.try_divide(C("fs"), C("fs") + C("fns")), 6).alias("fixed_share"), F.round(F.try_divide(C("fs") + C("nfs"), C("fs") + C("fns") + C("nfs") + C("nfns")), 6).alias("smelly_share"),
    F.round(F.try_divide(C("fixes_smelly"), C("fixes_smelly") + C("fixes_clean")), 6).alias("fixes_share")))
query("agg35_bubbles", "SELECT CAST(round_even(loc / 12.0, 0) * 12 AS BIGINT) AS bin, commits, count(*) AS n, round(sqrt(count(*)) / pi(), 6) AS radius FROM {joint} GROUP BY 1, 2")(
    lambda v: v.joint.groupBy(D.grid(C("loc")).alias("bin"), "commits").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.count(F.lit(1))) / F.lit(3.141592653589793), 6).alias("radius")))
query("agg36_smell_share_boxes", f"WITH s AS (SELECT metric, (fs + nfs) / (fs + fns + nfs + nfns)::DOUBLE AS share FROM ({AGG14})) SELECT metric, count(share) AS n, " + ", ".join(f"round(quantile_cont(share, {q}), 6) AS {k}" for q, k in ((0, "low"), (0.25, "q1"), (0.5, "mid"), (0.75, "q3"), (1, "high"))) + " FROM s GROUP BY metric")(
    lambda v: R.box_stats(R.contingency(v.smells, "snapshot", D.SMELL_PREDICATES).withColumn("share", (C("fs") + C("nfs")) / (C("fs") + C("fns") + C("nfs") + C("nfns"))), "share", ["metric"]))

# --- joins ---

query("jn1_lookup_commit", "SELECT commit_id, hunk, uid, ord FROM {hunks} JOIN {commits} USING (commit_id)")(lambda v: J.lookup_or_fail(v.hunks, v.commits).select("commit_id", "hunk", "uid", "ord"))
query("jn2_full_coverage", """SELECT f.signature, f.file, coalesce(m.loc, f.loc) AS loc, coalesce(nofl, 0) AS nofl, coalesce(loac, 0) AS loac FROM {functions} f LEFT JOIN {metrics} m ON f.signature = m.signature AND f.file = m.file""")(
    lambda v: J.full_coverage(v.functions, v.metrics, ["nofl", "loac"]))
query("jn3_identical_functions", "SELECT o.snapshot_index AS older, count(*) AS n FROM {joint} o JOIN {joint} n ON n.snapshot_index = o.snapshot_index + 1 AND o.signature = n.signature AND o.file = n.file GROUP BY 1")(
    lambda v: J.snapshot_pairs(v.joint.select("snapshot_index", *KEY)).filter("old IS NOT NULL AND new IS NOT NULL").groupBy("older").agg(F.count(F.lit(1)).alias("n")))
query("jn4_added_functions", "SELECT n.snapshot_index, n.signature, n.file FROM {joint} n LEFT JOIN {joint} o ON n.snapshot_index = o.snapshot_index + 1 AND o.signature = n.signature AND o.file = n.file WHERE o.signature IS NULL AND n.snapshot_index > 0")(
    lambda v: J.added_functions(v.joint, task_count(v.lineitem, v.orders)))
query("jn5_changed_metric", """SELECT n.snapshot_index, n.signature, n.file, o.lch AS old, n.lch AS new FROM {joint} n JOIN {joint} o ON n.snapshot_index = o.snapshot_index + 1 AND o.signature = n.signature AND o.file = n.file
  WHERE o.lch <> n.lch AND o.commits > 0""")(lambda v: J.changed_metric(v.joint, "lch"))
query("jn6_averages_to_detail", """SELECT m.system, m.d, m.i, m.formula, round(m.rho - a.mean, 4) AS off FROM {models} m JOIN (SELECT d, i, avg(rho) AS mean FROM {models} GROUP BY d, i) a ON m.d = a.d AND m.i = a.i""")(
    lambda v: v.models.join(v.models.groupBy("d", "i").agg(F.avg("rho").alias("mean")), ["d", "i"]).select("system", "d", "i", "formula", F.round(C("rho") - C("mean"), 4).alias("off")))
_KINDS = ("PROMO", "ECONOMY", "STANDARD", "LARGE")
_FIRST = "(SELECT system, i, arg_min(coef, formula * 1000000 + coef) AS coef FROM {models} GROUP BY system, i)"
query("jn7_pivot", "SELECT a.system, " + ", ".join(f"t{k}.coef AS c{k}" for k in range(4)) + " FROM (SELECT DISTINCT system FROM {models}) a " + " ".join(f"{'LEFT ' if k == 3 else ''}JOIN {_FIRST} t{k} ON t{k}.system = a.system AND t{k}.i = '{n}'" for k, n in enumerate(_KINDS)))(
    lambda v: J.pivoted(v.models.withColumn("at", C("formula") * 1000000 + C("coef")), "system", "i", "coef", "at", _KINDS).select("system", *[C(n).alias(f"c{k}") for k, n in enumerate(_KINDS)]))
query("jn8_left_totals", "SELECT f.file, count(*) AS functions, CAST(coalesce(sum(m.loac), 0) AS BIGINT) AS loac FROM {functions} f LEFT JOIN {metrics} m ON f.signature = m.signature AND f.file = m.file GROUP BY f.file")(
    lambda v: v.functions.join(v.metrics.select(*KEY, "loac"), KEY, "left").groupBy("file").agg(F.count(F.lit(1)).alias("functions"), F.coalesce(F.sum("loac"), F.lit(0)).cast("long").alias("loac")))
query("jn9_edit_spans", """SELECT e.commit_id, e.file, begin_a, end_a, signature, CAST(CASE WHEN begin_a <= start1 - 1 AND end_a > end1 - 1 THEN end1 - start1 + 1 WHEN begin_a >= start1 - 1 AND end_a <= end1 - 1 THEN end_a - begin_a
  WHEN begin_a > start1 - 1 THEN end1 - 1 - begin_a ELSE end_a - (start1 - 1) END AS BIGINT) AS lines, begin_a <= start1 - 1 AND end_a > end1 - 1 AS covers, begin_a < start1 - 1 + sig_loc AND end_a > start1 - 1 AS touches_signature
  FROM {edits} e JOIN {spans} s ON e.file = s.file AND begin_a < end1 AND end_a > start1 - 1""")(lambda v: J.overlaps(v.edits, v.spans))
query("jn11_similar_moves", """WITH d AS (SELECT p_partkey - p_partkey % 20 AS commit_id, p_partkey AS id, p_name AS a FROM {part} WHERE p_partkey % 20 < 10), x AS (SELECT p_partkey - p_partkey % 20 AS commit_id, p_partkey AS id, p_name AS b FROM {part} WHERE p_partkey % 20 >= 10)
  SELECT d.commit_id, d.id AS deleted, x.id AS added, (greatest(length(a), length(b), 1) - levenshtein(a, b)) / greatest(length(a), length(b), 1)::DOUBLE AS similarity FROM d JOIN x USING (commit_id)
  WHERE (greatest(length(a), length(b), 1) - levenshtein(a, b)) / greatest(length(a), length(b), 1)::DOUBLE >= 0.6""")(
    lambda v: J.similar_moves(*[v.part.filter(h).select((C("p_partkey") - C("p_partkey") % 20).alias("commit_id"), C("p_partkey").alias("id"), "p_name") for h in ("p_partkey % 20 < 10", "p_partkey % 20 >= 10")], ["commit_id"], "p_name"))
query("jn12_same_name_moves", "SELECT a.commit_id, a.name, a.id AS deleted, b.id AS added FROM {sides} a JOIN {sides} b ON a.commit_id = b.commit_id AND a.parent = b.parent AND a.name = b.name WHERE a.side = 'A' AND b.side = 'B'")(
    lambda v: J.same_name_moves(*[v.sides.filter(C("side") == m).select("commit_id", "parent", "name", "id") for m in "AB"], ["commit_id", "parent"], "name").drop("parent"))
query("jn13_by_basename", """WITH n AS (SELECT (doc_id % 50) || '.c' AS name, count(*) AS fixes FROM {documents} GROUP BY 1) SELECT file, split_part(file, '/', -1) AS name, coalesce(n.fixes, 0) AS fixes FROM {smells} s LEFT JOIN n ON split_part(s.file, '/', -1) = n.name""")(
    lambda v: J.by_basename(v.smells.select("file"), v.documents.groupBy(F.concat((C("doc_id") % 50).cast("string"), F.lit(".c")).alias("name")).agg(F.count(F.lit(1)).alias("fixes")), "fixes"))
query("jn14_scores_per_smell", "SELECT file, max(score) FILTER (ab > 0) AS ab, max(score) FILTER (af > 0) AS af, max(score) FILTER (lf > 0) AS lf FROM {smells} GROUP BY file")(
    lambda v: v.smells.groupBy("file").agg(*[F.max(F.when(C(k) > 0, C("score"))).alias(k) for k in ("ab", "af", "lf")]))
query("jn15_start_snapshot", "SELECT commit_id, c.ts, snapshot_index FROM {commits} c JOIN {snapshots} s ON CAST(c.ts AS DATE) = snapshot_date")(
    lambda v: v.commits.join(v.snapshots, F.to_date("ts") == C("snapshot_date")).select("commit_id", "ts", "snapshot_index"))
query("jn16_paste", "SELECT a.functions, b.commits FROM (SELECT count(*) AS functions FROM {functions}) a CROSS JOIN (SELECT count(*) AS commits FROM {commits}) b")(
    lambda v: v.functions.agg(F.count(F.lit(1)).alias("functions")).crossJoin(v.commits.agg(F.count(F.lit(1)).alias("commits"))))
query("jn17_model_lookup", """SELECT s.d, s.i, s.formula, printf('%.6f', s.coef) AS mean, printf('%.6f', m.coef) AS coef FROM (SELECT d, i, formula, avg(coef) AS coef FROM {models} GROUP BY d, i, formula) s
  JOIN (SELECT d, i, formula, min(coef) AS coef FROM {models} WHERE system = 'Brand#11' GROUP BY d, i, formula) m ON s.d = m.d AND s.i = m.i AND s.formula = m.formula WHERE s.formula = 3""")(
    lambda v: v.models.filter("formula = 3").groupBy("d", "i", "formula").agg(F.avg("coef").alias("mean")).join(v.models.filter("system = 'Brand#11' AND formula = 3").groupBy("d", "i", "formula").agg(F.min("coef").alias("coef")), ["d", "i", "formula"])
    .select("d", "i", "formula", F.format_string("%.6f", "mean").alias("mean"), F.format_string("%.6f", "coef").alias("coef")))
query("jn18_joined_summaries", "SELECT i, round(avg(coef), 6) AS coef, round(avg(rho), 6) AS rho, count(*) AS n FROM {models} GROUP BY i")(
    lambda v: v.models.groupBy("i").agg(F.round(F.avg("coef"), 6).alias("coef"), F.round(F.avg("rho"), 6).alias("rho"), F.count(F.lit(1)).alias("n")))
query("jn19_branch_of_first", "SELECT s.project, s.commit_id, c.ord FROM (SELECT project, arg_min(commit_id, ord) AS commit_id FROM {commits} GROUP BY project) s JOIN {commits} c ON s.commit_id = c.commit_id")(
    lambda v: v.commits.groupBy("project").agg(F.min_by("commit_id", "ord").alias("commit_id")).join(v.commits.select("commit_id", "ord"), "commit_id"))

# --- sets, samples, top ---

query("set1_leftover_commits", "SELECT commit_id, DATE '1970-01-01' AS snapshot_date FROM {commits} WHERE commit_id NOT IN (SELECT commit_id FROM {hunks})")(
    lambda v: J.without(v.commits, v.hunks.select("commit_id"), ["commit_id"]).select("commit_id", F.lit("1970-01-01").cast("date").alias("snapshot_date")))
query("set2_appeared", "SELECT signature FROM {changes} WHERE snapshot_index = 1 EXCEPT SELECT signature FROM {changes} WHERE snapshot_index = 0")(
    lambda v: J.without(v.changes.filter("snapshot_index = 1").select("signature"), v.changes.filter("snapshot_index = 0").select("signature"), ["signature"]).distinct())
query("set3_moved_functions", """WITH o AS (SELECT DISTINCT signature FROM {changes} WHERE snapshot_index = 0), n AS (SELECT DISTINCT signature FROM {changes} WHERE snapshot_index = 1)
  SELECT coalesce(o.signature, n.signature) AS signature, CASE WHEN o.signature IS NULL THEN 'created' WHEN n.signature IS NULL THEN 'deleted' ELSE 'moved' END AS status FROM o FULL JOIN n ON o.signature = n.signature""")(
    lambda v: J.moved_functions(v.changes.filter("snapshot_index = 0").select("signature").distinct(), v.changes.filter("snapshot_index = 1").select("signature").distinct(), ["signature"]))
query("set4_matching", "SELECT signature FROM {changes} WHERE snapshot_index = 0 INTERSECT SELECT signature FROM {changes} WHERE snapshot_index = 1")(
    lambda v: v.changes.filter("snapshot_index = 0").select("signature").intersect(v.changes.filter("snapshot_index = 1").select("signature")))
query("set5_union", "SELECT 'functions' AS dataset, signature, loc FROM {functions} UNION ALL SELECT 'metrics', signature, loc FROM {metrics}")(
    lambda v: v.functions.select(F.lit("functions").alias("dataset"), "signature", "loc").unionByName(v.metrics.select(F.lit("metrics").alias("dataset"), "signature", "loc")))
query("set6_distinct", "SELECT DISTINCT i, d FROM {models}")(lambda v: v.models.select("i", "d").distinct())
query("smp1_sample", "SELECT uid, loc FROM {functions} ORDER BY uid * 7919 % 10007, uid LIMIT 100")(lambda v: v.functions.select("uid", "loc").orderBy(C("uid") * 7919 % 10007, "uid").limit(100))
query("smp2_resize", """WITH f AS (SELECT uid, CASE WHEN uid % 50 = 0 THEN 1 ELSE 0 END AS grp FROM {functions}), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY uid * 7919 % 10007, uid) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM f)
  SELECT grp, uid, i AS copy FROM (SELECT *, unnest(range(CASE WHEN r < 100 THEN (99 - r) // n + 1 ELSE 0 END)) AS i FROM r)""")(
    lambda v: R.resized(v.functions.select(F.when(C("uid") % 50 == 0, 1).otherwise(0).alias("grp"), "uid"), ["grp"], 100, [C("uid") * 7919 % 10007, C("uid")]))
query("smp3_balanced", """WITH r AS (SELECT uid, snapshot_index, fl > 0 AS a, row_number() OVER (PARTITION BY fl > 0 ORDER BY uid * 7919 % 10007, uid, snapshot_index) AS r FROM {joint}), n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM r GROUP BY a))
  SELECT uid, snapshot_index, a FROM r, n WHERE r <= c""")(lambda v: R.balanced(v.joint.select("uid", "snapshot_index", (C("fl") > 0).alias("a")), C("a"), [C("uid") * 7919 % 10007, C("uid"), C("snapshot_index")]))
query("smp4_stratified", """SELECT file, a, uid FROM (SELECT file, loc % 4 > 0 AS a, uid, row_number() OVER (PARTITION BY file, loc % 4 > 0 ORDER BY uid) AS r FROM {functions}) WHERE r <= 2""")(
    lambda v: _ranked(v.functions.select("file", (C("loc") % 4 > 0).alias("a"), "uid"), ["file", "a"], [C("uid")]).filter("r <= 2").drop("r"))
query("smp5_folds", "SELECT uid, CAST((row_number() OVER (ORDER BY uid * 7919 % 10007, uid) - 1) % greatest(1, count(*) OVER () // 300) AS BIGINT) AS fold FROM {functions}")(
    lambda v: R.folds(v.functions.select("uid"), 300, [C("uid") * 7919 % 10007, C("uid")]))
query("top1_top_features", """WITH f AS (SELECT p_name || p_partkey AS name, p_size AS loc, p_partkey % 37 AS occ, p_partkey % 11 AS cu, count(*) OVER () AS n FROM {part}),
  r AS (SELECT name, n, row_number() OVER (ORDER BY loc, name) - 1 AS a, row_number() OVER (ORDER BY occ, name) - 1 AS b, row_number() OVER (ORDER BY cu, name) - 1 AS c FROM f)
  SELECT name FROM r WHERE a >= floor(n - n * 5.0 / 100 + 0.5) OR b >= floor(n - n * 3.0 / 100 + 0.5) OR c >= n""")(
    lambda v: R.top_features(v.part.select(F.concat("p_name", C("p_partkey").cast("string")).alias("name"), C("p_size").alias("loc"), (C("p_partkey") % 37).alias("occ"), (C("p_partkey") % 11).alias("cu")), {"loc": 5.0, "occ": 3.0, "cu": 0.0}))
query("top2_newest_snapshot", "SELECT snapshot_index, snapshot_date FROM {snapshots} ORDER BY snapshot_date DESC LIMIT 1")(lambda v: v.snapshots.orderBy(C("snapshot_date").desc()).limit(1))
_BRANCHES = "(SELECT project, commit_id % 3 AS lane, ts, row_number() OVER (PARTITION BY project, commit_id % 3 ORDER BY ord) AS place FROM {commits} WHERE is_c)"
query("top3_longest_branch", f"""SELECT project, lane, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, max(place) AS commits FROM {_BRANCHES} b
  WHERE (project, lane) = (SELECT (project, lane) FROM {_BRANCHES} ORDER BY place DESC, project, lane LIMIT 1) GROUP BY project, lane""")(
    lambda v: W.branch_positions(v.commits.withColumn("lane", C("commit_id") % 3), "lane", "ord").groupBy("project", "lane")
    .agg(F.max("branch_position").alias("commits"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day")).orderBy(C("commits").desc(), "project", "lane").limit(1))
query("top4_skip_relevant", "SELECT project, ord FROM (SELECT project, ord, is_c, sum(CAST(is_c AS INT)) OVER (PARTITION BY project ORDER BY ord) AS n FROM {commits}) WHERE is_c AND n = 20")(
    lambda v: _running(v.commits).filter("is_c AND n = 20").select("project", "ord"))
query("top5_best_partner", """WITH d AS (SELECT p_partkey - p_partkey % 20 AS c, p_partkey AS id, p_name AS a FROM {part} WHERE p_partkey % 20 < 10), x AS (SELECT p_partkey - p_partkey % 20 AS c, p_partkey AS id, p_name AS b FROM {part} WHERE p_partkey % 20 >= 10)
  SELECT deleted, added FROM (SELECT d.id AS deleted, x.id AS added, row_number() OVER (PARTITION BY d.id ORDER BY (greatest(length(a), length(b), 1) - levenshtein(a, b)) / greatest(length(a), length(b), 1)::DOUBLE DESC, x.id) AS r FROM d JOIN x USING (c)) WHERE r = 1""")(
    lambda v: J.similar_moves(*[v.part.filter(h).select((C("p_partkey") - C("p_partkey") % 20).alias("c"), C("p_partkey").alias("id"), "p_name") for h in ("p_partkey % 20 < 10", "p_partkey % 20 >= 10")], ["c"], "p_name", 0.0)
    .groupBy("deleted").agg(F.max_by("added", F.struct("similarity", -C("added"))).alias("added")))


def _ranked(rows, by, order):
    from pyspark.sql import Window

    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _running(commits):
    from pyspark.sql import Window

    return commits.withColumn("n", F.sum(C("is_c").cast("int")).over(Window.partitionBy("project").orderBy("ord")))
