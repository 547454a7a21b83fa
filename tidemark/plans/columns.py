"""Queries of derived columns, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import derived as D
from tidemark.operators import joins as J
from tidemark.operators import stats as S
from tidemark.operators.shared import kept
from tidemark.plans.registry import query
from tidemark.plans.smells import SMELLS
from tidemark.sources import tables as T

C = F.col


def derive(name: str, view: str, sql: str, keys: list[str], columns):
    """A query of keys and derived columns over one view; sql lists the derived columns, columns() makes them (columns need a session)."""
    query(name, f"SELECT {', '.join(keys)}, {sql} FROM {{{view}}}")(lambda v: getattr(v, view).select(*keys, *[c.alias(k) for k, c in columns().items()]))


def keep(name: str, view: str, where: str, keys: list[str], condition):
    """A query of the rows of one view that a predicate keeps."""
    query(name, f"SELECT {', '.join(keys)} FROM {{{view}}} WHERE {where}")(lambda v: getattr(v, view).filter(condition()).select(*keys))


HUNK = ["uid", "commit_id", "hunk"]
JOINT = ["uid", "snapshot_index"]
MODEL = ["system", "d", "i", "formula"]

derive("prj1_column_functions", "hunks", "upper(mod_type) AS kind, added + deleted AS changed", HUNK, lambda: dict(kind=F.upper("mod_type"), changed=C("added") + C("deleted")))
derive("prj2_line_delta", "hunks", "added - deleted AS line_delta", HUNK, lambda: dict(line_delta=D.line_delta("added", "deleted")))
derive("prj3_lines_changed", "hunks", "added + deleted AS lines_changed", HUNK, lambda: dict(lines_changed=D.lines_changed("added", "deleted")))
derive("prj4_rounded", "joint", "CAST(round_even(lch / 4.0, 0) AS INT) AS lch4", JOINT, lambda: dict(lch4=D.rounded_int(C("lch") / 4)))
derive("prj5_aliases", "joint", "lch AS lines_changed, pc AS previous_commits, mrc AS last_edit, fc AS fc_nondup", JOINT, lambda: dict(lines_changed=C("lch"), previous_commits=C("pc"), last_edit=C("mrc"), fc_nondup=C("fc")))
derive("prj6_ratios", "joint", "round(loac / nullif(loc, 0)::DOUBLE, 6) AS loac_ratio, round(lofc / nullif(loc, 0)::DOUBLE, 6) AS lofc_ratio, round(commits / nullif(loc, 0)::DOUBLE, 6) AS commits_ratio, round(lch / nullif(loc, 0)::DOUBLE, 6) AS lch_ratio", JOINT, lambda: {f"{c}_ratio": F.round(D.ratio(c, "loc"), 6) for c in ("loac", "lofc", "commits", "lch")})
derive("prj7_logs", "joint", "round(log2(commits + 1), 6) AS log_commits, round(log2(nullif(loc, 0)), 6) AS log_loc, round(sqrt(lch), 6) AS root_lch", JOINT, lambda: dict(log_commits=F.round(D.log2p("commits"), 6), log_loc=F.round(F.log2("loc"), 6), root_lch=F.round(F.sqrt("lch"), 6)))
derive("prj8_flags", "joint", "commits > 0 AS changed, fl > 0 AS annotated", JOINT, lambda: dict(changed=C("commits") > 0, annotated=C("fl") > 0))
query("prj9_churn_prone", """SELECT uid, snapshot_index, lch / loc::DOUBLE > (SELECT median(lch / loc::DOUBLE) FROM {joint} WHERE commits > 0) AS churn_prone FROM {joint}""")(
    lambda v: v.joint.crossJoin(v.joint.filter("commits > 0").agg(F.median(D.ratio("lch", "loc")).alias("m"))).select(*JOINT, (D.ratio("lch", "loc") > C("m")).alias("churn_prone")))
query("prj10_whole_medians", """SELECT uid, snapshot_index, median_commits, median_lch, round(median_commits_ratio, 6) AS median_commits_ratio, round(median_lch_ratio, 6) AS median_lch_ratio FROM {joint},
  (SELECT median(commits) AS median_commits, median(lch) AS median_lch, median(commits / loc::DOUBLE) AS median_commits_ratio, median(lch / loc::DOUBLE) AS median_lch_ratio FROM {joint} WHERE commits > 0)""")(
    lambda v: _whole_medians(kept(v.joint.select(*JOINT, "loc", "commits", "lch"))))


def _whole_medians(rows):
    medians = rows.filter("commits > 0").agg(*[F.median(c).alias(f"median_{c}") for c in ("commits", "lch")], *[F.round(F.median(D.ratio(c, "loc")), 6).alias(f"median_{c}_ratio") for c in ("commits", "lch")])
    return rows.crossJoin(medians).select(*JOINT, "median_commits", "median_lch", "median_commits_ratio", "median_lch_ratio")


derive("prj11_functions_per_snapshot", "joint", "count(*) OVER (PARTITION BY snapshot_index) AS tnf, round(log2(count(*) OVER (PARTITION BY snapshot_index) + 1), 6) AS log_tnf, round(log2(loac / loc::DOUBLE + 1), 6) AS log_loac_ratio", JOINT,
       lambda: dict(tnf=F.count("*").over(Window.partitionBy("snapshot_index")), log_tnf=F.round(F.log2(F.count("*").over(Window.partitionBy("snapshot_index")) + 1), 6), log_loac_ratio=F.round(F.log2(D.ratio("loac", "loc") + 1), 6)))
query("prj12_z_scores", """SELECT uid, snapshot_index, round((lch - (SELECT avg(lch) FROM {joint})) / (SELECT stddev_samp(lch) FROM {joint}), 6) AS lch FROM {joint}""")(
    lambda v: S.standardised(v.joint.select(*JOINT, "lch"), ["lch"]).select(*JOINT, F.round("lch", 6).alias("lch")))
derive("prj13_significance", "models", "CASE WHEN p < 0.0001 THEN '***' WHEN p < 0.001 THEN '**' WHEN p < 0.01 THEN '*' WHEN p < 0.05 THEN '.' ELSE '' END AS code", MODEL, lambda: dict(code=D.significance(C("p"))))
derive("prj14_rho_magnitude", "models", "CASE WHEN abs(rho) < 0.2 THEN 'very weak' WHEN abs(rho) < 0.4 THEN 'weak' WHEN abs(rho) < 0.6 THEN 'moderate' WHEN abs(rho) < 0.8 THEN 'strong' ELSE 'very strong' END AS magnitude", MODEL, lambda: dict(magnitude=D.rho_magnitude(C("rho"))))
derive("prj15_delta_magnitude", "models", "CASE WHEN abs(rho) < 0.147 THEN 'negligible' WHEN abs(rho) < 0.33 THEN 'small' WHEN abs(rho) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude", MODEL, lambda: dict(magnitude=D.delta_magnitude(C("rho"))))
derive("prj16_capped_labels", "joint", "CASE WHEN commits < 5 THEN CAST(commits AS VARCHAR) ELSE '5+' END AS label", JOINT, lambda: dict(label=D.capped_label(C("commits"), 5)))
derive("prj17_decile_labels", "models", "CASE WHEN floor(abs(rho) * 10) < 9 THEN CAST(CAST(floor(abs(rho) * 10) AS INT) AS VARCHAR) || '0%' ELSE '90%+' END AS label", MODEL, lambda: dict(label=D.decile_label(F.abs("rho"))))
derive("prj18_sort_keys", "models", "CASE d WHEN 'dep1' THEN 1 WHEN 'dep0' THEN 2 ELSE 3 END AS place", MODEL, lambda: dict(place=F.when(C("d") == "dep1", 1).when(C("d") == "dep0", 2).otherwise(3)))
query("prj19_dummy_metrics", "SELECT f.signature, f.loc, coalesce(m.lofc, 0) AS lofc, coalesce(m.nonest, 0) AS nonest FROM {functions} f LEFT JOIN {metrics} m ON f.signature = m.signature AND f.file = m.file")(
    lambda v: v.functions.join(v.metrics.select("signature", "file", "lofc", "nonest"), ["signature", "file"], "left").select("signature", "loc", F.coalesce("lofc", F.lit(0)).alias("lofc"), F.coalesce("nonest", F.lit(0)).alias("nonest")))
derive("prj20_percent", "joint", "CAST(floor(loac * 100 / nullif(loc, 0)::DOUBLE) AS BIGINT) AS perc", JOINT, lambda: dict(perc=D.percent(C("loac"), C("loc"))))
derive("prj21_grid", "joint", "CAST(round_even(loc / 12.0, 0) * 12 AS BIGINT) AS bin", JOINT, lambda: dict(bin=D.grid(C("loc"))))
derive("prj22_stabilised", "joint", "round(CASE WHEN loc > 1 THEN commits / log2(loc) END, 6) AS ratio", JOINT, lambda: dict(ratio=F.round(D.stabilised("commits", "loc"), 6)))
derive("prj23_labels", "joint", "printf('%d%% of %s', snapshot_index, signature) AS label", JOINT, lambda: dict(label=F.format_string("%d%% of %s", "snapshot_index", "signature")))

keep("flt1_mod_or_move", "hunks", "mod_type IN ('MOD', 'MOVE')", HUNK, lambda: D.is_mod_or_move(C("mod_type")))
keep("flt2_c_no_merge", "dag", "is_c AND other_parent IS NULL", ["commit_id"], lambda: C("is_c") & C("other_parent").isNull())
keep("flt3_c_files", "hunks", "regexp_matches(file, '\\.[cC]$')", HUNK, lambda: D.is_c_file(C("file")))
query("flt4_requested_snapshots", "SELECT r.place, s.snapshot_index, s.snapshot_date FROM (VALUES (0, DATE '1996-01-01'), (1, DATE '1993-01-01'), (2, DATE '2050-01-01')) r(place, day) JOIN {snapshots} s ON s.snapshot_date = r.day")(
    lambda v: v.snapshots.join(v.spark.createDataFrame([(0, "1996-01-01"), (1, "1993-01-01"), (2, "2050-01-01")], "place int, day string").withColumn("snapshot_date", F.to_date("day")), "snapshot_date").select("place", "snapshot_index", "snapshot_date"))
query("flt5_exists_at_start", "SELECT DISTINCT c.uid, c.commit_id FROM {changes} c WHERE EXISTS (SELECT 1 FROM {joint} j WHERE j.uid = c.uid AND j.snapshot_index = 0)")(
    lambda v: v.changes.join(v.joint.filter("snapshot_index = 0").select("uid"), "uid", "left_semi").select("uid", "commit_id").distinct())
keep("flt6_no_test_code", "part", "NOT (contains(p_name, ' test') OR contains(p_name, 'Test') OR starts_with(p_type, 'test'))", ["p_partkey"], lambda: ~D.is_test_code(C("p_name"), C("p_type")))
keep("flt7_excluded_files", "functions", "NOT regexp_matches(file, 'Brand#1')", ["signature"], lambda: ~C("file").rlike("Brand#1"))
keep("flt8_finite", "joint", "age IS NOT NULL AND mrc IS NOT NULL AND pc IS NOT NULL", JOINT, lambda: D.is_finite(C("age")) & D.is_finite(C("mrc")) & D.is_finite(C("pc")))
_ALL = ["loc", "loac", "lofc", "fl", "fc", "cnd", "neg", "age", "mrc", "commits", "lch", "pc"]
query("flt9_zero_filled", f"SELECT uid, snapshot_index, signature, file, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ALL)} FROM {{joint}}")(lambda v: v.joint.fillna(0).select(*JOINT, "signature", "file", *_ALL))
keep("flt10_least_sloc", "smells", "sloc >= 500", ["file"], lambda: C("sloc") >= 500)
keep("flt11_least_score", "smells", "score >= 3", ["file"], lambda: C("score") >= 3)
keep("flt12_date_range", "commits", "CAST(ts AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1994-06-30'", ["commit_id"], lambda: F.to_date("ts").between("1993-01-01", "1994-06-30"))
keep("flt13_significant", "models", "p < 0.01 AND (warning IS NULL OR NOT warning LIKE '%lgorithm did not converg%')", MODEL, lambda: (C("p") < 0.01) & (C("warning").isNull() | ~C("warning").like("%lgorithm did not converg%")))
query("flt14_smell_predicates", f"SELECT file, {', '.join(f'{p} AS is_{k.lower()}' for k, p in SMELLS.items())} FROM {{smells}}")(
    lambda v: v.smells.select("file", *[F.expr(p).alias(f"is_{k.lower()}") for k, p in D.SMELL_PREDICATES.items()]))
query("flt15_quantile_trim", "SELECT uid, snapshot_index, lch FROM {joint} WHERE lch <= (SELECT quantile_cont(lch, 0.95) FROM {joint})")(
    lambda v: v.joint.crossJoin(v.joint.agg(F.percentile("lch", 0.95).alias("t"))).filter("lch <= t").select(*JOINT, "lch"))
query("flt16_deleted_before", "SELECT DISTINCT m.commit_id, m.uid, m.hunk FROM {hunks} m WHERE mod_type = 'MOD' AND NOT EXISTS (SELECT 1 FROM {hunks} d WHERE d.mod_type = 'DEL' AND d.commit_id = m.commit_id AND d.uid = m.uid AND d.hunk < m.hunk)")(
    lambda v: v.hunks.filter("mod_type = 'MOD'").alias("m").join(v.hunks.filter("mod_type = 'DEL'").select(C("commit_id").alias("dc"), C("uid").alias("du"), C("hunk").alias("dh")),
    (C("commit_id") == C("dc")) & (C("uid") == C("du")) & (C("dh") < C("hunk")), "left_anti").select("commit_id", "uid", "hunk").distinct())
query("flt17_dropped_snapshots", "SELECT uid, snapshot_index FROM {joint} WHERE snapshot_index NOT IN (SELECT snapshot_index FROM {snapshots} WHERE snapshot_index % 2 = 0)")(
    lambda v: v.joint.join(v.snapshots.filter("snapshot_index % 2 = 0").select("snapshot_index"), "snapshot_index", "left_anti").select(*JOINT))
query("flt18_overlap_kinds", """SELECT e.commit_id, s.signature, e.begin_a, e.end_a, begin_a <= start1 - 1 AND end_a > end1 - 1 AS covers FROM {edits} e JOIN {spans} s ON e.file = s.file AND begin_a < end1 AND end_a > start1 - 1""")(
    lambda v: J.overlaps(v.edits, v.spans).select("commit_id", "signature", "begin_a", "end_a", "covers"))
keep("flt19_upper_limit", "joint", "lch <= 100", JOINT, lambda: C("lch") <= 100)
keep("flt20_plot_subset", "joint", "fl > 0 AND commits > 0 AND loc > 0", JOINT, lambda: (C("fl") > 0) & (C("commits") > 0) & (C("loc") > 0))

query("fn1_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, round((greatest(length(a.p_name), length(b.p_name), 1) - levenshtein(a.p_name, b.p_name)) / greatest(length(a.p_name), length(b.p_name), 1)::DOUBLE, 6) AS similarity FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1")(
    lambda v: _neighbours(v).select("a", "b", F.round(D.similarity(C("x"), C("y")), 6).alias("similarity")))
query("fn2_rename_distance", """SELECT a, b, CASE WHEN d <= l THEN round(d / l, 6) ELSE CAST('Infinity' AS DOUBLE) END AS distance FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(lower(a.p_name), lower(b.p_name))::DOUBLE AS d,
  greatest(1.0::DOUBLE, floor(least(length(a.p_name), length(b.p_name)) / 3::DOUBLE + 0.5)) AS l FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1)""")(
    lambda v: _neighbours(v).select("a", "b", F.round(D.rename_distance(C("x"), C("y")), 6).alias("distance")))
_LINES = "list_filter(list_transform(string_split({}, chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: x <> '')"
query("fn3_common_lines", f"""WITH t AS (SELECT a.doc_id, {_LINES.format('a.text')} AS a, {_LINES.format('b.text')} AS b FROM {{documents}} a JOIN {{documents}} b ON b.doc_id = a.doc_id + 1),
  x AS (SELECT doc_id, unnest(list_distinct(a)) AS line, a, b FROM t), c AS (SELECT doc_id, sum(least(len(list_filter(a, lambda l: l = line)), len(list_filter(b, lambda l: l = line)))) AS n FROM x GROUP BY doc_id)
  SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(n, 0) / (len(a) + len(b)) END, 6) AS share FROM t LEFT JOIN c USING (doc_id)""")(
    lambda v: v.documents.select("doc_id", D.bare_lines(C("text")).alias("a")).join(v.documents.select((C("doc_id") - 1).alias("doc_id"), D.bare_lines(C("text")).alias("b")), "doc_id").select("doc_id", F.round(D.common_lines(C("a"), C("b")), 6).alias("share")))
derive("fn4_keywords", "conversations", "array_to_string(list_filter(['the', 'and', 'ing', 'tion'], lambda k: contains(lower(text), k)), ' ') AS found", ["conv_id", "turn"], lambda: dict(found=D.keywords_found(C("text"), ["the", "and", "ing", "tion"])))
derive("fn5_hunk_headers", "documents", "array_to_string(regexp_extract_all('@@ -' || doc_id || ' +' || n_chars || ' @@' || chr(10) || '@@ x @@', '@@ (.*) @@', 1), '|') AS headers", ["doc_id"],
       lambda: dict(headers=F.array_join(D.hunk_headers(F.concat(F.lit("@@ -"), C("doc_id").cast("string"), F.lit(" +"), C("n_chars").cast("string"), F.lit(" @@\n@@ x @@"))), "|")))
derive("fn6_words", "conversations", "array_to_string(list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')), ' '), lambda w: w <> ''), ' ') AS words", ["conv_id", "turn"], lambda: dict(words=F.array_join(D.message_words(C("text")), " ")))
derive("fn8_source_path", "smells", "regexp_extract('/x/_featurelocations/' || file || '.xml', '_featurelocations/(.*)\\.xml$', 1) AS path", ["file"], lambda: dict(path=D.source_path(F.concat(F.lit("/x/_featurelocations/"), C("file"), F.lit(".xml")))))
derive("fn9_file_date", "snapshots", "snapshot_date AS day", ["snapshot_index"], lambda: dict(day=D.file_date(F.concat(F.lit("/out/"), F.date_format("snapshot_date", "yyyy-MM-dd"), F.lit(".csv")))))
derive("fn10_basename", "smells", "split_part(file, '/', -1) AS name", ["file"], lambda: dict(name=D.basename(C("file"))))
query("fn11_day_before", "SELECT commit_id, CAST(lag(ts) OVER (PARTITION BY project ORDER BY ord) AS DATE) < CAST(ts AS DATE) AS earlier FROM {commits}")(
    lambda v: v.commits.withColumn("p", F.lag("ts").over(Window.partitionBy("project").orderBy("ord"))).select("commit_id", D.at_least_a_day_before(C("p"), C("ts")).alias("earlier")))
derive("fn12_date_format", "commits", "strftime(ts, '%Y-%m-%d') AS day", ["commit_id"], lambda: dict(day=F.date_format("ts", "yyyy-MM-dd")))
derive("fn13_math", "models", "round(exp(coef), 6) AS odds_ratio, round(abs(coef), 6) AS size, round(log10(p + 1), 6) AS log10_p", MODEL, lambda: dict(odds_ratio=F.round(F.exp("coef"), 6), size=F.round(F.abs("coef"), 6), log10_p=F.round(F.log10(C("p") + 1), 6)))
derive("fn14_clean_warning", "documents", "trim(regexp_replace(replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '\"', ''), '\\s+', ' ', 'g')) AS line", ["doc_id"], lambda: dict(line=D.clean_warning(C("text"))))
derive("fn15_sql_scalars", "models", "CASE WHEN warning IS NULL THEN 'none' WHEN warning LIKE '%converge%' THEN 'fit' ELSE 'other' END AS kind, CAST(round(abs(rho) * 100) AS INT) AS perc", MODEL,
       lambda: dict(kind=F.when(C("warning").isNull(), "none").when(C("warning").like("%converge%"), "fit").otherwise("other"), perc=F.round(F.abs("rho") * 100).cast("int")))
query("fn16_percent_change", "SELECT n.uid, n.snapshot_index, round(abs(o.lch - n.lch) * 100.0::DOUBLE / nullif(o.lch, 0), 6) AS perc FROM {joint} n JOIN {joint} o ON n.uid = o.uid AND n.snapshot_index = o.snapshot_index + 1")(
    lambda v: v.joint.select(*JOINT, "lch").join(v.joint.select("uid", (C("snapshot_index") + 1).alias("snapshot_index"), C("lch").alias("old")), JOINT).select(*JOINT, F.round(D.percent_change(C("old"), C("lch")), 6).alias("perc")))
derive("fn17_month_macro", "commits", "CAST(month(ts) AS VARCHAR) || '/' || CAST(year(ts) AS VARCHAR) AS macro", ["commit_id"], lambda: dict(macro=D.month_macro(C("ts"))))
query("fn18_joined_names", "SELECT file, string_agg(signature, ',' ORDER BY signature) AS names FROM {functions} GROUP BY file")(
    lambda v: v.functions.groupBy("file").agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), "signature", F.lit('"')))).alias("n")).select("file", D.unquoted(C("n")).alias("names")))
query("snk3_no_noop_rows", "SELECT uid, commit_id, hunk FROM {hunks} WHERE added + deleted > 0 OR mod_type = 'MOVE'")(lambda v: v.hunks.filter((C("added") + C("deleted") > 0) | (C("mod_type") == "MOVE")).select(*HUNK))
derive("snk8_formatted", "models", "printf('%7.4f', rho) AS rho, CASE WHEN p = 0 THEN '        0' ELSE printf('%9.3g', p) END AS p", MODEL, lambda: dict(rho=F.format_string("%7.4f", "rho"), p=D.significant_digits(C("p"), 9, 3)))
derive("snk10_tex_rows", "models", "replace(replace(replace(system, '#', '\\#'), '%', '\\%'), '_', '\\_') || ' & ' || d AS tex", MODEL, lambda: dict(tex=F.concat(F.regexp_replace("system", r"([#%_])", r"\\$1"), F.lit(" & "), C("d"))))
query("src18_commit_ids", "SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS commit_id FROM {conversations}")(
    lambda v: T.split_ids(v.conversations, "text").select("conv_id", "turn", "commit_id"))
query("src11_feature_files", "SELECT DISTINCT source AS feature, lang || '/' || CAST(doc_id % 7 AS VARCHAR) || '.c' AS file FROM {documents}")(
    lambda v: T.parsed_features(v.documents.groupBy("source").agg(F.array_join(F.collect_list(F.concat(F.lit("<file>"), "lang", F.lit("/"), (C("doc_id") % 7).cast("string"), F.lit(".c</file>"))), "").alias("files"))
    .select(F.concat(F.lit('<feature name="'), "source", F.lit('">'), "files", F.lit("</feature>")).alias("xml")), "xml"))


def _neighbours(v):
    left = v.part.select(C("p_partkey").alias("a"), C("p_name").alias("x"))
    return left.join(v.part.select((C("p_partkey") - 1).alias("a"), C("p_partkey").alias("b"), C("p_name").alias("y")), "a")
