"""Derived columns, predicates and formatting of change-history tables (PRJ, FLT and FN operators)."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_delta(added: str, deleted: str) -> Column:
    """PRJ2"""
    return F.col(added) - F.col(deleted)


def lines_changed(added: str, deleted: str) -> Column:
    """PRJ3"""
    return F.col(added) + F.col(deleted)


def rounded_int(c: Column) -> Column:
    """PRJ4: half to even."""
    return F.bround(c).cast("int")


def java_round(c: Column) -> Column:
    """Half up, also for negatives: floor(x + 0.5)."""
    return F.floor(c + 0.5).cast("long")


def ratio(a: str, b: str) -> Column:
    """PRJ6: a / b as double, NULL for a zero denominator."""
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def log2p(c: str) -> Column:
    """PRJ7: log2(x + 1)"""
    return F.log2(F.col(c) + 1)


def significance(p: Column) -> Column:
    """PRJ13"""
    return F.when(p < 1e-4, "***").when(p < 1e-3, "**").when(p < 0.01, "*").when(p < 0.05, ".").otherwise("")


def rho_magnitude(rho: Column) -> Column:
    """PRJ14: size class of a rank correlation."""
    a = F.abs(rho)
    return F.when(a < 0.2, "very weak").when(a < 0.4, "weak").when(a < 0.6, "moderate").when(a < 0.8, "strong").otherwise("very strong")


def delta_magnitude(d: Column) -> Column:
    """PRJ15: size class of Cliff's delta."""
    a = F.abs(d)
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def capped_label(v: Column, top: int) -> Column:
    """PRJ16: the value as text, everything from `top` on as one class."""
    return F.when(v < top, v.cast("string")).otherwise(F.lit(f"{top}+"))


def decile_label(v: Column, top: int = 9) -> Column:
    """PRJ17: ten-percent bands, open above."""
    band = F.floor(v * 10).cast("int")
    return F.when(band < top, F.concat(band.cast("string"), F.lit("0%"))).otherwise(F.lit(f"{top}0%+"))


def percent(part: Column, whole: Column) -> Column:
    """PRJ20: truncating integer percentage, NULL for an empty whole."""
    return F.when(whole != 0, F.floor(part * 100 / whole)).cast("long")


def grid(v: Column, width: int = 12) -> Column:
    """PRJ21: nearest multiple of width, half to even."""
    return (F.bround(v / width) * width).cast("long")


def stabilised(commits: str, loc: str) -> Column:
    """PRJ22: commits / log2(loc), NULL where loc is at most 1."""
    return F.when(F.col(loc) > 1, F.col(commits) / F.log2(F.col(loc).cast("double")))


def is_mod_or_move(mod_type: Column) -> Column:
    """FLT1"""
    return mod_type.isin("MOD", "MOVE")


def is_c_file(path: Column) -> Column:
    """FLT3"""
    return path.rlike(r"\.[cC]$")


def is_test_code(signature: Column, path: Column) -> Column:
    """FLT6"""
    return signature.contains(" test") | signature.contains("Test") | path.startswith("test")


def is_finite(c: Column) -> Column:
    """FLT8"""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def similarity(a: Column, b: Column) -> Column:
    """FN1: 1 - edit distance / length of the longer text (at least 1)."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return (longest - F.levenshtein(a, b)) / longest


def rename_distance(a: Column, b: Column) -> Column:
    """FN2: edit distance over its limit, a third of the shorter name; infinite beyond. Case doesn't count."""
    limit = F.greatest(F.lit(1.0), F.floor(F.least(F.length(a), F.length(b)) / 3 + 0.5).cast("double"))
    d = F.levenshtein(F.lower(a), F.lower(b)).cast("double")
    return F.when(d <= limit, d / limit).otherwise(F.lit(float("inf")))


def bare_lines(text: Column) -> Column:
    """A text without white space but for its newlines: what common_lines compares."""
    return F.translate(text, " \t\x0b\f\r", "")


@F.arrow_udf(T.DoubleType())
def _shared(old: pa.Array, new: pa.Array) -> pa.Array:
    """common_lines of bare texts; counts are kept by line, so the work grows with the lines and not with their square."""
    out: list[float | None] = []
    for i in range(len(old)):
        a, b = old[i].as_py(), new[i].as_py()
        if a is None or b is None:
            out.append(None)
            continue
        a, b = [x for x in a.split("\n") if x], [x for x in b.split("\n") if x]
        total = len(a) + len(b)
        out.append(2.0 * (Counter(a) & Counter(b)).total() / total if total else 1.0)
    return pa.array(out, pa.float64())


def common_lines(old: Column, new: Column) -> Column:
    """FN3: the part of both texts' lines that they share, white space aside; lines are counted, their order isn't.

    (total - deleted - added) / total, where total is the lines of both texts. Texts that are bare_lines already may be given as well.
    """
    return _shared(bare_lines(old), bare_lines(new))


def keywords_found(message: Column, keywords: list[str]) -> Column:
    """FN4: the keywords that a message contains, in order, joined by blanks."""
    low = F.lower(message)
    return F.array_join(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k)), " ")


def hunk_headers(diff: Column) -> Column:
    """FN5: the texts between @@ marks, one for each hunk header line."""
    return F.regexp_extract_all(diff, F.lit(r"@@ (.*) @@"), F.lit(1))


def message_words(message: Column) -> Column:
    """FN6: words without punctuation, lower-cased, split at single blanks; empty ones dropped."""
    return F.filter(F.split(F.lower(F.regexp_replace(message, r"[^a-zA-Z0-9\s]", "")), " "), lambda w: w != "")


def source_path(path: Column, prefix: str = "_featurelocations/") -> Column:
    """FN8: the path behind the tool's prefix, without .xml."""
    return F.regexp_extract(path, f"{prefix}(.*)\\.xml$", 1)


def file_date(path: Column) -> Column:
    """FN9: date in a file's name."""
    return F.to_date(F.regexp_extract(path, r"([^/]+)\.[^.]*$", 1))


def basename(path: Column) -> Column:
    """FN10"""
    return F.substring_index(path, "/", -1)


def at_least_a_day_before(a: Column, b: Column) -> Column:
    """FN11"""
    return F.to_date(a) < F.to_date(b)


def percent_change(old: Column, new: Column) -> Column:
    """FN16"""
    return F.try_divide(F.abs(old - new) * 100.0, old.cast("double"))


def significant_digits(c: Column, width: int, digits: int) -> Column:
    """SNK8: %<width>.<digits>g of a number from 0 on, as C prints it: the shorter of fixed and exponent form, without trailing zeros."""
    exponent = F.when(c > 0, F.floor(F.log10(F.format_string(f"%.{digits - 1}e", c).cast("double")) + 1e-9)).otherwise(0).cast("int")
    plain = F.format_string(f"%.{digits + 8}f", F.round(c * F.pow(F.lit(10.0), (digits - 1 - exponent).cast("double"))) / F.pow(F.lit(10.0), (digits - 1 - exponent).cast("double")))
    fixed = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scientific = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1}e", c), r"(\.[0-9]*?)0+e", "$1e"), r"\.e", "e")
    return F.lpad(F.when((exponent < -4) | (exponent >= digits), scientific).otherwise(fixed), width, " ")


def clean_warning(text: Column) -> Column:
    """FN14: one line, single blanks, no quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"\"", ""), r"\s+", " "))


def unquoted(names: Column) -> Column:
    """FN18: names without quotes, joined by commas."""
    return F.array_join(F.transform(names, lambda n: F.replace(n, F.lit('"'), F.lit(""))), ",")


def month_macro(ts: Column) -> Column:
    """FN17: month without leading zero / year."""
    return F.concat(F.month(ts).cast("string"), F.lit("/"), F.year(ts).cast("string"))


def sloc(text: Column) -> Column:
    """AGG33: newlines, 1 for a text that has none but isn't empty."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when((lines == 0) & (F.length(text) > 0), 1).otherwise(lines)


#: FLT14: the 14 smell predicates on a file's counts of annotation bundles, annotation files and large features.
SMELL_PREDICATES = {
    "ANY": "ab + af + lf > 0",
    "AB": "ab > 0",
    "AF": "af > 0",
    "LF": "lf > 0",
    "ABorAF": "ab > 0 OR af > 0",
    "ABandAF": "ab > 0 AND af > 0",
    "ABorLF": "ab > 0 OR lf > 0",
    "ABandLF": "ab > 0 AND lf > 0",
    "AForLF": "af > 0 OR lf > 0",
    "AFandLF": "af > 0 AND lf > 0",
    "ANY2": "ab + af + lf >= 2",
    "ANY2Distinct": "CAST(ab > 0 AS INT) + CAST(af > 0 AS INT) + CAST(lf > 0 AS INT) >= 2",
    "AB2": "ab >= 2",
    "LF2": "lf >= 2",
}
