"""Rank statistics, tests and regressions (ST operators)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.derived import rho_magnitude
from tidemark.operators.shared import kept


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if df > 0 else math.nan)


def rho_p_value(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t approximation."""
    if n < 3 or rho is None or math.isnan(rho):
        return math.nan
    return 0.0 if abs(rho) >= 1 else t_p_value(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


@F.pandas_udf(T.DoubleType())
def rho_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([rho_p_value(r, int(m)) for r, m in zip(rho, n)])


def ranks(rows: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """(by, variable, value, rank): the average rank of each distinct value of each variable, NULLs left out.

    Equal values are counted first, so that the running sums go over distinct values and never over rows.
    """
    long = rows.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(by, values, "variable", "value").filter("value IS NOT NULL")
    counts = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("ties"))
    before = F.coalesce(F.sum("ties").over(Window.partitionBy(*by, "variable").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("rank", before + (F.col("ties") + 1) / 2.0)


#: Distinct values of a variable up to which their ranks are sent to all workers.
SENT = 50_000


def ranked(rows: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Rows with each variable's average rank in its place, by group. Only variables of many distinct values are joined by a shuffle of the rows."""
    table = kept(ranks(rows, values, by))
    sizes = {r["variable"]: r["n"] for r in table.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = rows.select(*by, *[F.col(v).cast("double").alias(v) for v in values])
    for v in sorted(values, key=lambda v: sizes.get(v, 0) > SENT):
        own = table.filter(F.col("variable") == v).select(*[F.col(g).alias(f"{g}_") for g in by], F.col("value").alias("value_"), F.col("rank").alias("rank_"))
        own = F.broadcast(own) if sizes.get(v, 0) <= SENT else own
        on = F.col(v) == F.col("value_")
        for g in by:
            on = on & F.col(g).eqNullSafe(F.col(f"{g}_"))
        out = out.join(own, on, "left").withColumn(v, F.col("rank_")).drop("value_", "rank_", *[f"{g}_" for g in by])
    return out


def complete(rows: DataFrame, columns: tuple[str, ...] = ("age", "mrc", "pc")) -> DataFrame:
    """FLT8: rows whose age, last edit and earlier commits are known and finite."""
    return rows.filter(" AND ".join(f"{c} IS NOT NULL AND abs(CAST({c} AS DOUBLE)) < double('infinity')" for c in columns))


def spearman(rows: DataFrame, dependents: list[str], independents: list[str], by: list[str] | None = None) -> DataFrame:
    """ST1 to ST3: rank correlation of each pair of different variables, its n, p (t approximation) and size class, by group.

    Rows are ranked once a variable; all correlations are taken in one aggregation. Rows with a NULL in any of the variables are left out first.
    """
    by = by or []
    used = list(dict.fromkeys([*dependents, *independents]))
    pairs = [(d, i) for d in dependents for i in independents if d != i]
    rank = ranked(kept(rows.dropna(subset=used).select(*by, *used)), used, by)
    wide = rank.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.corr(d, i).alias(f"r{k}") for k, (d, i) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.col(f"r{k}").alias("rho")) for k, (d, i) in enumerate(pairs)])
    long = wide.select(*by, "n", F.explode(each).alias("x")).select(*by, "x.d", "x.i", "n", "x.rho")
    return long.select(*by, "d", "i", "n", F.round("rho", 6).alias("rho"), F.round(rho_p("rho", "n"), 6).alias("p"), rho_magnitude(F.col("rho")).alias("magnitude"))


def group_differences(rows: DataFrame, value: str, splits: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """ST4, ST5: Mann-Whitney U, its z (tie and continuity corrected) and p, and Cliff's delta between the halves of each split."""
    by = by or []
    marks = F.array(*[F.struct(F.lit(k).alias("split"), c.alias("treated")) for k, c in splits.items()])
    long = rows.withColumn("m", F.explode(marks)).select(*by, "m.split", "m.treated", F.col(value).cast("double").alias("v")).filter("treated IS NOT NULL AND v IS NOT NULL")
    # Equal values are one row from here on; ranks, ties and sums follow from their counts.
    cells = long.groupBy(*by, "split", "v").agg(F.count_if("treated").alias("yes"), F.count(F.lit(1)).alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by, "split").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cells.withColumn("r", before + (F.col("t") + 1) / 2.0).groupBy(*by, "split").agg(
        F.sum("yes").alias("n_trt"), F.sum(F.col("t") - F.col("yes")).alias("n_ctrl"), F.sum(F.col("yes") * F.col("r")).alias("ranks"), F.sum(F.expr("CAST(t AS DOUBLE) * t * t - t")).alias("ties")
    )
    a, b = F.col("n_trt").cast("double"), F.col("n_ctrl").cast("double")
    u = F.col("ranks") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((a + b + 1) - F.try_divide(F.col("ties"), (a + b) * (a + b - 1))))
    centred = u - a * b / 2
    z = F.try_divide(centred - F.signum(centred) * 0.5, sd)
    return (
        sums.filter("n_trt > 0 AND n_ctrl > 0").withColumn("z", z)
        .select(*by, "split", "n_trt", "n_ctrl", u.alias("u"), F.round("z", 6).alias("z"), F.round(normal_p("z"), 6).alias("p"), F.round(2 * u / (a * b) - 1, 6).alias("delta"))
    )


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x is not None and not math.isnan(x) else math.nan for x in z])


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """ST6: two-sided p of a 2x2 table and the conditional maximum-likelihood odds ratio."""
    m, n, k = a + b, c + d, a + c
    low, high = max(0, k - n), min(k, m)
    x = np.arange(low, high + 1)
    log = np.array([_log_choose(m, i) + _log_choose(n, k - i) for i in x])
    p = np.exp(log - log.max())
    p /= p.sum()
    value = float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))
    if a == low or a == high:
        return value, 0.0 if a == low and low != high else (math.inf if low != high else math.nan)

    def mean(t: float) -> float:
        w = np.exp(log + x * t - (log + x * t).max())
        return float((w * x).sum() / w.sum())

    left, right = -40.0, 40.0
    for _ in range(200):
        half = (left + right) / 2
        left, right = (half, right) if mean(half) < a else (left, half)
    return value, math.exp((left + right) / 2)


def fisher_table(tables: DataFrame, columns: tuple[str, str, str, str], keys: list[str]) -> DataFrame:
    """ST6 on one 2x2 table a row."""

    @F.pandas_udf("p double, odds_ratio double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fisher_exact(*map(int, x)) for x in zip(a, b, c, d)], columns=["p", "odds_ratio"])

    return tables.withColumn("t", test(*columns)).select(*keys, *columns, F.round("t.p", 6).alias("p"), F.round("t.odds_ratio", 5).alias("odds_ratio"))


_CONTROLS = ["log2loc", "log2mrc", "log2pc", "log2age"]
#: ST10: regressors by formula number: the controls alone, then annotation metrics as they are, then log-scaled, with the controls.
FORMULAS = {
    0: _CONTROLS,
    1: ["cnd", "fc", "neg", "loacratio", *_CONTROLS],
    2: ["cnd", "fl", "neg", "loacratio", *_CONTROLS],
    3: ["cnd", "fc", "fl", "neg", "loacratio", *_CONTROLS],
    4: ["log2cnd", "log2fc", "log2neg", "loacratio", *_CONTROLS],
    5: ["log2cnd", "log2fl", "log2neg", "loacratio", *_CONTROLS],
    6: ["log2cnd", "log2fc", "log2fl", "log2neg", "loacratio", *_CONTROLS],
}


def regressors(rows: DataFrame, *kept: str) -> DataFrame:
    """The variables of all formulas, and the columns named."""
    plain = ["cnd", "fc", "fl", "neg"]
    logs = [F.log2(F.col(c) + 1.0).alias(f"log2{c}") for c in [*plain, "mrc", "pc", "age"]]
    return rows.select(*kept, *[F.col(c).cast("double").alias(c) for c in plain], *logs, F.log2(F.col("loc").cast("double")).alias("log2loc"), (F.col("loac") / F.col("loc")).alias("loacratio"))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ12: z-scores with the sample sd; a constant column gives NULL."""
    agg = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    joined = rows.crossJoin(agg)  # one row of numbers
    return joined.select(*[c for c in rows.columns if c not in columns], *[F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias(c) for c in columns])


def _gamma_sums(values: np.ndarray, times: np.ndarray, theta: float) -> tuple[float, float, float]:
    """Over whole numbers, each so many times: sums of log gamma(y + theta) - log y!, and of the first two derivatives by theta."""
    x = values + theta
    shift = [(x + k) for k in range(10)]
    z = x + 10
    i = 1 / (z * z)
    first = np.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i / 252)) - sum(1 / v for v in shift)
    second = 1 / z + i / 2 + i / z * (1 / 6 - i * (1 / 30 - i / 42)) + sum(1 / v**2 for v in shift)
    log = np.array([math.lgamma(v) - math.lgamma(w + 1) for v, w in zip(x, values)])
    return float(times @ log), float(times @ first), float(times @ second)


class Fit:
    """A model under way: outcome, terms, coefficients and what the last pass over the rows said."""

    def __init__(self, family: str, outcome: str, terms: list[str]):
        self.family, self.outcome, self.terms = family, outcome, terms
        self.beta = np.zeros(len(terms) + 1)
        self.theta, self.last, self.done, self.steps, self.gram = 1.0, None, False, 0, None
        self.sums = np.zeros(8)
        #: Distinct outcomes and how often each occurs, where they are counted beforehand.
        self.counts: tuple[np.ndarray, np.ndarray] | None = None

    def size(self) -> int:
        k = len(self.beta)
        return k * k + k + 8

    def partial(self, rows: pd.DataFrame) -> np.ndarray:
        """Cross products, scores and further sums over some rows, for one Newton step."""
        x = np.column_stack([np.ones(len(rows)), *(rows[t].to_numpy(float) for t in self.terms)])
        y = rows[self.outcome].to_numpy(float)
        eta = x @ self.beta
        if self.family == "logit":
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            w, r = p * (1 - p), y - p
            fit = np.where(y > 0, np.log(np.maximum(p, 1e-300)), np.log(np.maximum(1 - p, 1e-300))).sum()
            more = [fit, len(y), y.sum(), float(((p < 1e-15) | (p > 1 - 1e-15)).sum()), 0, 0, 0, 0]
        else:
            t, low = self.theta, np.minimum(eta, 30.0)
            mu = np.exp(low)
            whole = mu + t
            log, share, off = np.log(whole), (y + t) / whole, y - mu
            w, r = mu * t / whole, off * t / whole
            g, g1, g2 = (0.0, 0.0, 0.0) if self.counts else _gamma_sums(*np.unique(y, return_counts=True), t)
            fit = (y * (low - log) + t * (math.log(t) - log)).sum() + g
            first = g1 + (math.log(t) - log + 1 - share).sum()
            second = g2 + (1 / t - (2 - share) / whole).sum()
            more = [fit, len(y), y.sum(), 0, first, second, (off * r / mu).sum(), 0]
        return np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ r, np.array(more, float)])

    def step(self, total: np.ndarray) -> None:
        k = len(self.beta)
        gram, score, self.sums = total[: k * k].reshape(k, k), total[k * k : k * k + k], total[k * k + k :].copy()
        if self.counts:
            g = _gamma_sums(*self.counts, self.theta)
            self.sums[[0, 4, 5]] += g
        self.gram, n = gram, self.sums[1]
        if not n:
            self.done = True
            return
        if not self.steps and self.family != "logit" and not self.beta.any():
            self.beta[0] = math.log(max(self.sums[2] / n, 1e-6))  # from the mean on
            self.steps = 1
            return
        fit = self.sums[0] if self.family == "logit" else self.sums[0] + n * (-math.lgamma(self.theta))
        change = np.linalg.lstsq(gram, score, rcond=None)[0]
        if self.family != "logit":
            first, second = self.sums[4] - n * _digamma(self.theta), self.sums[5] - n * _trigamma(self.theta)
            move = -first / second if second < 0 else self.theta  # uphill
            theta = min(max(self.theta + move, self.theta / 3), self.theta * 3, 1e7)
            still = abs(theta - self.theta) < 1e-7 * self.theta
        else:
            theta, still = self.theta, True
        settled = self.last is not None and abs(fit - self.last) < 1e-9 * (abs(fit) + 1) and still
        self.fit, self.last, self.done = fit, fit, settled or np.abs(change).max() < 1e-9 and still
        self.steps += 1
        if not self.done:
            self.beta, self.theta = self.beta + change, theta

    def report(self, null: float | None) -> list[dict]:
        n, ones = self.sums[1], self.sums[2]
        if self.family == "logit":
            share = ones / n if n else 0.5
            null = n * (share * math.log(share) + (1 - share) * math.log(1 - share)) if 0 < share < 1 else 0.0
        said = [] if self.done else ["algorithm did not converge"]
        if self.family == "logit" and self.sums[3]:
            said.append("fitted probabilities numerically 0 or 1 occurred")
        whole = {"aic": 2 * (len(self.beta) + (self.family != "logit")) - 2 * self.fit, "mcfadden": 1 - self.fit / null if null else math.nan}
        whole |= {"warnings": len(said), "warning_messages": ";".join(said)} | ({} if self.family == "logit" else {"theta": self.theta, "chisq": self.sums[6]})
        return _terms(self.terms, self.beta, np.linalg.pinv(self.gram), whole)


def _passes(rows: DataFrame, fits: list[Fit], most: int) -> None:
    """Newton steps for all models at once: each is one pass over the rows, of which only sums come to the driver."""
    used = list(dict.fromkeys(c for f in fits for c in (f.outcome, *f.terms)))
    table = kept(rows.select(*used).dropna())
    for y in {f.outcome for f in fits if f.family != "logit"}:  # gamma sums need no pass over the rows where there are few different outcomes
        found = table.groupBy(F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(SENT + 1).collect()
        if len(found) <= SENT:
            for f in fits:
                if f.outcome == y:
                    f.counts = np.array([r["y"] for r in found], float), np.array([r["n"] for r in found], float)
    for _ in range(most):
        if not (open_ := [f for f in fits if not f.done]):
            break

        def sums(batches: Iterator[pd.DataFrame], models: list[Fit] = open_) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                part = np.concatenate([m.partial(b) for m in models])
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"k": np.arange(len(total), dtype=np.int32), "v": total})

        got = table.mapInPandas(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(sum(f.size() for f in open_))
        for r in got:
            flat[r["k"]] = r["v"]
        at = 0
        for f in open_:
            f.step(flat[at : at + f.size()])
            at += f.size()


def logit_models(rows: DataFrame, outcome: str, formulas: dict[int, list[str]]) -> list[dict]:
    """ST8: logistic regressions: coef, odds ratio, z, p of each term, with AIC, McFadden and warnings of its formula."""
    fits = {k: Fit("logit", outcome, x) for k, x in formulas.items()}
    _passes(rows, list(fits.values()), 26)
    return [{"formula": k, **t} for k, f in fits.items() for t in f.report(None)]


def nb_models(rows: DataFrame, outcomes: list[str], formulas: dict[int, list[str]]) -> list[dict]:
    """ST9: negative-binomial regressions, coefficients and theta in turn; McFadden is against the model of the mean alone."""
    null = {d: Fit("nb", d, []) for d in outcomes}
    fits = {(d, k): Fit("nb", d, x) for d in outcomes for k, x in formulas.items()}
    _passes(rows, [*null.values(), *fits.values()], 100)
    return [{"d": d, "formula": k, **t} for (d, k), f in fits.items() for t in f.report(null[d].fit)]


def logit(rows: DataFrame, outcome: str, x: list[str]) -> list[dict]:
    """One logistic regression."""
    return logit_models(rows, outcome, {0: x})


def negative_binomial(rows: DataFrame, outcome: str, x: list[str]) -> list[dict]:
    """One negative-binomial regression."""
    return nb_models(rows, [outcome], {0: x})


def _terms(x: list[str], beta: np.ndarray, cov: np.ndarray, whole: dict) -> list[dict]:
    out = []
    for name, b, v in zip(["(Intercept)", *x], beta, np.diag(cov)):
        z = b / math.sqrt(v) if v > 0 else math.nan
        out.append({"term": name, "coef": float(b), "odds_ratio": math.exp(b) if b < 700 else math.inf, "z": z, "p": math.erfc(abs(z) / math.sqrt(2)) if z == z else math.nan, **whole})
    return out


def _digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i / 42))
