"""Mixing sources to target weights that change over training.

Each source has weights at knots of the training horizon, linear between them. Normalised at each knot they
are the shares of the token stream; a source's share integrated from the start is its cumulative token
demand at a training position. A document's position is where that demand reaches the tokens of its
source's earlier documents: the inverse of a piecewise quadratic, in closed form. Documents are then
range-sorted by position.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import durable, local_table, word_count
from tidemark.llm.packing import buckets, source_key, with_prefix

#: Knots as parts of the horizon, and integer weights there; sources that aren't named take the default's.
KNOTS = (0.0, 0.5, 1.0)
DEFAULT_WEIGHTS = (4, 4, 4)
WEIGHTS = {"src0": (12, 8, 4), "src1": (2, 4, 8), "src2": (1, 6, 12)}
#: Share that a source keeps beyond the horizon if its last weight is 0.
LEAST_SHARE = 1e-6
_DEMAND = pa.schema([("skey", pa.string()), ("shares", pa.list_(pa.float64())), ("demand", pa.list_(pa.float64()))])


def demand_table(sources: list[str], horizon: int, weights: dict[str | None, tuple], default: tuple, knots: tuple) -> list[tuple]:
    """(skey, shares at the knots, cumulative demand at the knots) for each source key."""
    chosen = {k: weights.get(k[1:] if k != "n" else None, default) for k in sources}
    sums = [sum(w[i] for w in chosen.values()) for i in range(len(knots))]
    out = []
    for k, w in sorted(chosen.items()):
        shares = [w[i] / sums[i] if sums[i] else 1.0 / len(chosen) for i in range(len(knots))]
        shares[-1] = max(shares[-1], LEAST_SHARE)
        total, demand = 0.0, [0.0]
        for i in range(len(knots) - 1):
            total = total + (shares[i] + shares[i + 1]) / 2.0 * ((knots[i + 1] - knots[i]) * horizon)
            demand.append(total)
        out.append((k, shares, demand))
    return out


def _position(horizon: int, knots: tuple) -> str:
    """SQL for the position at which a source's demand reaches `before` tokens."""
    cases = []
    for i in range(len(knots) - 1):
        at, width = knots[i] * horizon, (knots[i + 1] - knots[i]) * horizon
        rest = f"(before - demand[{i}])"
        slope = f"((shares[{i + 1}] - shares[{i}]) / {width!r}D)"
        root = f"sqrt(greatest(shares[{i}] * shares[{i}] + 2.0D * {slope} * {rest}, 0.0D))"
        cases.append(f"WHEN before < demand[{i + 1}] THEN {at!r}D + 2.0D * {rest} / (shares[{i}] + {root})")
    k = len(knots) - 1
    return f"CASE {' '.join(cases)} ELSE {float(horizon)!r}D + (before - demand[{k}]) / shares[{k}] END"


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, tuple] = WEIGHTS,
    default: tuple = DEFAULT_WEIGHTS,
    knots: tuple = KNOTS,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    added: tuple[str, str] | None = ("n_tokens", "position"),
) -> DataFrame:
    """All documents, range-sorted by training position, with n_tokens and position added.

    position is in tokens from the start of training (whole, rounded down; rows are sorted by it). The horizon is the token total of
    all documents. Up to the point where the first source is used up, the tokens at every position follow the
    schedule; a source with more tokens than the schedule asks for goes on beyond the horizon at its last share.
    Nothing is dropped or repeated. Within a source documents keep the order of doc_id. Tokens are
    whitespace-delimited words. Only token totals by source come to the driver.

    NULL, empty and blank texts hold no tokens and share the position of the next document of their source. NULL
    source: a source of its own, with the weights of None or the default's. NULL doc_id: first in its source.
    Repeated rows and ties: each row is placed, ties in order of token count. doc_ids may lie anywhere in 64 bits. Empty tables: no rows. Columns
    of docs that are named like the added ones give way to them; others are kept, whatever their names. added=None adds none and keeps all.
    """
    kept = [c for c in docs.columns if c.lower() not in (added or ())]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        source_key(F.col(source).cast("string")).alias("skey"),
        word_count(F.col(text)).alias("n_tokens"),
    )
    # Words are counted once for the sums, which come from a narrow table, and once where the texts are sent off.
    narrow = durable(rows.select("doc_id", "skey", "n_tokens"))
    bucket = buckets(narrow, "doc_id")
    totals = {r["skey"]: r["n"] for r in narrow.groupBy("skey").agg(F.sum("n_tokens").alias("n")).collect()}
    horizon = max(1, sum(totals.values()))
    table = local_table(docs.sparkSession, demand_table(list(totals), horizon, weights, default, knots), _DEMAND)
    placed = with_prefix(rows.withColumn("bucket", bucket), ["doc_id", "n_tokens"], narrow.withColumn("bucket", bucket)).join(table, "skey")
    return (
        placed.select("row", "n_tokens", F.expr(f"CAST(floor({_position(horizon, knots)}) AS BIGINT)").alias("position"), "skey", "before")
        .repartitionByRange("position", "skey", "before")
        .sortWithinPartitions("position", "skey", "before")
        .select("row.*", *([F.col("n_tokens").alias(added[0]), F.col("position").alias(added[1])] if added else []))
    )


def mix_sql() -> str:
    """DuckDB SQL for mix_sources with the default parameters over documents."""
    names = sorted(WEIGHTS)
    weight = lambda i: "CASE source " + " ".join(f"WHEN '{s}' THEN {WEIGHTS[s][i]}" for s in names) + f" ELSE {DEFAULT_WEIGHTS[i]} END"
    p = [f"w{i} / s{i}::DOUBLE" for i in range(3)]
    return f"""
WITH d AS (
  SELECT *, CASE WHEN text IS NULL OR trim(translate(text, chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '     ')) = '' THEN 0
    ELSE len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '     '), ' '), lambda w: w <> '')) END::BIGINT AS n_tokens
  FROM documents),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
h AS (SELECT greatest(sum(n_tokens), 1)::DOUBLE AS n FROM d),
w AS (SELECT DISTINCT source, {', '.join(f'{weight(i)} AS w{i}' for i in range(3))} FROM d),
t AS (SELECT sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2 FROM w),
s AS (SELECT source, {p[0]} AS p0, {p[1]} AS p1, greatest({p[2]}, {LEAST_SHARE}) AS p2, n FROM w, t, h),
k AS (SELECT *, 0.0::DOUBLE + (p0 + p1) / 2.0::DOUBLE * (0.5::DOUBLE * n) AS d1 FROM s),
m AS (SELECT *, d1 + (p1 + p2) / 2.0::DOUBLE * (0.5::DOUBLE * n) AS d2 FROM k)
SELECT c.doc_id, c.text, c.lang, c.source, c.n_chars, c.n_tokens, floor(CASE
  WHEN before < d1 THEN 0.0::DOUBLE + 2.0::DOUBLE * (before - 0.0::DOUBLE) / (p0 + sqrt(greatest(p0 * p0 + 2.0::DOUBLE * ((p1 - p0) / (0.5::DOUBLE * n)) * (before - 0.0::DOUBLE), 0.0::DOUBLE)))
  WHEN before < d2 THEN 0.5::DOUBLE * n + 2.0::DOUBLE * (before - d1) / (p1 + sqrt(greatest(p1 * p1 + 2.0::DOUBLE * ((p2 - p1) / (0.5::DOUBLE * n)) * (before - d1), 0.0::DOUBLE)))
  ELSE n + (before - d2) / p2 END)::BIGINT AS position
FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source
"""
