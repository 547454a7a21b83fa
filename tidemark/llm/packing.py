"""Mixture-controlled packing by deficit round-robin over source queues.

A window is one round: every source's deficit counter grows by its quantum (window size times target
share), the source gives as many whole tokens as the counter holds, and the fraction stays in the counter
for the next window. Documents are cut where a source's turn ends and resume in its next turn. When a
queue runs dry in a window, what it lacks goes to the others by their shares, and later quanta are
renormalised. Because all of a source's turns follow from its token total, each document's windows have a
closed form in its prefix sum: partitions need only their offset, no state is passed between them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import durable, local_table, word_count

#: Documents of one bucket of ids, about: rows that one task's prefix sum runs over.
BUCKET_DOCS = 10_000
#: Quantiles of the ids that come to the driver, at most; between two of them buckets are of equal width.
QUANTILES = 2_000
#: Shares are integers in parts of this.
_PARTS = 1_000_000_000
#: A source with a smaller share than one in so many shares a queue with the other small ones.
POOL = 256


def buckets(docs: DataFrame, doc_id: str) -> Column:
    """Bucket number by range of doc_id, -1 for NULL ids; about BUCKET_DOCS rows each, wherever the ids lie."""
    place = F.col(doc_id).cast("long")
    n = docs.count()
    coarse = min(QUANTILES, max(1, -(-n // BUCKET_DOCS)))
    fine = max(1, -(-n // (BUCKET_DOCS * coarse)))
    low, high, cuts = docs.agg(F.min(place), F.max(place), F.percentile_approx(place, [i / coarse for i in range(1, coarse)] or [0.5], 10 * coarse + 100)).first()
    if n == 0 or low is None or coarse == 1:
        return F.when(place.isNull(), F.lit(-1)).otherwise(0).cast("long")
    edges = sorted({low, *cuts})
    widths = np.array([(b - a) // fine + 1 for a, b in zip(edges, [*edges[1:], high + 1])], np.uint64)
    starts = np.array(edges, np.int64)

    @F.arrow_udf("long")
    def number(ids: pa.Array) -> pa.Array:
        x = pc.fill_null(ids, low).to_numpy(zero_copy_only=False)
        at = np.maximum(np.searchsorted(starts, x, side="right") - 1, 0)
        within = (x.view(np.uint64) - starts[at].view(np.uint64)) // widths[at]  # differences of longs, without overflow
        out = at * (fine + 1) + within.astype(np.int64)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, out))

    return F.coalesce(number(place), F.lit(-1))  # never NULL, or joins on it would test that by a second Python step


def source_key(source: Column) -> Column:
    """A key that tells a NULL source from every string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def with_prefix(rows: DataFrame, order: list[str], narrow: DataFrame | None = None) -> DataFrame:
    """Adds `before`, the tokens of a source's earlier documents, to rows of (skey, bucket, n_tokens, ...).

    Two levels: sums of (source, bucket) are added up first (from narrow, if given), then each bucket's rows on top of its offset.
    """
    sums = (rows if narrow is None else narrow).groupBy("skey", "bucket").agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(offsets, ["skey", "bucket"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .drop("offset")
    )


def integer_shares(weights: dict[str, float], window: int) -> dict[str, int]:
    """Shares in parts of about _PARTS; every source gets at least a token in a window, for which pooled sees that the weights suffice."""
    total = sum(weights.values())
    least = min(_PARTS, -(-2 * _PARTS // window))
    return {k: max(least, round(_PARTS * w / total) if total else 1) for k, w in weights.items()}


def pooled(targets: dict[str, tuple], window: int) -> dict[str, float]:
    """The sources that share a queue, with their mean shares: those of less than one part in POOL or four tokens of a window.

    If these together have less than that, the next larger ones join them.
    """
    sums = [sum(w[i] for w in targets.values()) or 1.0 for i in range(len(next(iter(targets.values()))))] if targets else []
    shares = {k: [w / s for w, s in zip(ws, sums)] for k, ws in targets.items()}
    limit = max(1.0 / POOL, 4.0 / window)
    out: dict[str, float] = {}
    most = 0.0
    for k in sorted(shares, key=lambda k: (max(shares[k]), k)):
        if max(shares[k]) >= limit and not 0 < most < limit:
            break
        out[k] = max(sum(shares[k]) / len(sums), 1e-12)
        most = max(sum(shares[x][i] for x in out) for i in range(len(sums))) or 1e-12
    return out if len(out) > 1 else {}


def _given(j: int, window: int, low: int, high: int, parts: int) -> int:
    """Tokens that the source at [low, high) of all parts gives in the first j windows."""
    return j * window * high // parts - j * window * low // parts


def _filled(quanta: dict[str, int], left: dict[str, int], shares: dict[str, int], window: int) -> dict[str, int]:
    """Tokens that each source gives to one window: what dry queues lack goes to the others by their shares."""
    give = {k: min(left[k], n) for k, n in quanta.items()}
    room = window - sum(give.values())
    while room and (open_ := [k for k in quanta if left[k] > give[k]]):
        parts_open = sum(shares[k] for k in open_)
        more = {k: min(left[k] - give[k], room * shares[k] // parts_open) if parts_open else 0 for k in open_}
        if not any(more.values()):
            more = {open_[0]: 1}
        for k, n in more.items():
            give[k] += n
        room = window - sum(give.values())
    return give


def schedule(totals: dict[str, int], shares: dict[str, int], window: int) -> list[dict]:
    """Runs of windows in which the same sources are active, from the tokens of each source.

    A run gives each source (skey) its first window, its number of windows, the source's tokens before it (n0),
    its place among the parts (low, high of parts), and for a single window in which a queue ran dry, the
    tokens given and their offset there (fixed, offset; else -1).
    """
    left, done, first, out = dict(totals), dict.fromkeys(totals, 0), 0, []
    active = sorted(k for k, n in left.items() if n > 0)
    while active:
        parts = sum(shares[k] for k in active)
        edges, at = {}, 0
        for k in active:
            edges[k] = (at, at + shares[k])
            at += shares[k]

        def fits(j: int) -> bool:
            return all(_given(j, window, *edges[k], parts) <= left[k] for k in active)

        low, high = 0, sum(left.values()) // window + 1
        while low < high:  # the most windows that every active queue can fill
            half = (low + high + 1) // 2
            low, high = (half, high) if fits(half) else (low, half - 1)
        if low:
            for k in active:
                out.append({"skey": k, "first": first, "windows": low, "n0": done[k], "low": edges[k][0], "high": edges[k][1], "parts": parts, "fixed": -1, "offset": -1})
                n = _given(low, window, *edges[k], parts)
                left[k] -= n
                done[k] += n
            first += low
        give = _filled({k: _given(low + 1, window, *edges[k], parts) - _given(low, window, *edges[k], parts) for k in active}, left, shares, window)
        offset = 0
        for k in active:
            if give[k]:
                out.append({"skey": k, "first": first, "windows": 1, "n0": done[k], "low": 0, "high": 0, "parts": 1, "fixed": give[k], "offset": offset})
                offset += give[k]
                left[k] -= give[k]
                done[k] += give[k]
        first += bool(offset)
        active = [k for k in active if left[k] > 0]
    return out


def _edge(j: int, base: float, rise: float, bend: float) -> int:
    """Tokens on the low side of an edge between two sources in the first j windows of a run."""
    return math.floor(base + j * (rise + bend * j))


class Curve:
    """The schedule of some sources: shares at the knots, linear between them, and the edges of their parts side by side."""

    def __init__(self, weights: dict[str, tuple], knots: tuple, horizon: int, window: int):
        least = min(1.0, 2.0 / window)  # every source gets a token or more in a window
        shares = []
        for i in range(len(knots)):
            total = sum(w[i] for w in weights.values())
            raw = [max(least, w[i] / total if total else 1.0 / len(weights)) for w in weights.values()]
            shares.append([x / sum(raw) for x in raw])
        self.at = [k * horizon for k in knots]
        self.edges = [[sum(s[:e]) for e in range(len(s))] + [1.0] for s in shares]

    def segment(self, x: float) -> int:
        """The number of knots that x has passed, 0 before the first."""
        return sum(x >= a for a in self.at)

    def height(self, e: int, x: float) -> tuple[float, float]:
        """The share below edge e at x, and its slope there; constant before the first knot and behind the last."""
        i = self.segment(x)
        if i in (0, len(self.at)):
            return self.edges[max(0, i - 1)][e], 0.0
        slope = (self.edges[i][e] - self.edges[i - 1][e]) / (self.at[i] - self.at[i - 1])
        return self.edges[i - 1][e] + slope * (x - self.at[i - 1]), slope

    def demand(self, e: int, x: float) -> float:
        """Tokens below edge e in the first x, the integral of its share."""
        if e in (0, len(self.edges[0]) - 1):
            return float(x if e else 0)
        stops = [0.0, *[a for a in self.at if 0 < a < x], float(x)]
        out = 0.0
        for a, b in zip(stops, stops[1:]):
            share, slope = self.height(e, a)
            out += (b - a) * (share + slope * (b - a) / 2.0)
        return out


def curved_schedule(totals: dict[str, int], weights: dict[str, tuple], knots: tuple, window: int) -> list[dict]:
    """Runs of windows as those of schedule, for weights at knots of the horizon (all tokens) and linear between them.

    A window's quantum of a source is the integral of its share over the window's tokens. Behind a queue that ran dry the
    schedule is that of the sources left. A run ends there and at knots; within it the tokens below each edge
    of a source in j windows are floor(base + j * (rise + bend * j)).
    """
    left, done, first, out = dict(totals), dict.fromkeys(totals, 0), 0, []
    horizon = sum(totals.values())
    active = sorted(k for k, n in left.items() if n > 0)
    flat = (0.0, 0.0, 0.0)
    while active:
        curve = Curve({k: weights[k] for k in active}, knots, horizon, window)
        start = first * window
        lines = []
        for e in range(len(active) + 1):
            share, slope = curve.height(e, start)
            base = curve.demand(e, start)
            lines.append((base - math.floor(base), share * window, slope * window * window / 2.0))
        lines[0], lines[-1] = flat, (0.0, float(window), 0.0)

        def given(i: int, j: int) -> int:
            return _edge(j, *lines[i + 1]) - _edge(j, *lines[i])

        after = curve.segment(start)
        low, high = 0, sum(left.values()) // window + 1
        if after < len(knots):
            high = min(high, int((curve.at[after] - start) // window))
        while low < high:  # the most windows before the next knot that every active queue can fill
            half = (low + high + 1) // 2
            low, high = (half, high) if all(given(i, half) <= left[k] for i, k in enumerate(active)) else (low, half - 1)
        if low:
            for i, k in enumerate(active):
                out.append({"skey": k, "first": first, "windows": low, "n0": done[k], "low": lines[i], "high": lines[i + 1], "fixed": -1, "offset": -1})
                n = given(i, low)
                left[k] -= n
                done[k] += n
            first += low
        else:  # a single window in which a knot lies or a queue runs dry
            edges = [math.floor(curve.demand(e, start + window)) - math.floor(curve.demand(e, start)) for e in range(len(active) + 1)]
            quanta = {k: edges[i + 1] - edges[i] for i, k in enumerate(active)}
            give = _filled(quanta, left, quanta, window)
            offset = 0
            for k in active:
                if give[k]:
                    out.append({"skey": k, "first": first, "windows": 1, "n0": done[k], "low": flat, "high": flat, "fixed": give[k], "offset": offset})
                    offset += give[k]
                    left[k] -= give[k]
                    done[k] += give[k]
            first += 1
        active = [k for k in active if left[k] > 0]
    return out


_LINE = pa.struct([("base", pa.float64()), ("rise", pa.float64()), ("bend", pa.float64())])
_CURVED_RUNS = pa.schema([("skey", pa.string()), *[(c, pa.int64()) for c in ("first", "windows", "n0")], ("low", _LINE), ("high", _LINE), ("fixed", pa.int64()), ("offset", pa.int64())])
_RUNS = pa.schema([("skey", pa.string()), *[(c, pa.int64()) for c in ("first", "windows", "n0", "low", "high", "parts", "fixed", "offset")]])


def pack(
    docs: DataFrame,
    window_tokens: int = 32_768,
    weights: dict[str, float] | None = None,
    temperature: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    n_tokens: Column | None = None,
    knots: tuple | None = None,
    stored: bool = False,
) -> DataFrame:
    """Pieces of documents in training windows: (window_id, offset, doc_id, source, start_token, n_tokens).

    Every window but the last is exactly full, and within each run of windows every source's tokens stay
    within one token of its target. weights: target share of each source; a source that isn't named, or NULL,
    has the share under None, or the least one named. Without weights a source's target is its token total to the power of
    temperature. knots: parts of the horizon (all tokens) at which weights, then a tuple for each source, hold; between them
    shares are linear, and a window's are their integral over its tokens (at least two tokens a source). A source's queue is in order of
    doc_id, or with stored (docs must be a scan of files) in the order of the rows in the files. n_tokens: tokens of a document, whitespace-delimited
    words by default. Only totals by source come to the driver.

    Any number of sources: those with less than one part in POOL, or four tokens of a window, share one queue with the sum of their
    shares, in which documents are in order of their source's earlier tokens over its share, so that each gets its share over
    several windows, to within a document.

    NULL, empty and blank texts hold no tokens and give no piece. NULL source: a source of its own. NULL
    doc_id: first in its queue. Repeated rows and ties: each row is packed, ties in order of token count; rows
    that tie in both are alike. doc_ids may lie anywhere in 64 bits. A very long text spans as many windows as it needs. Empty tables: no rows.
    Other columns are ignored, whatever their names.
    """
    # Counting words is most of the work: it is done once, the ids and counts are kept in the shared folder.
    file = F.col("_metadata.file_name") if stored else F.lit(None).cast("string")
    counted = durable(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        source_key(F.col(source).cast("string")).alias("skey"),
        F.coalesce(n_tokens if n_tokens is not None else word_count(F.col(text)), F.lit(0)).cast("long").alias("n_tokens"),
        file.alias("file"),
        (F.col("_metadata.row_index") if stored else F.col(doc_id).cast("long")).alias("place"),
    ).filter("n_tokens > 0"))
    written = F.coalesce(F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long"), F.lit(-1))
    counted = counted.withColumn("bucket", written if stored else buckets(counted, "place"))
    order = ["file", "place", "n_tokens"]
    totals = {r["skey"]: r["n"] for r in counted.groupBy("skey").agg(F.sum("n_tokens").alias("n")).collect()}
    if weights is None:
        targets = {k: n**temperature for k, n in totals.items()}
    else:
        targets = {k: weights.get(k[1:] if k != "n" else None, weights.get(None, min(weights.values()))) for k in totals}
    small = pooled(targets if knots else {k: (w,) for k, w in targets.items()}, window_tokens)
    if small:
        queue = local_table(docs.sparkSession, list(small.items()), pa.schema([("skey", pa.string()), ("share", pa.float64())]))
        own = with_prefix(counted.join(queue, "skey", "left_semi"), order).join(queue, "skey")
        timed = durable(own.select("doc_id", "source", "n_tokens", "file", "place", (F.col("before") / F.col("share")).alias("time"), F.col("skey").alias("own")))
        rows, end = timed.agg(F.count(F.lit(1)), F.max("time")).first()
        bucket = F.floor(F.col("time") / F.lit(max(end or 0.0, 1.0)) * F.lit(-(-rows // BUCKET_DOCS)))
        pool = with_prefix(timed.withColumns({"skey": F.lit("p"), "bucket": bucket.cast("long")}), ["time", "own", *order])
        rest = with_prefix(counted.join(queue, "skey", "left_anti"), order)
        kept = ["skey", "doc_id", "source", "n_tokens", "before"]
        placed = rest.select(*kept).unionByName(pool.select(*kept))
        totals["p"] = sum(totals.pop(k) for k in small)
        gone = [targets.pop(k) for k in small]
        targets["p"] = tuple(map(sum, zip(*gone))) if knots else sum(gone)
    else:
        placed = with_prefix(counted, order)
    if not totals:
        runs_ = []
    elif knots:
        runs_ = curved_schedule(totals, targets, knots, window_tokens)
    else:
        runs_ = schedule(totals, integer_shares(targets, window_tokens), window_tokens)
    kind = _CURVED_RUNS if knots else _RUNS
    runs = local_table(docs.sparkSession, [tuple(r[k] for k in kind.names) for r in runs_], kind)

    def cumulative(j: str, side: str) -> str:
        if knots:
            return f"CAST(floor({side}.base + CAST({j} AS DOUBLE) * ({side}.rise + {side}.bend * CAST({j} AS DOUBLE))) AS BIGINT)"
        # floor(j * window * side / parts) without overflow
        return f"((({j}) * {window_tokens}) DIV parts) * {side} + (((({j}) * {window_tokens}) % parts) * {side}) DIV parts"

    def given(j: str) -> str:
        return f"({cumulative(j, 'high')} - ({cumulative(j, 'low')}))"

    placed = placed.withColumn("after", F.expr("before + n_tokens"))
    taken = F.expr(f"CASE WHEN fixed >= 0 THEN fixed ELSE {given('windows')} END")
    hit = (
        placed.join(runs, "skey")
        .filter((F.col("before") < F.col("n0") + taken) & (F.col("after") > F.col("n0")))
        .withColumn("a", F.expr("greatest(before - n0, 0L)"))
        .withColumn("b", F.expr("after - n0"))
    )
    step = f"({window_tokens} * (high - low))"

    def window_of(n: str) -> str:  # the window in which a source's n-th token of the run lies, about
        if knots:
            rise, bend = "(high.rise - low.rise)", "(high.bend - low.bend)"
            return f"CAST(floor(2.0D * greatest({n}, 0L) / ({rise} + sqrt(greatest({rise} * {rise} + 4.0D * {bend} * greatest({n}, 0L), 0.0D)))) AS BIGINT)"
        return f"(({n}) * parts) DIV {step}"

    slack = 2 if knots else 1
    first = f"CASE WHEN fixed >= 0 THEN 0L ELSE greatest(0L, least(windows - 1, {window_of(f'(a - {slack})')} - 1)) END"
    last = f"CASE WHEN fixed >= 0 THEN 0L ELSE least(windows - 1, {window_of(f'(b + {slack})')} + 1) END"
    pieces = hit.withColumn("j", F.explode(F.expr(f"sequence({first}, {last})")))
    begin = F.expr(f"CASE WHEN fixed >= 0 THEN 0L ELSE {given('j')} END")
    end = F.expr(f"CASE WHEN fixed >= 0 THEN fixed ELSE {given('j + 1')} END")
    shift = F.expr(f"CASE WHEN fixed >= 0 THEN offset ELSE {cumulative('j + 1', 'low')} - ({cumulative('j', 'low')}) END")
    return (
        pieces.select("*", begin.alias("begin"), end.alias("end"), shift.alias("shift"))
        .withColumn("from", F.expr("greatest(a, begin)"))
        .withColumn("to", F.expr("least(b, end)"))
        .filter(F.col("from") < F.col("to"))
        .select(
            (F.col("first") + F.col("j")).alias("window_id"),
            (F.col("shift") + F.col("from") - F.col("begin")).alias("offset"),
            "doc_id",
            "source",
            (F.col("from") + F.col("n0") - F.col("before")).alias("start_token"),
            (F.col("to") - F.col("from")).alias("n_tokens"),
        )
    )
