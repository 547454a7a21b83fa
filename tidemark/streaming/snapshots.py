"""Count-based snapshots over a stream of commits (the streaming counterpart of WIN1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def snapshot_stream(commits: DataFrame, size: int) -> DataFrame:
    """(project, commit_id, snapshot_index) of a stream of (project, commit_id, ord, is_c), as the commits come in.

    State is the number of relevant commits of each project so far. Within a batch commits are taken in order of ord; batches must
    arrive in that order. An unfinished snapshot's commits come out as well: whether it is finished is known only at its end.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ord")
        relevant = rows["is_c"].astype(int)
        before = seen + relevant.cumsum() - relevant
        state.update((int(seen + relevant.sum()),))
        yield pd.DataFrame({"project": key[0], "commit_id": rows["commit_id"], "snapshot_index": (before // size).astype("int32")})

    return commits.groupBy("project").applyInPandasWithState(step, "project long, commit_id long, snapshot_index int", "seen long", "append", "NoTimeout")


def hunk_counts(hunks: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "7 days") -> DataFrame:
    """Hunks and changed lines by file and event-time window; rows later than `late` are dropped."""
    from pyspark.sql import functions as F

    return (
        hunks.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "file")
        .agg(F.count(F.lit(1)).alias("hunks"), F.sum(F.col("added") + F.col("deleted")).alias("lines"))
        .select(F.col("w.start").alias("start"), "file", "hunks", "lines")
    )
