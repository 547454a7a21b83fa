"""Commit graphs: order, reachability, branches (SRT2, GR1 to GR7, GR12)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ancestry import Graph, closure, distances, joint_rows, listed_ancestors, nearest_changes, related, without_listed_ancestor  # noqa: F401
from tidemark.operators.ancestry import ages as ages_by_project  # noqa: F401
from tidemark.operators.shared import kept


def closure_pandas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Reflexive closure of one project's edges (child, parent; parent may be NULL), by bit sets in topological order."""
    graph = Graph([int(c) for c in pdf["child"]], [int(p) if pd.notna(p) else None for p in pdf["parent"]])
    pieces = list(graph.pairs())
    d, a = (np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, int) for k in (0, 1))
    names = np.array(graph.names, np.int64)
    return pd.DataFrame({"descendant": names[d], "ancestor": names[a]}).assign(project=pdf["project"].iloc[0] if len(pdf) else None)


def roots(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR4: commits without parents."""
    return commits.join(edges.select(F.col("child").alias("commit_id")), "commit_id", "left_anti")


def walk_pandas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Order of one project's commits: the earliest (ts, commit_id) of those whose parents are all done."""
    parents, children, ts = {}, {}, {}
    for c, t, p in zip(pdf["commit_id"], pdf["ts"], pdf["parent"]):
        ts[c] = t
        parents.setdefault(c, set())
        if pd.notna(p):
            parents[c].add(int(p))
            children.setdefault(int(p), set()).add(c)
    left = {c: sum(p in ts for p in ps) for c, ps in parents.items()}
    queue = [(ts[c], c) for c in ts if not left[c]]
    heapq.heapify(queue)
    out = []
    while queue:
        _, c = heapq.heappop(queue)
        out.append(c)
        for x in children.get(c, ()):
            left[x] -= 1
            if not left[x]:
                heapq.heappush(queue, (ts[x], x))
    return pd.DataFrame({"project": pdf["project"].iloc[0], "commit_id": out, "ord": range(len(out))})


def walk(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR5: (project, commit_id, ord): commits in order of time, no commit before its parents."""
    e = edges.select("project", F.col("child").alias("commit_id"), "parent")
    rows = commits.select("project", "commit_id", "ts").join(e, ["project", "commit_id"], "left")
    return rows.groupBy("project").applyInPandas(walk_pandas, "project long, commit_id long, ord long")


def degrees(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG10: parents and children of each commit."""
    up = edges.groupBy(F.col("child").alias("commit_id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    down = edges.groupBy(F.col("parent").alias("commit_id")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    return commits.select("commit_id").join(up, "commit_id", "left").join(down, "commit_id", "left")


def branch_kinds(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR6: how a commit joins branches: root, continue, split (its parent has more children), merge."""
    kids = edges.groupBy("parent").agg(F.count_distinct("child").alias("kids"))
    up = edges.join(kids, "parent").groupBy(F.col("child").alias("commit_id")).agg(F.count_distinct("parent").alias("n"), F.max("kids").alias("kids"))
    kind = F.when(F.col("n").isNull(), "root").when(F.col("n") > 1, "merge").when(F.col("kids") > 1, "split").otherwise("continue")
    return commits.select("commit_id").join(up, "commit_id", "left").select("commit_id", kind.alias("kind"))


def branches(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """GR6: (commit_id, kind, branch): a commit that continues its parent is on its branch, any other starts one, named by the commit.

    Parents are followed by doubling, so the rounds grow with the logarithm of a branch's length.
    """
    kinds = branch_kinds(commits, edges)
    parent = edges.select(F.col("child").alias("commit_id"), "parent").distinct()
    start = kinds.join(parent.join(kinds.filter("kind = 'continue'").select("commit_id"), "commit_id", "left_semi"), "commit_id", "left")
    known = kept(start.select("commit_id", "kind", F.coalesce("parent", "commit_id").alias("branch")))
    while True:
        ahead = known.select(F.col("commit_id").alias("branch"), F.col("branch").alias("next"))
        further = kept(known.join(ahead, "branch", "left").select("commit_id", "kind", F.coalesce("next", "branch").alias("branch"), (F.col("next") != F.col("branch")).alias("moved")))
        if not further.filter("moved").limit(1).count():
            return known
        known = further.drop("moved")


def integer_keys(rows: DataFrame) -> DataFrame:
    """SRT2: keys of commits by first appearance, as child or parent, in rows sorted by (ts, commit, parent)."""
    order = Window.partitionBy("project").orderBy("ts", "child", F.col("parent").asc_nulls_first())
    r = rows.withColumn("r", F.row_number().over(order))
    names = r.select("project", F.col("child").alias("commit_id"), (F.col("r") * 2).alias("at")).unionByName(
        r.filter("parent IS NOT NULL").select("project", F.col("parent").alias("commit_id"), (F.col("r") * 2 + 1).alias("at"))
    )
    first = names.groupBy("project", "commit_id").agg(F.min("at").alias("at"))
    return first.withColumn("key", (F.row_number().over(Window.partitionBy("project").orderBy("at")) - 1).cast("long")).drop("at")


def chains_pandas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Linear branches of one project: a commit follows its first parent unless an earlier child took that place."""
    rows = pdf.sort_values("ord")
    branch, place, taken = {}, {}, set()
    for c, p in zip(rows["commit_id"], rows["first_parent"]):
        if pd.notna(p) and int(p) in branch and int(p) not in taken:
            taken.add(int(p))
            branch[c], place[c] = branch[int(p)], place[int(p)] + 1
        else:
            branch[c], place[c] = c, 0
    return pd.DataFrame({"project": pdf["project"].iloc[0], "commit_id": list(branch), "branch": list(branch.values()), "place": list(place.values())})


def linear_branches(commits: DataFrame) -> DataFrame:
    """GR12: (project, commit_id, branch, place); a branch is named by its first commit. Ties go to the commit of lower ord."""
    rows = commits.select("project", "commit_id", "first_parent", "ord")
    return rows.groupBy("project").applyInPandas(chains_pandas, "project long, commit_id long, branch long, place long")
