"""Tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines must see.

    A session on one machine that names none gets a folder of its own; on a cluster there is no way without it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        place = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input files that a task of a wide step is meant for.
TASK_BYTES = 8 << 20


def task_count(*inputs: DataFrame) -> int:
    """Partitions of a wide step over these inputs: they grow with the files, so that a task's memory doesn't."""
    size = 0
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.length()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
