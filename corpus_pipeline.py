"""From raw documents to packed training windows: quality rules, exact dedup, near copies, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return the columns
of documents; the last one returns the windows' pieces.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import curriculum, exact_dedup, fertility, jaccard, packing
from tidemark.llm.kit import discard, durable, tracked

WINDOW_TOKENS = 32_768
#: The sources' weights over training: source mixing places documents by them, packing fills each window by them.
SCHEDULE = {"weights": curriculum.WEIGHTS, "default": curriculum.DEFAULT_WEIGHTS, "knots": curriculum.KNOTS}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the fertility bands of their language go."""
    return fertility.keep_natural(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one with the smallest doc_id stays."""
    return exact_dedup.drop_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in order of their training position under the sources' weight schedules."""
    return curriculum.mix_sources(docs, **SCHEDULE, added=None)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows filled by deficit round-robin over the sources, each at the schedule's shares over its own tokens.

    A source's queue is in the order that source mixing stored its documents in. Documents that aren't read from files, which
    have no stored order, queue by doc_id.
    """
    try:
        docs.select("_metadata.row_index")
        stored = True
    except AnalysisException:
        stored = False
    return packing.pack(docs, WINDOW_TOKENS, weights={**SCHEDULE["weights"], None: SCHEDULE["default"]}, knots=SCHEDULE["knots"], stored=stored)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mixing", source_mix),
    ("packing", windows),
]

#: The first and the last stage can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder.

    What a stage and the one before it wrote there for themselves is deleted once the stage's own result is.
    """
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        with tracked() as held:
            docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            fresh: list[str] = []
            docs = durable(docs, fresh)
            discard(spark, held + spent)
            spent = fresh
    return docs
