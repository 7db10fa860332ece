"""A training-data pipeline over ``documents``: quality rules, near-duplicate
join, substring dedup, source mixing and sampled piece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake.llm import mixing, quality_rules, repeated_spans, sampled_pieces, shingle_join
from recentlake.llm.common import python_batches, read_table, saved


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail a quality rule, or are outliers of their language and
    source, go."""
    python_batches(spark)
    return quality_rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents stays."""
    python_batches(spark)
    return shingle_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut from the texts."""
    python_batches(spark)
    return repeated_spans.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order."""
    python_batches(spark)
    return mixing.mixed(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``text`` as the ids of a sampled segmentation."""
    python_batches(spark)
    return sampled_pieces.encoded(docs).withColumn("n_pieces", F.size("ids"))


STAGES = [
    ("quality_rules", drop_outliers),
    ("shingle_join", drop_near_copies),
    ("repeated_spans", cut_repeats),
    ("mix_sources", mix_sources),
    ("sampled_pieces", encode_pieces),
]

#: Robust estimates, label propagation and sampled segmentations are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
