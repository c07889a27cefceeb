"""The training-data pipeline: every stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnscope.llm import decontaminate, jaccard_join, line_dedup, quality_rules, segment_sampling
from turnscope.llm.lattice import Vocabulary
from turnscope.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the learned decision list or its fixed minimum rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each host; every document stays."""
    return line_dedup.without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, also of exact copies without words."""
    return jaccard_join.one_of_each(docs, bare_once=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    items = materialize(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), "items")
    return decontaminate.without_items(docs, items)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left."""
    options = segment_sampling.SampleOptions()
    return segment_sampling.sample(docs, Vocabulary.load(segment_sampling.MODEL, options.smoothing), options)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("sentencepiece sampling", pieces),
]

ORACLE_SQL = None  # learned rules, hashing tries and sampled segmentations have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
