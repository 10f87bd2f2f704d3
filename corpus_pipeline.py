"""From raw documents to token files: five stages, each written as Parquet before the next one reads it.

Quality, near duplicates, contamination, mixture, tokens. The classifier is learned from the table
``labels`` and the contamination is judged against the table ``benchmark`` beside the documents. No
SQL can express the classifier, so there is no SQL for the rows of ``run``; the stages are tested
against brute-force versions instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import contamination, jaccard, mixing, quality, token_files
from statloom.llm.common import table
from statloom.llm.queries import tokenizer_path
from statloom.session import shared_folder

ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8) one document stays."""
    return jaccard.keep_first(docs, width=5, least=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words of the benchmark go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending document order; returns what is read back from them."""
    files = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(docs, files, tokenizer_path())
    return token_files.digests(spark, files)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", different),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
