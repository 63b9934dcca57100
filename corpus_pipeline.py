"""From raw documents to token ids in five stages, each a DataFrame job over what the one before kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared checkpoint folder and reads it again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundlake.llm import op1_quality, op3_bpe, op4_jaccard, op7_decontaminate, op8_suffixes
from fundlake.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted on the labelled documents of ``sf_dir``, accepts."""
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return op1_quality.accepted(docs, op1_quality.train(labelled, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity 0.8 of five-word shingles."""
    return op4_jaccard.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller doc_id has; a text may become empty."""
    return op8_suffixes.cleaned(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like an item of the benchmark."""
    return op7_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every document."""
    import public_tokenizers
    return op3_bpe.encode(docs, public_tokenizers.path(op3_bpe.VOCABULARY))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("decontaminate", decontaminate), ("tokenize", tokenize)]

ORACLE_SQL = None  # a trained classifier and a trie join are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
