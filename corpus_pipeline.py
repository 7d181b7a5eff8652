"""The documents table made ready for training, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame. What it returns is written as
Parquet and read again as the next one's docs; all but the last return the columns
of documents. Repeated doc_ids, null texts and further columns are kept as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, jaccard_join, mixing, secrets, toxicity
from barloom.llm.common import Cuts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the FTRL model scores at toxicity.THRESHOLD or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a chain of five-word Jaccards of 0.8 or more stays."""
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets read secrets.MASK; every document stays."""
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, or up to three times."""
    return mixing.repeat(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of what is left."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: A trained model and hashed chances are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; tables between stages go to the shared folder.

    Once a stage's rows are written, what it was made from is removed. An empty table gives an
    empty result; very long texts go through every stage whole.
    """
    cuts, docs = Cuts(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    held, before = len(Cuts.open), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cuts.cut(docs)
            Cuts.end(held)
            if before is not None:
                cuts.drop(before)
            before = docs
    return docs
