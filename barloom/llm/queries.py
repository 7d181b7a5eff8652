"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from . import bpe, fingerprints, html_text, jaccard_join, mixing, quality_model, quality_rules, secrets, toxicity, unigram
from .common import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES = {
    "op1_quality_rules": lambda spark, sf_dir: quality_rules.query(documents(spark, sf_dir)),
    "op2_bpe": lambda spark, sf_dir: bpe.encode(documents(spark, sf_dir)),
    "op3_html_text": lambda spark, sf_dir: html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op4_unigram": lambda spark, sf_dir: unigram.count_tokens(documents(spark, sf_dir)),
    "op5_quality_model": lambda spark, sf_dir: quality_model.query(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op6_fingerprints": lambda spark, sf_dir: fingerprints.query(documents(spark, sf_dir)),
    "op7_toxicity": lambda spark, sf_dir: toxicity.query(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op8_jaccard_join": lambda spark, sf_dir: jaccard_join.join(documents(spark, sf_dir)),
    "op9_secrets": lambda spark, sf_dir: secrets.query(documents(spark, sf_dir)),
    "op10_mixing": lambda spark, sf_dir: mixing.query(documents(spark, sf_dir)),
}
ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_secrets": secrets.ORACLE,
}
