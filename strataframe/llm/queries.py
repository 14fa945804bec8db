"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, jaccard, mixing, pii, quality, substrings, tokencounts, toxicity, urlfilter
from .common import read


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_url_filters": urlfilter.op5_url_filters,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_token_counts": tokencounts.op7_token_counts,
    "op8_pii": pii.op8_pii,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL = {"op2_substring_dedup": substrings.ORACLE, "op5_url_filters": urlfilter.ORACLE, "op6_jaccard_join": jaccard.ORACLE, "op10_mixing": mixing.ORACLE}
