"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.decontaminate import decontaminate
from tessel.llm.line_dedup import line_dedup
from tessel.llm.mixing import mix
from tessel.llm.near_dup import near_duplicates
from tessel.llm.phrase_dedup import remove_repeats
from tessel.llm.pii import pii_report
from tessel.llm.preference import preference_report
from tessel.llm.repetition import repetition
from tessel.llm.secrets import secret_report
from tessel.llm.shared import table
from tessel.llm.toxicity import toxicity


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_report(table(spark, sf_dir, "conversations"))


def op8_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("offending", F.array_join(F.transform("offending", lambda x: x.cast("string")), ","))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_spans")


def op10_inferred_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repetition, op2_weighted_fair_mix, op3_fuzzy_lines, op4_repeated_phrases, op5_pii_spans, op6_near_duplicates, op7_preference_format, op8_noisy_or_toxicity, op9_decontaminate, op10_inferred_formats)}
