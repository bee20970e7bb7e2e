"""A corpus pipeline: toxic documents go, duplicate lines go, near-duplicates go, contaminated documents go, and sources are mixed.

Every stage is one of the operators of tessel.llm, applied to all that the stage before kept. A stage's result is written to
the folder that driver and executors share and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.decontaminate import contaminated, find_hits
from tessel.llm.line_dedup import without_duplicate_lines
from tessel.llm.mixing import mix
from tessel.llm.near_dup import near_duplicates
from tessel.llm.shared import cut, own, release, table
from tessel.llm.toxicity import apply, train

#: The whole pipeline learns a model, follows links and shuffles by hash: SQL can't express it. A plain version of it is in the tests.
ORACLE_SQL = None

#: What the stages add while they judge is named so, whatever the documents' own columns are called.
MINE = "_tessel_"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model rejects go; it learns from the labels of the documents themselves. Null and empty texts score 0 and stay,
    repeated rows are judged each on their own, an empty table gives an empty one."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return apply(docs, model, prefix=MINE).where(f"{MINE}predicted = 0").select(*own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays, and n_chars follows the text. A document all of whose lines stand in others goes; null, empty and blank texts
    and null ids stay as they are. Repeated rows keep the same lines."""
    kept = without_duplicate_lines(docs, drop_emptied=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*own(docs)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component of near-duplicates stays. Null and empty texts and null ids are linked with nothing and stay; rows that
    share a doc_id stay or go together."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(f"{MINE}id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(f"{MINE}id"), "left_anti").select(*own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go. Null and empty texts have no words and stay; repeated rows are judged each on their own."""
    return find_hits(docs, table(spark, sf_dir, "benchmark"), prefix=MINE).where(~contaminated(prefix=MINE)).select(*own(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with size, source_size, target, taken (words) and copies (times it is taken). Documents without words are taken
    no times and go. Columns of the documents that have one of these names are returned as <name>_of_document."""
    docs = docs.withColumnRenamed("copies", "copies_of_document")
    mixed = mix(docs, keep_text=True).where("taken > 0")
    return mixed.withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table. A stage's table goes once the next one's is written; the last stage keeps its own."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)
    return out
