"""JSON lines: corpus rows and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.errors import InvalidInput
from tessel.functions.checks import finite

CORPUS = "vector array<float>, metadata struct<source:string,title:string,chunk:int,tags:array<string>,text:string,model:string>"
QUERIES = "text string, vector array<float>, model string, relevant_paths array<string>, keyword_top_sources array<string>, filter_tag string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a line that isn't of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, QUERIES)
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("relevant_paths", "keyword_top_sources")})


def write_jsonl(rows: DataFrame, path: str, vector: str = "vector") -> None:
    """UTF-8 lines; vectors that aren't finite are refused, as JSON has no word for them."""
    if vector in rows.columns and not rows.where(~finite(vector)).isEmpty():
        raise InvalidInput("vector elements must be finite")
    rows.write.mode("errorifexists").json(path)
