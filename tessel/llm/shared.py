"""Shared tables that cut lineage, and the session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch. Texts can be long, so batches stay far below Spark's default of 10,000 rows.
ARROW_ROWS = 1000
#: While a table is written, shuffle files go with the query's end, and generated methods that the JVM would only interpret (above 8000 bytes) are not used:
#: such a part of a plan runs by operators whose expressions are compiled in pieces.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
_LOCK, _HELD = threading.Lock(), {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here if that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tessel-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _writing(spark: SparkSession):
    """Within, SETTINGS hold. They belong to the session, so they are counted in and out: queries that overlap
    in one session leave them on until the last of them ends, which costs nothing but files that are kept or dropped sooner."""
    with _LOCK:
        state = _HELD.setdefault(id(spark), [0, {}])
        if not state[0]:
            state[1] = {k: spark.conf.get(k, None) for k in SETTINGS}
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
        state[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            state[0] -= 1
            if not state[0]:
                for k, v in state[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and a lost executor costs nothing that was
    written. The shuffle files behind it have served, and go at once rather than when the driver happens to collect garbage."""
    spark = df.sparkSession
    path = _place(spark)
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def first_row(df: DataFrame) -> Row:
    """The first row; the shuffle files behind it go at once, as in cut()."""
    with _writing(df.sparkSession):
        return df.select("*").first()


def _place(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the application ends at the latest: a result that is still to be read may read such tables."""
    path = f"{shared_dir(spark)}/tessel/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing unfinished reads them."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_written", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tune(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds, unless the session asks for less already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(docs: DataFrame) -> list[Column]:
    """The columns of a table, whatever characters their names hold."""
    return [named(c) for c in docs.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def with_first(rows: DataFrame, key: list[str], parts: int = 256) -> DataFrame:
    """(*key, doc_id, first) of rows (*key, doc_id) whose key is met under several doc_ids; first is the least of these.

    A key that a third of all rows share is dealt into parts: rows meet their key's part, and only parts meet the key.
    """
    dealt = rows.select(*key, "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("_part"))
    part = dealt.groupBy(*key, "_part").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
    several = part.groupBy(*key).agg(F.min("x").alias("first"), F.max("y").alias("last")).where("first <> last").select(*key, "first")
    return dealt.join(part.select(*key, "_part").join(several, key), [*key, "_part"]).drop("_part")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names; any other column is pruned at the scan."""
    return docs.select(F.col(key).cast(T.LongType()).alias("doc_id"), F.col(text).cast(T.StringType()).alias("text"))


def append(docs: DataFrame, block_fn, fields: list[T.StructField], text: str = "text") -> DataFrame:
    """docs with further columns that block_fn(block) -> list of Arrow arrays computes; no shuffle, and rows stay as they are."""
    from tessel.llm.text import blocks

    tune(docs.sparkSession)
    # Between the JVM and Python columns go by plain names, as a name may hold a dot.
    names, n = [*docs.columns, *(f.name for f in fields)], len(docs.columns)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*docs.schema.fields, *fields])])

    def run(batches):
        import pyarrow as pa

        whole = (pa.RecordBatch.from_arrays(b.columns, names=names[:n]) for b in batches)
        for block in blocks(whole, text):
            yield pa.RecordBatch.from_arrays([*block.columns, *block_fn(block)], names=schema.fieldNames())

    return docs.toDF(*schema.fieldNames()[:n]).mapInArrow(run, schema).toDF(*names)
