"""Markdown notes of folders as a table. Folders may lie in any store that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of build output and dependencies.
SKIPPED = "target|dist|node_modules|vendor|Secure"
#: A path below a root that is a note: no part is hidden, no folder is skipped, and the name ends as Markdown does.
NOTE = re.compile(rf"(?:(?!\.|(?:{SKIPPED})/)[^/]+/)*(?!\.)[^/]*\.(?i:md)")


def notes_under(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(path, path below the root) of the notes of a folder, by path; of a file, the file itself under its name. Links, and what lies behind them, are no notes.

    The store lists all files below the root at once; only their names come to the driver.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)
    folder = at if fs.getFileStatus(at).isDirectory() else at.getParent()
    prefix, files, found = folder.toString().rstrip("/") + "/", fs.listFiles(at, True), []
    while files.hasNext():
        path = files.next().getPath().toString()
        below = path.removeprefix(prefix)
        if NOTE.fullmatch(below) and not (path.startswith("file:") and _through_link(jvm, folder.toUri().getPath(), below)):
            found.append((path, below))
    return sorted(found, key=lambda x: x[1])


def _through_link(jvm, folder: str, below: str) -> bool:
    """Whether any part of a path below a local folder is a symbolic link."""
    path = jvm.java.io.File(folder).toPath()
    for part in below.split("/"):
        path = path.resolve(part)
        if jvm.java.nio.file.Files.isSymbolicLink(path):
            return True
    return False


def read_notes(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(source, text, sha256) of the notes under each labelled root; source is label/path below it. Executors read the contents."""
    rows = [(path, f"{label}/{below}") for label, root in sorted(roots.items()) for path, below in notes_under(spark, str(root))]
    if not rows:
        return spark.createDataFrame([], "source string, text string, sha256 string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  (a store may write its own paths in two ways)
    names = spark.createDataFrame(rows, "at string, source string").select(plain("at").alias("at"), "source")
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path, _ in rows]
    files = spark.read.format("binaryFile").load(literal).select(plain("path").alias("at"), "content")
    return names.join(files, "at").select("source", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
