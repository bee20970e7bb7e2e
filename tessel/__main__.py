"""python -m tessel search DB QUERIES.jsonl | evaluate CORPUS.jsonl QUERIES.jsonl NEW_DB [BATCH] | show RESULT.json|- [--markdown [PATH]] | prepare ... | benchmark NEW_DB [ROWS DIM QUERIES BATCH]"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tessel import prepare
from tessel.errors import VectorDbError
from tessel.report import report_text, search_text


def show(name: str, markdown: str | None) -> None:
    """A hyphen stands for the standard input, which needs a path for Markdown."""
    source = Path(name)
    result = json.loads(sys.stdin.read() if name == "-" else source.read_text())
    text = report_text(result) if "recall_at_10" in result else search_text(result)
    if markdown is None:
        print(text, end="")
        return
    if name == "-" and not markdown:
        raise ValueError("Markdown of the standard input needs a path")
    target = Path(markdown) if markdown else source.with_suffix(".md")
    if name != "-" and target.resolve() == source.resolve():
        raise ValueError("the report would replace its input")
    target.write_text(text)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessel", description=__doc__)
    kinds = parser.add_subparsers(dest="command", required=True)
    for name, names in (("search", ("db", "queries")), ("evaluate", ("corpus", "queries", "db")), ("show", ("result",))):
        sub = kinds.add_parser(name)
        for n in names:
            sub.add_argument(n)
        if name == "show":
            sub.add_argument("--markdown", nargs="?", const="", default=None)
        if name == "evaluate":
            sub.add_argument("batch", nargs="?", type=int, default=64)
    sub = kinds.add_parser("benchmark")
    sub.add_argument("db")
    for n, value in (("rows", 1000), ("dim", 32), ("queries", 20), ("batch", 128)):
        sub.add_argument(n, nargs="?", type=int, default=value)
    prepare.arguments(kinds.add_parser("prepare", help="Markdown notes and questions into files for evaluate"))
    asked = parser.parse_args(args)
    try:
        if asked.command == "show":
            show(asked.result, asked.markdown)
            return 0
        from pyspark.sql import SparkSession

        from tessel import evaluation

        spark = SparkSession.builder.appName("tessel").getOrCreate()
        if asked.command == "search":
            print(json.dumps(evaluation.search_file(spark, asked.db, asked.queries), ensure_ascii=False))
        elif asked.command == "benchmark":
            from tessel import benchmark

            print(json.dumps(benchmark.run(spark, asked.db, asked.rows, asked.dim, asked.queries, asked.batch)))
        elif asked.command == "prepare":
            print(json.dumps(prepare.run(spark, asked), ensure_ascii=False))
        else:
            if asked.batch < 1:
                raise ValueError("a batch has at least one row")
            print(json.dumps(evaluation.evaluate(spark, asked.corpus, asked.queries, asked.db, batch=asked.batch), ensure_ascii=False))
        return 0
    except (VectorDbError, OSError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
