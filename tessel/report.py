"""Answers and evaluation reports as plain text or Markdown: tables of what to print, and one renderer for them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

NONE = "n/a"


def written(value, kind: str = "") -> str:
    """A value as it is printed: milliseconds, seconds, a percentage, a mean, or itself."""
    forms: dict[str, Callable[[float], str]] = {"ms": "{:.1f} ms".format, "s": "{:.3f} s".format, "%": lambda x: f"{100 * x:.1f} %", "mean": "{:.3f}".format}
    return NONE if value is None else forms[kind](value) if kind else str(value)


def grid(head: Iterable[str], rows: Iterable[Iterable[str]]) -> list[str]:
    """A Markdown table; what is behind the first column is set to the right."""
    head = list(head)
    return ["| " + " | ".join(head) + " |", "|---" + "|---:" * (len(head) - 1) + "|", *("| " + " | ".join(r) + " |" for r in rows), ""]


def answers(result: dict) -> str:
    """A paragraph for each question: its documents by place, with score and the beginning of the passage on one line."""
    parts = []
    for q in result["queries"]:
        took = [f"({written(q['query_ms'], 'ms')})"] if "query_ms" in q else []
        parts.append("  ".join([q["text"], *took]))
        for place, d in enumerate(q["top_documents"], 1):
            passage = " ".join((d.get("snippet") or "").split())
            parts += [f"  {place}. {d.get('title') or d['source']}  [{d['source']}]  {d['score']:.4f}", f"     {passage}"]
        if not q["top_documents"]:
            parts.append("  nothing found")
    return "\n".join(parts) + "\n"


#: Lines of the report's tables: what is printed, the path to it, and how.
SIZES = [("model", "model", ""), ("documents", "documents", ""), ("chunks", "chunks", ""), ("of these at first", "initial_chunks", ""), ("of these added", "incremental_chunks", ""), ("dimensions", "dimensions", ""), ("questions", "n_queries", ""), ("labelled questions", "labelled_queries", ""), ("rows in a batch", "batch_size", "")]
STEPS = [("first ingest", "initial_ingest_ms", "ms"), ("first build", "initial_build_ms", "ms"), ("second ingest", "incremental_ingest_ms", "ms"), ("reopen, refresh", "refresh_ms", "ms")]
RANKINGS = ("semantic", "exact", "keyword")


def evaluation(report: dict) -> str:
    """The evaluation as a Markdown document, with a row for each question at its end."""
    lines = ["# Retrieval evaluation", ""]
    lines += grid(("corpus", "value"), ((what, written(report.get(key), kind)) for what, key, kind in SIZES))
    lines += grid(("step", "time"), ((what, written(report.get(key), kind)) for what, key, kind in STEPS))
    lines += grid(("search", "p50", "p95"), ((way, *(written(report[f"{way}_ms"][p], "ms") for p in ("p50", "p95"))) for way in ("ann", "exact")))
    lines += [f"Recall@10 against exact search: {written(report['recall_at_10'], '%')}.", ""]
    lines += grid(("ranking", "hit rate@5", "MRR@5"), ((x, written(report[x]["hit_rate_at_5"], "%"), written(report[x]["mrr_at_5"], "mean")) for x in RANKINGS))
    lines += [f"Note replaced and found again, also after opening anew: {'yes' if report['note_lifecycle'] else 'no'}.", ""]
    cell = lambda x: " ".join(str(x).split()).replace("|", "\\|")
    ranks = [(cell(q["text"]), *(written(q.get(f"{x}_rank_at_5")) for x in RANKINGS), cell(q["top_documents"][0]["source"]) if q["top_documents"] else "nothing") for q in report["queries"]]
    lines += ["Places of the first relevant document, and the best document found:", "", *grid(("question", *RANKINGS, "first"), ranks)]
    return "\n".join(lines)


report_text, search_text = evaluation, answers
