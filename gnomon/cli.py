"""python -m gnomon.cli ingest|list|info|ask|analyze, as text or, with --json, as a JSON object a line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from gnomon import service
from gnomon.functions import text as T
from gnomon.operators import insights
from gnomon.session import local_session
from gnomon.sources.store import GnomonError, Store


def as_json(df: DataFrame) -> Iterator[str]:
    """Rows as JSON objects, null fields left out."""
    return (r[0] for r in df.select(T.row_json(df)).toLocalIterator())


def metadata_lines(row: dict) -> Iterator[str]:
    """A repository's name and, indented, what is known of it."""
    yield row["repo"]
    for name in ("source", "ingested_at", "schema_version", "summary"):
        if row[name] is not None:
            yield f"  {name}: {row[name]}"
    yield f"  files: {len(row['files'] or ())}, symbols: {row['symbol_count']}"


def answer_lines(answer: dict, cited: list[dict], issues: list[dict]) -> Iterator[str]:
    """The answer, how sure it is, its numbered sources, and what is wrong with it."""
    yield answer["answer"] or "(no answer)"
    yield f"confidence {answer['confidence']}, evidence {'sufficient' if answer['evidence_sufficient'] else 'not sufficient'}"
    for c in cited:
        span = f":{c['start_line']}-{c['end_line']}" if c["start_line"] and c["end_line"] else ""
        yield "  " + " ".join(x for x in (f"[{c['item']}]", c["source"], c["qualified_name"], (c["file_path"] or "(no location)") + span) if x)
    for i in issues:
        yield f"{i['severity']}: {i['message']}"


def report_lines(statistics: DataFrame, findings: DataFrame | None, ran: list[str], warned: list[tuple[str, str]]) -> Iterator[str]:
    """Counters, findings per category, each finding with its place and description, and warnings."""
    for row in statistics.toLocalIterator():
        yield "statistics: " + ", ".join(f"{k} {v}" for k, v in row.asDict().items() if k != "repo")
    yield f"analyzers: {', '.join(ran)}"
    if findings is not None:
        for row in findings.groupBy("category").count().orderBy("category").toLocalIterator():
            yield f"{row['category']}: {row['count']}"
        for row in findings.orderBy("category", "id").toLocalIterator():
            place = f" ({row['file_path']}{':' + str(row['start_line']) if row['start_line'] else ''})" if row["file_path"] else ""
            yield f"[{row['severity']}] {row['title']}{place}"
            yield f"    {row['description']}"
    for name, message in warned:
        yield f"warning: {name}: {message}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gnomon")
    p.add_argument("--store", default="gnomon-store")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("ingest", ["root", "repo"]), ("list", []), ("info", ["repo"]), ("ask", ["repo", "question"]), ("analyze", ["repo"])):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "analyze":
            s.add_argument("--category", choices=service.CATEGORIES)
            s.add_argument("--severity", choices=insights.SEVERITIES)
    return p


def lines(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """What a command says."""
    store = Store(spark, a.store)
    if a.command == "ingest":
        service.ingest(spark, a.root, a.repo, store)
    elif a.command == "list":
        yield from store.repos()
    elif a.command == "info":
        store.check(a.repo)
        meta = store.read("repo_metadata", a.repo)
        yield from as_json(meta) if a.json else metadata_lines(meta.first().asDict())
    elif a.command == "ask":
        frames = service.ask(spark, service.tables(store, a.repo), a.repo, a.question)
        if a.json:
            for df in frames:
                yield from as_json(df)
        else:
            answer, cited, issues = ([r.asDict() for r in df.collect()] for df in frames)  # of one question
            yield from answer_lines(answer[0] if answer else {"answer": "", "confidence": "low", "evidence_sufficient": False}, cited, issues)
    else:
        t = service.tables(store, a.repo)
        found, ran, warned = service.analyze(t, a.category)
        found = found if found is None else insights.only(found, severity=a.severity)
        if a.json:
            yield from as_json(found) if found is not None else ()
        else:
            yield from report_lines(insights.statistics(t.files, t.symbols, t.imports, t.calls, t.inherits), found, ran, warned)


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:  # argparse has said why
        return 1 if e.code else 0
    try:
        for line in lines(local_session("*"), a):
            print(line)
    except GnomonError as e:
        print(str(e), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
