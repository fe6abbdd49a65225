"""Command line: one statement, a batch from standard input, or a prompt.

    python -m graphloom --tables DIR -c "MATCH (n) RETURN count(*) AS n"
    python -m graphloom --open DIR < batch.cypher
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .errors import GraphError
from .session import GraphSession

HELP = ".schema .labels .types .props .indexes .help .quit, or a statement that ends with ;"
ABOUT = {".labels": "CALL db.labels()", ".types": "CALL db.relationshipTypes()", ".props": "CALL db.propertyKeys()", ".indexes": "CALL db.indexes()"}


def show(df: DataFrame, rows: int, out) -> None:
    """At most so many rows as lines of JSON; a note tells if there are more."""
    if not df.columns:
        return
    found = df.limit(rows + 1).toJSON().collect() if rows else df.toJSON().toLocalIterator()
    for i, line in enumerate(found):
        if rows and i == rows:
            print(f"-- more than {rows} rows", file=out)
            break
        print(line, file=out)


def command(session: GraphSession, line: str, rows: int, out) -> None:
    """One dot command, or a batch of statements."""
    if line == ".help":
        print(HELP, file=out)
    elif line == ".schema":
        print(json.dumps(session.introspect_schema(), indent=1), file=out)
    elif line in ABOUT:
        show(session.cypher(ABOUT[line]), rows, out)
    elif line.startswith("."):
        print(f"unknown command {line}; {HELP}", file=out)
    else:
        for df in session.execute_batch(line):
            show(df, rows, out)


def prompt(session: GraphSession, rows: int, source, out) -> None:
    """Reads until the end or .quit; an error is printed and doesn't end it."""
    pending = ""
    while True:
        print("... " if pending else "> ", end="", file=out, flush=True)
        line = source.readline()
        if not line or line.strip() == ".quit":
            return
        pending += line
        text = pending.strip()
        if text.startswith(".") or text.endswith(";"):
            pending = ""
            try:
                command(session, text, rows, out)
            except GraphError as e:
                print(f"{type(e).__name__}: {e}", file=out)
        elif not text:
            pending = ""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--open", help="a folder that backup_to() wrote")
    where.add_argument("--tables", help="a folder of relational tables to lift to a graph")
    p.add_argument("-c", "--command", help="run this and end")
    p.add_argument("--rows", type=int, default=1000, help="rows shown of a result; 0 shows all")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    s = GraphSession.open(spark, a.open) if a.open else GraphSession.from_tables(spark, a.tables) if a.tables else GraphSession.in_memory(spark)
    try:
        if a.command is not None:
            command(s, a.command.strip(), a.rows, sys.stdout)
        elif sys.stdin.isatty():
            prompt(s, a.rows, sys.stdin, sys.stdout)
        else:
            command(s, sys.stdin.read(), a.rows, sys.stdout)
    except GraphError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
