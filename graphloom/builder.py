"""Queries built step by step; the result is the same text that cypher() takes.

    Match("(c:Customer)-[:PLACED]->(o:Order)").where("o.totalprice > $p").returns("c.name AS name", "count(o) AS n").order_by("n DESC").limit(5).run(session, p=1.0)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .session import GraphSession


@dataclass(frozen=True)
class Pipeline:
    clauses: tuple[str, ...] = ()

    def _add(self, clause: str) -> "Pipeline":
        return Pipeline((*self.clauses, clause))

    def match(self, *patterns: str) -> "Pipeline":
        return self._add("MATCH " + ", ".join(patterns))

    def optional_match(self, *patterns: str) -> "Pipeline":
        return self._add("OPTIONAL MATCH " + ", ".join(patterns))

    def where(self, condition: str) -> "Pipeline":
        return self._add("WHERE " + condition)

    def with_(self, *items: str, distinct: bool = False) -> "Pipeline":
        return self._add("WITH " + "DISTINCT " * distinct + ", ".join(items))

    def unwind(self, expression: str, name: str) -> "Pipeline":
        return self._add(f"UNWIND {expression} AS {name}")

    def returns(self, *items: str, distinct: bool = False) -> "Pipeline":
        return self._add("RETURN " + "DISTINCT " * distinct + ", ".join(items))

    def order_by(self, *keys: str) -> "Pipeline":
        return self._add("ORDER BY " + ", ".join(keys))

    def skip(self, n: int) -> "Pipeline":
        return self._add(f"SKIP {int(n)}")

    def limit(self, n: int) -> "Pipeline":
        return self._add(f"LIMIT {int(n)}")

    @property
    def text(self) -> str:
        return "\n".join(self.clauses)

    def run(self, session: GraphSession, **params) -> DataFrame:
        return session.cypher(self.text, params)


def Match(*patterns: str) -> Pipeline:  # noqa: N802
    return Pipeline().match(*patterns)
