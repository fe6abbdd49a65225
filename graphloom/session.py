"""Sessions: queries, parameters, transactions, procedures, limits and results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Cancelled, GraphError, QueryTimeout, ResourceLimit, runtime_errors
from .functions.values import plain
from .operators.mutate import Stats, check_unique
from .plans.compiler import Compiler, Uses
from .plans.syntax import Query, parse, split_batch
from .sources.graph import Graph, lift

WRITES = ("create", "merge", "set", "remove", "delete")


@dataclass(frozen=True)
class Procedure:
    """inputs and outputs: (name, type); call(graph, *arguments) -> DataFrame."""

    inputs: tuple
    outputs: tuple
    call: Callable[..., DataFrame]


def _labels(g: Graph) -> DataFrame:
    parts = [t.select(F.explode("_labels").alias("label")) for t in g.nodes.values()]
    if not parts:
        return g.spark.createDataFrame([], "label string, count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def _types(g: Graph) -> DataFrame:
    parts = [t.select("_type") for t in g.rels.values()]
    if not parts:
        return g.spark.createDataFrame([], "relationshipType string, count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.col("_type").alias("relationshipType")).agg(F.count(F.lit(1)).alias("count"))


BUILT_IN = {
    "db.labels": Procedure((), (("label", "STRING"), ("count", "INTEGER")), _labels),
    "db.relationshiptypes": Procedure((), (("relationshipType", "STRING"), ("count", "INTEGER")), _types),
    "db.propertykeys": Procedure((), (("propertyKey", "STRING"),), lambda g: g.spark.createDataFrame([(k,) for k in g.property_keys()], "propertyKey string")),
    "db.indexes": Procedure((), (("label", "STRING"), ("property", "STRING"), ("unique", "BOOLEAN")), lambda g: g.spark.createDataFrame([(*k, u) for k, u in sorted(g.indexes.items())], "label string, property string, unique boolean")),
}


class GraphSession:
    """One graph and a query language on it.

    Reads are lazy DataFrames over an immutable graph; each writing statement
    makes a new graph, which a transaction publishes at its commit.
    """

    def __init__(self, graph: Graph):
        self.graph, self.spark = graph, graph.spark
        self.procedures = dict(BUILT_IN)
        self.stats = Stats()
        self._saved: Graph | None = None
        self._sizes: dict[int, tuple[DataFrame, int]] = {}

    @classmethod
    def in_memory(cls, spark: SparkSession) -> "GraphSession":
        return cls(Graph(spark))

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> "GraphSession":
        return cls(lift(spark, sf_dir))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "GraphSession":
        from .sources.store import load

        return cls(load(spark, path))

    def backup_to(self, path: str) -> None:
        from .sources.store import save

        save(self.graph, path)

    def register(self, name: str, inputs, outputs, call) -> None:
        self.procedures[name.lower()] = Procedure(tuple(inputs), tuple(outputs), call)

    # -- transactions
    def begin(self) -> None:
        if self._saved is not None:
            raise GraphError("a transaction is open already")
        self._saved = self.graph

    def commit(self) -> None:
        if self._saved is None:
            raise GraphError("no transaction is open")
        self._saved = None

    def rollback(self) -> None:
        if self._saved is None:
            raise GraphError("no transaction is open")
        self.graph, self._saved = self._saved, None

    # -- queries
    def cypher(self, text: str, params: dict | None = None, max_rows: int | None = None, timeout: float | None = None, **more) -> DataFrame:
        """The result of one statement; max_rows and timeout run it at once and make too much of either an error."""
        st = parse(text)
        if st.kind in ("begin", "commit", "rollback"):
            getattr(self, st.kind)()
            return self._none()
        if st.kind == "index":
            label, prop, unique = st.body
            if unique:
                check_unique(self.graph, label, prop)
            self.graph = self.graph.with_(indexes={**self.graph.indexes, (label, prop): unique})
            return self._none()
        if st.kind == "drop_index":
            self.graph = self.graph.with_(indexes={k: v for k, v in self.graph.indexes.items() if k != st.body[:2]})
            return self._none()
        c = Compiler(self.graph, {**(params or {}), **more}, self.procedures, dt.datetime.now(dt.timezone.utc))
        c.stats = Stats()
        if st.kind == "explain":
            return self._explain(c, st.body)
        try:
            out = c.query(st.body)
        except GraphError:
            if self._saved is not None:
                self.rollback()  # a failed statement ends its transaction
            raise
        if self._writes(st.body):
            self.graph, self.stats = c.graph, c.stats
        made = {f.name: plain(F.col(f"`{f.name}`"), f.dataType) for f in out.schema}
        if any(changed for _, changed in made.values()):
            out = out.select(*[c.alias(n) for n, (c, _) in made.items()])
        return self._limited(out, max_rows, timeout) if max_rows is not None or timeout is not None else out

    execute = cypher

    def execute_with_stats(self, text: str, params: dict | None = None) -> tuple[DataFrame, Stats]:
        self.stats = Stats()
        out = self.cypher(text, params)
        return out, self.stats

    def execute_batch(self, text: str, params: dict | None = None) -> list[DataFrame]:
        return [self.cypher(s, params) for s in split_batch(text)]

    def execute_batch_grouped(self, text: str, size: int, params: dict | None = None) -> list[DataFrame]:
        """As execute_batch(), with one transaction for each so many statements; an error takes back its group alone."""
        if size < 1:
            raise GraphError("a group has one statement at least")
        statements, out = split_batch(text), []
        for i in range(0, len(statements), size):
            self.begin()
            try:
                out += [self.cypher(s, params) for s in statements[i : i + size]]
            except Exception:
                if self._saved is not None:
                    self.rollback()
                raise
            self.commit()
        return out

    def introspect_schema(self) -> dict:
        """Labels and relationship types with the types of their properties, from the catalogue alone (no job runs)."""
        props = lambda t: {n: k for n, k in t.dtypes if not n.startswith("_")}
        labels: dict = {}
        for names, t in self.graph.nodes.items():
            for label in names:
                labels.setdefault(label, {}).update(props(t))
        ends = {k: {"from": sorted(a), "to": sorted(b)} for k, (a, b) in self.graph.ends.items()}
        rels = {k: {"properties": props(t), **ends.get(k, {"from": [], "to": []})} for k, t in self.graph.rels.items()}
        return {"labels": dict(sorted(labels.items())), "relationships": dict(sorted(rels.items())), "indexes": [{"label": a, "property": b, "unique": u} for (a, b), u in sorted(self.graph.indexes.items())]}

    def rows(self, text: str, params: dict | None = None) -> list:
        with runtime_errors():
            return self.cypher(text, params).collect()

    def query_arrow(self, text: str, params: dict | None = None):
        with runtime_errors():
            return self.cypher(text, params).toArrow()

    def execute_streaming(self, text: str, params: dict | None = None, sink: Callable | None = None) -> Iterator | int:
        """Rows one partition at a time; with a sink, each is given to it until it returns False, and their number comes back."""
        rows = self.cypher(text, params).toLocalIterator()
        if sink is None:
            return rows
        n = 0
        with runtime_errors():
            for row in rows:
                n += 1
                if sink(row) is False:
                    break
        return n

    # -- point reads and sizes
    def get_node(self, node_id: int) -> dict | None:
        """A node's id, labels and properties; the filter on the id reaches the scans."""
        return self._one(self.graph.nodes.values(), node_id)

    def get_relationship(self, rel_id: int) -> dict | None:
        return self._one(self.graph.rels.values(), rel_id)

    def node_exists(self, node_id: int) -> bool:
        return self.get_node(node_id) is not None

    def get_node_property(self, node_id: int, name: str):
        return (self.get_node(node_id) or {"properties": {}})["properties"].get(name)

    @staticmethod
    def _one(tables, wanted: int) -> dict | None:
        for t in tables:
            if row := t.where(F.col("_id") == wanted).first():
                d = row.asDict(True)
                meta = {k[1:]: v for k, v in d.items() if k.startswith("_")}
                return meta | {"properties": {k: v for k, v in d.items() if not k.startswith("_") and v is not None}}
        return None

    def node_count(self, label: str | None = None) -> int:
        return sum(self._size(t) for _, t in self.graph.node_tables([label] if label else []))

    def relationship_count(self, kind: str | None = None) -> int:
        return sum(self._size(t) for _, t in self.graph.rel_tables([kind] if kind else []))

    def _size(self, t: DataFrame) -> int:
        """Tables don't change, so that each is counted once."""
        if id(t) not in self._sizes:
            self._sizes[id(t)] = (t, t.count())
        return self._sizes[id(t)][1]

    def cancel(self) -> None:
        self.spark.interruptTag("graphloom")

    @staticmethod
    def _writes(q: Query) -> bool:
        return any(c.kind in WRITES for p in q.parts for c in p)

    def _none(self) -> DataFrame:
        return self.spark.range(0).select()

    def _explain(self, c: Compiler, q: Query) -> DataFrame:
        """Steps clause by clause, and Spark's plan; of a writing statement, the plan of what is read before its first write."""
        if not self._writes(q):
            df = c.query(q)
            text = "\n".join(c.notes) + "\n" + self._plan(df)
        else:
            c.uses.query(q)
            text = ""
            for part in q.parts:
                frame, wrote = c.unit(), False
                for clause in part:
                    wrote = wrote or clause.kind in WRITES
                    if wrote:
                        c.notes.append(f"{'Write' if clause.kind in WRITES else 'Read'}({clause.kind}: {', '.join(sorted(Uses().query(Query([[clause]])).keys() - {'*'})) or '-'})")
                    else:
                        frame = getattr(c, f"do_{clause.kind}")(frame, clause.body)
                text += "\n".join(c.notes) + "\n" + self._plan(frame.df)
                c.notes.clear()
        return self.spark.createDataFrame([(text,)], "plan string")

    def _plan(self, df: DataFrame) -> str:
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _limited(self, df: DataFrame, max_rows: int | None, timeout: float | None) -> DataFrame:
        import threading

        from .operators.iterate import cut

        late = threading.Event()
        timer = threading.Timer(timeout, lambda: (late.set(), self.spark.interruptTag("graphloom"))) if timeout is not None else None
        self.spark.addTag("graphloom")
        if timer:
            timer.start()
        try:
            out = cut(df if max_rows is None else df.limit(max_rows + 1))
            if max_rows is not None and out.count() > max_rows:
                raise ResourceLimit(f"more than {max_rows} rows")
            return out
        except ResourceLimit:
            raise
        except Exception as e:
            if late.is_set():
                raise QueryTimeout(f"longer than {timeout} s") from None
            if "cancel" in str(e).lower():
                raise Cancelled("the query was cancelled") from None
            raise
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag("graphloom")
