"""From syntax tree to DataFrames, clause by clause.

A frame is a DataFrame with one column per variable.  A node or relationship
is a struct that holds its ids and only the properties that the query reads.
Nothing runs until the result is used, but for writes and unbounded paths.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError, MissingParameter, ResourceLimit, SemanticError, UnboundVariable
from ..functions import operators as op
from ..functions import scalar
from ..functions.values import NULL, PATH, E, common, kind_of, lit, make_list, make_map, mixed_string, sort_key, to
from ..sources.graph import Graph, _union
from .syntax import Clause, NodePattern, PathPattern, Projection, Query, RelPattern, X, _Held

ALL = None
MAX_HOPS = 30
#: Different argument lists that a procedure may be called with in one clause.
MAX_CALLS = 1000
OUTPUTS = {"INTEGER": "long", "FLOAT": "double", "BOOLEAN": "boolean", "STRING": "string"}

#: The place of a row in the order that a WITH gave.
SEQUENCE = "_sequence"


class Uses(dict):
    """variable -> names of the fields read, or ALL."""

    def add(self, var: str, name: str | None) -> None:
        if name is ALL:
            self[var] = ALL
        elif self.get(var, ()) is not ALL:
            self.setdefault(var, set()).add(name)

    def expr(self, a) -> None:
        if isinstance(a, tuple):
            for b in a:
                self.expr(b)
        elif isinstance(a, _Held):
            self.query(a.query)
        elif isinstance(a, PathPattern):
            self.pattern(a)
        elif isinstance(a, X):
            base = a.args[0] if a.args else None
            is_var = isinstance(base, X) and base.op == "var"
            if a.op == "var":
                self.add(a.args[0], ALL)
            elif a.op == "prop" and is_var:
                self.add(base.args[0], a.args[1])
            elif a.op == "haslabels" and is_var:
                self.add(base.args[0], "_labels")
            elif a.op in ("isnull", "notnull") and is_var:
                self.add(base.args[0], "_id")
            elif a.op == "call" and a.args[0] in ("id", "labels", "type", "startnode", "endnode") and len(a.args[1]) == 1 and a.args[1][0].op == "var":
                self.add(a.args[1][0].args[0], {"labels": "_labels"}.get(a.args[0], "_id"))
            elif a.op == "agg" and a.args[0] == "count" and a.args[2] and a.args[2][0].op == "var":
                self.add(a.args[2][0].args[0], "_id")
            elif a.op == "cmp" and a.args[0] in ("=", "<>"):
                for b in a.args[1:]:
                    if b.op == "var":
                        self.add(b.args[0], "_whole")
                    else:
                        self.expr(b)
            else:
                self.expr(a.args)

    def pattern(self, p: PathPattern) -> None:
        for part in (*p.nodes, *p.rels):
            for _, e in part.props:
                self.expr(e)
            if part.var and part.props:
                for k, _ in part.props:
                    self.add(part.var, k)
        for n in p.nodes:
            if n.var and n.labels:
                self.add(n.var, "_labels?")

    def query(self, q: Query) -> "Uses":
        for part in q.parts:
            for c in part:
                self.clause(c)
        return self

    def clause(self, c: Clause) -> None:
        if c.kind in ("match", "optional"):
            for p in c.body[0]:
                self.pattern(p)
            self.expr(c.body[1] or ())
        elif c.kind in ("with", "return"):
            p: Projection = c.body
            for it in p.items:
                if c.kind == "with" and it.expr.op == "var" and it.name == it.expr.args[0]:
                    self.setdefault(it.name, set()) if self.get(it.name, ()) is not ALL else None
                else:
                    self.expr(it.expr)
            if p.star and c.kind == "return":
                self.add("*", ALL)
            for e in (*[o for o, _ in p.order], p.skip, p.limit, p.where):
                self.expr(e or ())
        elif c.kind == "unwind":
            self.expr(c.body[0])
        elif c.kind == "call":
            self.expr(c.body[1] or ())
            self.expr(c.body[3] or ())
        elif c.kind == "create":
            for p in c.body:
                self.pattern(p)
        elif c.kind in ("set", "remove", "merge", "delete"):
            self.add("*", ALL)

    def of(self, var: str | None) -> set | None:
        if "*" in self:
            return ALL
        return self.get(var, set()) if var else set()


@dataclass
class Frame:
    df: DataFrame
    vars: dict[str, E] = field(default_factory=dict)

    def var(self, name: str, t: T.DataType, kind: str) -> E:
        return E(F.col(f"`{name}`"), t, kind)

    def bind(self, df: DataFrame, **new: tuple[T.DataType, str]) -> "Frame":
        out = dict(self.vars)
        for n, (t, kind) in new.items():
            out[n] = self.var(n, t, kind)
        return Frame(df, out)


def fields_of(df: DataFrame, meta: tuple[str, ...], used: set | None) -> list[str]:
    return [c for c in df.columns if c in meta or (not c.startswith("_") and (used is ALL or c in used))]


class Compiler:
    def __init__(self, graph: Graph, params: dict | None = None, procedures: dict | None = None, instant: dt.datetime | None = None):
        self.graph, self.params, self.procedures = graph, params or {}, procedures or {}
        self.instant = instant or dt.datetime.now(dt.timezone.utc)
        self.uses = Uses()
        self.count = 0
        self.notes: list[str] = []

    def fresh(self, what: str = "v") -> str:
        self.count += 1
        return f"_{what}{self.count}"

    # -- queries
    def unit(self) -> Frame:
        return Frame(self.graph.spark.range(1).select(F.lit(True).alias("_unit")))

    def query(self, q: Query) -> DataFrame:
        self.uses.query(q)
        frames = [self.part(p, self.unit()) for p in q.parts]
        names = frames[0].columns
        if any(f.columns != names for f in frames):
            raise SemanticError("the parts of a UNION need the same column names")
        out = _union(frames) if len(frames) > 1 else frames[0]
        return out if not q.union_all or q.union_all[0] else out.distinct()

    #: How many rows one row of the frame stands for, while only count(*) asks.
    times: Column | None = None
    #: Whether this is the last clause: nothing reads the rows that a write leaves.
    ending = False

    def part(self, clauses: list[Clause], frame: Frame) -> DataFrame:
        if counted := self.degrees(clauses):
            frame, self.times = counted, F.col("_times")
            frame = self.do_return(frame, clauses[1].body)
            self.times = None
            return frame.df
        for c in clauses:
            self.ending = c is clauses[-1]
            frame = getattr(self, f"do_{c.kind}")(frame, c.body)
        if clauses[-1].kind == "call" and not clauses[-1].body[2]:
            return frame.df.drop("_unit")
        return frame.df if clauses[-1].kind in ("return", "call") else frame.df.limit(0).select()

    def degrees(self, clauses: list[Clause]) -> Frame | None:
        """MATCH (a)-[]-(p)-[]-(b) RETURN …, count(*): nothing is asked of the ends, so each p has its numbers of
        relationships, and the pairs are their product, less those of a relationship with itself.  No pair is made."""
        if [c.kind for c in clauses] != ["match", "return"] or len(clauses[0].body[0]) != 1 or clauses[0].body[1] is not None:
            return None
        pattern, back = clauses[0].body[0][0], clauses[1].body
        if len(pattern.rels) != 2 or pattern.var or pattern.shortest or back.star or back.distinct or len({n.var for n in pattern.nodes if n.var}) < sum(n.var is not None for n in pattern.nodes):
            return None
        (a, p, b), (r, t) = pattern.nodes, pattern.rels
        p = p if p.var else NodePattern(self.fresh("n"), p.labels, p.props)
        whole = [e for it in back.items for e in it.expr.walk()] + [e for o, _ in back.order for e in o.walk()]
        aggs = [e for e in whole if e.op == "agg"]
        named = {e.args[0] for e in whole if e.op == "var"} - {it.name for it in back.items}
        if not aggs or any(e.args[0] != "count" or e.args[2] for e in aggs) or named - {p.var} or any(e.op in ("pattern", "exists", "existsq", "patcomp") for e in whole):
            return None
        if any(h.hops or h.props or h.way == "both" or not h.types for h in (r, t)):
            return None
        towards = [r.way == "out", t.way == "in"]  # into p
        if set(r.types) & set(t.types) and (towards[0] != towards[1] or set(r.types) != set(t.types)):
            return None
        for n, h, into in ((a, r, towards[0]), (b, t, towards[1])):
            if not self.unasked(n) or not set(n.labels) <= self.sure_labels(h.types, "out", not into):
                return None
        key = self.fresh("mid")

        def degree(h: RelPattern, into: bool, name: str) -> DataFrame:
            tables = [x.select(F.col("_dst" if into else "_src").alias(key)) for _, x in self.graph.rel_tables(h.types)] or [self.empty_rels().select(F.col("_src").alias(key))]
            return reduce(lambda x, y: x.unionAll(y), tables).groupBy(key).agg(F.count(F.lit(1)).alias(name))

        if set(r.types) == set(t.types):
            df = degree(r, towards[0], "_n").where("_n > 1").select(key, (F.col("_n") * (F.col("_n") - 1)).alias("_times"))
        else:
            df = degree(r, towards[0], "_n").join(degree(t, towards[1], "_m"), key).select(key, (F.col("_n") * F.col("_m")).alias("_times"))
        self.notes.append(f"Degrees({p.var})")
        frame = self.target(Frame(df), df, key, p, r.types, r.way)
        return frame

    # -- patterns
    def do_match(self, frame: Frame, body) -> Frame:
        patterns, where = body
        return self.filter(self.match(frame, patterns), where)

    def one_hop(self, frame: Frame, patterns, where) -> tuple[str, PathPattern] | None:
        """The bound node and the pattern with a fresh name in its place, if a pattern is one hop from a bound node
        of which it asks nothing, to new ones, and the condition is about new ones only: no keys of outer rows are needed."""
        if len(patterns) != 1 or patterns[0].var or patterns[0].shortest or len(patterns[0].rels) != 1:
            return None
        p = patterns[0]
        (a, b), (r,) = p.nodes, p.rels
        bound = [n.var in frame.vars if n.var else False for n in (a, b)]
        if sum(bound) != 1 or r.hops or r.var in frame.vars or a.var == b.var:
            return None
        here = a if bound[0] else b
        if here.labels or here.props or frame.vars[here.var].kind != "node":
            return None
        asked = set(self.mentioned(where)) if where is not None else set()
        for part in (a, b, r):
            for _, e in part.props:
                asked |= {x.args[0] for x in e.walk() if x.op == "var"}
        if asked & set(frame.vars):
            return None
        fresh = NodePattern(self.fresh("n"))
        return here.var, PathPattern(None, (fresh, b) if bound[0] else (a, fresh), p.rels)

    def do_optional(self, frame: Frame, body) -> Frame:
        patterns, where = body
        if plain_ := self.one_hop(frame, patterns, where):
            var, pattern = plain_
            at = pattern.nodes[0].var if pattern.nodes[0].var.startswith("_") else pattern.nodes[1].var
            inner = self.filter(self.match(self.unit(), [pattern]), where)
            new, key = [v for v in inner.vars if not v.startswith("_")], self.fresh("k")
            right = inner.df.select(F.col(f"`{at}`")["_id"].alias(key), *[F.col(f"`{v}`") for v in new])
            df = frame.df.join(right, F.col(f"`{var}`")["_id"] == F.col(key), "left_outer").drop(key)
            self.notes.append(f"OptionalMatch({', '.join(new)}), a plain left join")
            return frame.bind(df, **{v: (inner.vars[v].t, inner.vars[v].kind) for v in new})
        known = self.correlated(frame, patterns, where)
        seeds, keys = self.seeds(frame, known)
        inner = self.filter(self.match(seeds, patterns), where)
        new = [v for v in inner.vars if v not in frame.vars]
        named = [self.fresh("k") for _ in keys]
        right = inner.df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], *[F.col(f"`{v}`") for v in new])
        left, own = self.with_keys(frame, known)
        df = left.join(right, self.all_equal(own, named), "left_outer").drop(*own, *named)
        self.notes.append(f"OptionalMatch({', '.join(new)})")
        return frame.bind(df, **{v: (inner.vars[v].t, inner.vars[v].kind) for v in new})

    @staticmethod
    def all_equal(a: list[str], b: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))

    def correlated(self, frame: Frame, patterns, where) -> list[str]:
        names = {p.var for p in patterns if p.var}
        for p in patterns:
            names |= {x.var for x in (*p.nodes, *p.rels) if x.var}
            for part in (*p.nodes, *p.rels):
                for _, e in part.props:
                    names |= {x.args[0] for x in e.walk() if x.op == "var"}
        names |= self.mentioned(where)
        return [v for v in frame.vars if v in names]

    def mentioned(self, e) -> set[str]:
        out = set()
        for x in e.walk() if isinstance(e, X) else ():
            if x.op == "var":
                out.add(x.args[0])
            for a in x.args:
                for p in a if isinstance(a, tuple) else (a,):
                    if isinstance(p, PathPattern):
                        out |= {y.var for y in (*p.nodes, *p.rels) if y.var}
                    if isinstance(p, _Held):
                        u = Uses().query(p.query)
                        out |= set(u) | {y.var for c in p.query.parts[0] if c.kind in ("match", "optional") for q in c.body[0] for y in (*q.nodes, *q.rels) if y.var}
        return out

    def key_of(self, e: E) -> Column:
        return e.col["_id"] if e.kind in ("node", "rel") else e.col

    def with_keys(self, frame: Frame, known: list[str]) -> tuple[DataFrame, list[str]]:
        keys = [self.fresh("k") for _ in known]
        return frame.df.withColumns({k: self.key_of(frame.vars[v]) for k, v in zip(keys, known, strict=True)}) if keys else frame.df, keys

    def seeds(self, frame: Frame, known: list[str]) -> tuple[Frame, list[str]]:
        """The distinct values of some variables, and columns that identify them."""
        df, keys = self.with_keys(frame, known)
        if not keys:
            return self.unit(), []
        out = df.select(*[F.col(f"`{v}`") for v in known], *keys).dropDuplicates(keys)
        return Frame(out, {v: frame.vars[v] for v in known}), keys

    def match(self, frame: Frame, patterns: list[PathPattern]) -> Frame:
        rels: list[tuple[str, tuple, bool]] = []  # of this clause: name, types, whether it is a list
        patterns = list(patterns)
        self.check_kinds(frame, patterns)
        while patterns:
            # patterns that touch what is bound come first, so that no product is made without need
            at = next((i for i, p in enumerate(patterns) if any(x.var in frame.vars for x in (*p.nodes, *p.rels) if x.var)), 0)
            frame = self.match_path(frame, patterns.pop(at), rels)
        return frame

    @staticmethod
    def check_kinds(frame: Frame, patterns: list[PathPattern]) -> None:
        """A name stands for a node, a relationship (or a list of them), or a path, here and where it was bound."""
        seen = {v: e.kind for v, e in frame.vars.items() if e.kind in ("node", "rel", "path")}
        hops = [r.var for p in patterns for r in p.rels if r.var]
        if len(set(hops)) < len(hops):
            raise SemanticError("a relationship's name can stand in one pattern of a MATCH only")
        for p in patterns:
            own = [(n.var, "node") for n in p.nodes] + [(r.var, "rel") for r in p.rels] + [(p.var, "path")]
            for name, kind in own:
                if name and seen.setdefault(name, kind) != kind:
                    raise SemanticError(f"{name} can't be a {seen[name]} and a {kind}")

    def match_path(self, frame: Frame, p: PathPattern, rels: list) -> Frame:
        nodes = [n if n.var else NodePattern(self.fresh("n"), n.labels, n.props) for n in p.nodes]
        hops = [r if r.var else RelPattern(self.fresh("r"), r.types, r.props, r.way, r.hops) for r in p.rels]
        if p.shortest:
            return self.shortest(frame, p, nodes, hops[0])
        flip = {"out": "in", "in": "out", "both": "both"}
        order = list(range(len(hops)))
        start = next((i for i, n in enumerate(nodes) if n.var in frame.vars), None)
        known = next((i for i, h in enumerate(hops) if h.var in frame.vars), None) if start is None else None
        if known is not None:
            start = known
        elif start is None:
            # begin at the most selective node: properties, then labels; between the ends only for its properties
            rank = lambda i: (len(nodes[i].props) > 0, len(nodes[i].labels) > 0 and i in (0, len(nodes) - 1))
            start = max(range(len(nodes)), key=rank) if all(h.hops is None for h in hops) else 0
        # hops to the right of the start, then those to the left, backwards
        steps = [(i, i, i + 1, False) for i in order[start:]] + [(i, i + 1, i, True) for i in reversed(order[:start])]
        started = None
        if steps and not p.var:
            i, a, b, back = steps[0]
            h = hops[i]
            started = self.rel_start(frame, nodes[a], RelPattern(h.var, h.types, h.props, flip[h.way] if back else h.way, h.hops), nodes[b], rels)
        if started:
            frame, steps = started, steps[1:]
        elif known is not None:
            frame = self.start_of(frame, nodes[start], hops[known], flip[hops[known].way])
        else:
            frame = self.anchor(frame, nodes[start])
        for i, a, b, back in steps:
            h = hops[i]
            h = RelPattern(h.var, h.types, h.props, flip[h.way] if back else h.way, h.hops)
            frame = self.var_expand(frame, nodes[a], h, nodes[b], rels, back) if h.hops else self.expand(frame, nodes[a], h, nodes[b], rels)
        if p.var:
            ids = F.array(F.col(f"`{nodes[0].var}`")["_id"])
            edges = F.array().cast("array<bigint>")
            for h, n in zip(hops, nodes[1:], strict=True):
                if h.hops:
                    ids = F.concat(ids, F.slice(F.col(f"`{h.var}_nodes`"), F.lit(2), F.size(f"`{h.var}_nodes`")))
                    edges = F.concat(edges, F.transform(F.col(f"`{h.var}`"), lambda r: r["_id"]))
                else:
                    ids = F.concat(ids, F.array(F.col(f"`{n.var}`")["_id"]))
                    edges = F.concat(edges, F.array(F.col(f"`{h.var}`")["_id"]))
            path = F.struct(ids.alias("nodes"), edges.alias("rels"))
            frame = frame.bind(frame.df.withColumn(p.var, path), **{p.var: (PATH, "path")})
        return frame

    def node_scan(self, n: NodePattern) -> tuple[DataFrame, list[str]]:
        tables = self.graph.node_tables(n.labels)
        used = self.uses.of(n.var)
        if used is not ALL:
            used = used | {k for k, _ in n.props}
        if not tables:
            empty = self.graph.spark.createDataFrame([], "_id long, _labels array<string>")
            return empty, ["_id", "_labels"]
        want = lambda t: fields_of(t, ("_id", "_labels") if used is ALL or used & {"_labels"} else ("_id",), used)
        df = _union([t.select(*want(t)) for _, t in tables])
        return df, df.columns

    def anchor(self, frame: Frame, n: NodePattern) -> Frame:
        if n.var in frame.vars:
            if frame.vars[n.var].kind != "node":
                raise SemanticError(f"{n.var} is not a node")
            return self.node_filter(frame, n, True)
        df, cols = self.node_scan(n)
        self.notes.append(f"NodeScan({n.var}{''.join(':' + x for x in n.labels)})")
        side = df.select(F.struct(*cols).alias(n.var))
        out = side.withColumn("_unit", F.lit(True)) if not frame.vars and "_unit" in frame.df.columns else frame.df.crossJoin(side)
        frame = frame.bind(out, **{n.var: (side.schema[n.var].dataType, "node")})
        return self.node_filter(frame, n, False)

    def start_of(self, frame: Frame, n: NodePattern, r: RelPattern, back: str) -> Frame:
        """The node where a bound relationship, or a bound list of them, begins: looked up by the id that stands there,
        so that rows aren't multiplied with all nodes.  Only an empty list may begin anywhere.  back: against r's way."""
        self.notes.append(f"StartOf({r.var}, {n.var})")
        start, c = self.fresh("start"), F.col(f"`{r.var}`")
        first = F.get(c, F.lit(0)) if r.hops else c
        ends = {"out": ["_src"], "in": ["_dst"], "both": ["_src", "_dst"]}[r.way]
        ids = F.array_distinct(F.array(*[first[x] for x in ends]))
        df = frame.df.withColumn(start, first[ends[0]]) if len(ends) == 1 else frame.df.select("*", F.explode(ids).alias(start))
        out = self.target(frame, df.where(F.col(start).isNotNull()), start, n, r.types, back)
        if not r.hops or r.hops[0] > 0:
            return out
        anywhere = self.anchor(Frame(frame.df.where(F.size(c) == 0), frame.vars), n)
        return Frame(out.df.unionByName(anywhere.df), out.vars)

    def sure_labels(self, types: tuple, way: str, end: bool) -> set:
        """Labels that every node at the start or the end of a hop has."""
        if not types or way == "both" or not all(t in self.graph.ends for t in types):
            return set()
        return set.intersection(*[set(self.graph.ends[t][int((way == "out") == end)]) for t in types])

    def unasked(self, n: NodePattern) -> bool:
        used = self.uses.of(n.var)
        return used is not ALL and not used - {"_id", "_whole", "_labels?"} and not n.props

    def rel_start(self, frame: Frame, a: NodePattern, r: RelPattern, b: NodePattern, rels: list) -> Frame | None:
        """A first hop from a node of which nothing is asked: the relationships alone, without a join."""
        variable = any(y.op == "var" for _, x in r.props for y in x.walk())
        if frame.vars or r.hops or variable or a.var == b.var or not self.unasked(a) or not set(a.labels) <= self.sure_labels(r.types, r.way, False):
            return None
        self.notes.append(f"RelScan({a.var})-{r.way}[{r.var}:{'|'.join(r.types)}]")
        side, _ = self.rel_filter(self.directed(r), frame, r)
        to = self.fresh("to")
        keep = [c for c in frame.df.columns if c not in ("_unit",)]
        df = side.select(F.struct(F.col("_from").alias("_id")).alias(a.var), F.col("_to").alias(to), F.col("_rel").alias(r.var), F.lit(True).alias("_unit"))
        if keep:
            return None
        out = frame.bind(df, **{a.var: (T.StructType([T.StructField("_id", T.LongType())]), "node"), r.var: (df.schema[r.var].dataType, "rel")})
        rels.append((r.var, r.types, False))
        return self.target(out, df, to, b, r.types, r.way)

    def node_filter(self, frame: Frame, n: NodePattern, labels: bool) -> Frame:
        e = frame.vars[n.var]
        if labels and n.labels:
            if "_labels" in e.t.names:
                frame = Frame(frame.df.where(self.has_labels(e, n.labels)), frame.vars)
            else:  # only the id was kept: a semi join with the nodes that have the labels
                key = self.fresh("id")
                ids = _union([t.select(F.col("_id").alias(key)) for _, t in self.graph.node_tables(n.labels)] or [self.empty_rels().select(F.col("_id").alias(key))])
                frame = Frame(frame.df.join(ids, e.col["_id"] == F.col(key), "left_semi"), frame.vars)
        return self.prop_filter(frame, e, n.props)

    def prop_filter(self, frame: Frame, e: E, props) -> Frame:
        for k, x in props:
            value = self.ex(x, frame.vars)
            own = op.prop(e, k)
            frame = Frame(frame.df.where(op.equal(own, value)), frame.vars)
        return frame

    def has_labels(self, e: E, labels) -> Column:
        if e.kind == "rel":
            return reduce(lambda a, b: a & b, [e.col["_type"] == x for x in labels])
        if "_labels" not in e.t.names:
            found = {x for k, _ in self.graph.node_tables(labels) for x in k}
            if not found:
                return F.when(e.col.isNotNull(), F.lit(False))
            raise SemanticError("labels of this node weren't kept")
        return reduce(lambda a, b: a & b, [F.array_contains(e.col["_labels"], x) for x in labels])

    def rel_scan(self, r: RelPattern, meta=("_id", "_src", "_dst", "_type")) -> DataFrame | None:
        used = self.uses.of(r.var)
        tables = self.graph.rel_tables(r.types)
        if not tables:
            return None
        if used is not ALL:
            used = set(used) | {k for k, _ in r.props}
        df = _union([t.select(*fields_of(t, meta, used)) for _, t in tables])
        return df

    def empty_rels(self) -> DataFrame:
        return self.graph.spark.createDataFrame([], "_id long, _src long, _dst long, _type string")

    def directed(self, r: RelPattern) -> DataFrame:
        """_from, _to and the relationship as struct _rel, for a hop in either direction."""
        df = self.rel_scan(r)
        if df is None:
            df = self.empty_rels()
        rel = F.struct(*df.columns).alias("_rel")
        out = df.select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"), rel)
        into = df.select(F.col("_dst").alias("_from"), F.col("_src").alias("_to"), rel)
        return out if r.way == "out" else into if r.way == "in" else out.unionAll(into.where("_from <> _to"))

    def rel_filter(self, df: DataFrame, frame: Frame, r: RelPattern, where: str = "_rel") -> tuple[DataFrame, list]:
        """Literal properties are compared in the scan; the rest is left for after the join."""
        t = df.schema[where].dataType
        rest = []
        for k, x in r.props:
            if any(y.op in ("var", "pattern", "patcomp", "exists", "existsq") for y in x.walk()):
                rest.append((k, x))
            else:
                df = df.where(op.equal(op.prop(E(F.col(where), t, "rel"), k), self.ex(x, {})))
        return df, rest

    def distinct_from(self, frame: Frame, own: Column, types: tuple, rels: list, many: bool) -> Column | None:
        """Relationships of one clause differ; not asked where their types can't be equal."""
        cond = None
        for name, other, is_list in rels:
            if types and other and not set(types) & set(other):
                continue
            c = F.col(f"`{name}`")
            if is_list:
                ids = F.transform(c, lambda r: r["_id"])
                one = ~F.arrays_overlap(ids, own) if many else ~F.array_contains(ids, own)
            else:
                one = ~F.array_contains(own, c["_id"]) if many else c["_id"] != own
            cond = one if cond is None else cond & one
        return cond

    def target(self, frame: Frame, df: DataFrame, to: str, n: NodePattern, types: tuple, way: str) -> Frame:
        """Joins the node at the end of a hop, unless it is bound or nothing is asked of it."""
        if n.var in frame.vars:
            out = Frame(df.where(F.col(to) == F.col(f"`{n.var}`")["_id"]).drop(to), frame.vars)
            return self.node_filter(out, n, True)
        if self.unasked(n) and set(n.labels) <= self.sure_labels(types, way, True):
            self.notes.append(f"no join for ({n.var})")
            out = df.withColumn(n.var, F.struct(F.col(to).alias("_id"))).drop(to)
            return frame.bind(out, **{n.var: (T.StructType([T.StructField("_id", T.LongType())]), "node")})
        side, cols = self.node_scan(n)
        key = self.fresh("id")
        side = side.select(F.col("_id").alias(key), F.struct(*cols).alias(n.var))
        kind = side.schema[n.var].dataType
        # literal properties of the node are compared before the join
        later = []
        for k, x in n.props:
            if any(y.op == "var" for y in x.walk()):
                later.append((k, x))
            else:
                side = side.where(op.equal(op.prop(E(F.col(f"`{n.var}`"), kind, "node"), k), self.ex(x, {})))
        out = frame.bind(df.join(side, F.col(to) == F.col(key)).drop(to, key), **{n.var: (kind, "node")})
        return self.prop_filter(out, out.vars[n.var], later)

    def expand(self, frame: Frame, a: NodePattern, r: RelPattern, b: NodePattern, rels: list) -> Frame:
        self.notes.append(f"Expand({a.var})-{r.way}[{r.var}:{'|'.join(r.types)}]-({b.var})")
        start, to = self.fresh("from"), self.fresh("to")
        if r.var in frame.vars:
            # a bound relationship is checked, not looked for
            c = F.col(f"`{r.var}`")
            here = F.col(f"`{a.var}`")["_id"]
            ends = {"out": [("_src", "_dst")], "in": [("_dst", "_src")], "both": [("_src", "_dst"), ("_dst", "_src")]}[r.way]
            parts = [frame.df.where(c[x] == here).withColumn(to, c[y]) for x, y in ends]
            if len(parts) == 2:
                parts[1] = parts[1].where(c["_src"] != c["_dst"])
            df = reduce(lambda x, y: x.unionAll(y), parts)
            if r.types:
                df = df.where(c["_type"].isin(*r.types))
            return self.target(frame, df, to, b, r.types, r.way)
        side, rest = self.rel_filter(self.directed(r), frame, r)
        side = side.select(F.col("_from").alias(start), F.col("_to").alias(to), F.col("_rel").alias(r.var))
        df = frame.df.join(side, F.col(f"`{a.var}`")["_id"] == F.col(start)).drop(start)
        frame = frame.bind(df, **{r.var: (side.schema[r.var].dataType, "rel")})
        cond = self.distinct_from(frame, F.col(f"`{r.var}`")["_id"], r.types, rels, False)
        frame = Frame(df.where(cond) if cond is not None else df, frame.vars)
        rels.append((r.var, r.types, False))
        frame = self.prop_filter(frame, frame.vars[r.var], rest)
        return self.target(frame, frame.df, to, b, r.types, r.way)

    def var_expand(self, frame: Frame, a: NodePattern, r: RelPattern, b: NodePattern, rels: list, back: bool) -> Frame:
        """Trails of lo..hi relationships: joins hop by hop, each adding one relationship that the trail doesn't have.

        Without an upper bound the loop goes on while there are trails, each
        round written to the shared folder; beyond MAX_HOPS it is an error.
        """
        from ..operators.iterate import cut

        lo, hi = r.hops
        to = self.fresh("to")
        side, rest = self.rel_filter(self.directed(r), frame, r)
        if r.var in frame.vars:
            return self.match_list(frame, a, r, b)
        self.notes.append(f"VarExpand({a.var})-{r.way}[{r.var}:{'|'.join(r.types)}*{lo}..{'' if hi is None else hi}]-({b.var})")
        kind = T.ArrayType(side.schema["_rel"].dataType)
        trail, seen = r.var, f"{r.var}_nodes"
        here = F.col(f"`{a.var}`")["_id"]
        level = frame.df.withColumns({trail: F.array().cast(kind), seen: F.array(here)})
        found = [level] if lo == 0 else []
        hop = side.select(F.col("_from").alias("_f"), F.col("_to").alias("_t"), F.col("_rel").alias("_r"))
        each = E(F.col("_r"), kind.elementType, "rel")
        # properties that follow from the row hold for every relationship of its path
        asked = reduce(lambda x, y: x & y, [op.equal(op.prop(each, k), self.ex(x, frame.vars)) for k, x in rest], F.lit(True))
        depth = 0
        while hi is None or depth < hi:
            depth += 1
            last = F.element_at(F.col(f"`{seen}`"), -1)
            step = level.join(hop, last == F.col("_f")).where(~F.exists(F.col(f"`{trail}`"), lambda x: x["_id"] == F.col("_r")["_id"]))
            step = step.where(asked) if rest else step
            level = step.withColumns({trail: F.array_append(F.col(f"`{trail}`"), F.col("_r")), seen: F.array_append(F.col(f"`{seen}`"), F.col("_t"))}).drop("_f", "_t", "_r")
            if hi is None or depth % 6 == 0:
                level = cut(level)
                if hi is None and level.isEmpty():
                    break
                if hi is None and depth > MAX_HOPS:
                    raise SemanticError(f"a path without an upper bound is longer than {MAX_HOPS} relationships")
            if depth >= lo:
                found.append(level)
        df = reduce(lambda x, y: x.unionByName(y), found) if found else level.limit(0)
        df = df.withColumn(to, F.element_at(F.col(f"`{seen}`"), -1))
        frame = frame.bind(df, **{trail: (kind, "value")})
        cond = self.distinct_from(frame, F.transform(F.col(f"`{trail}`"), lambda x: x["_id"]), r.types, rels, True)
        if cond is not None:
            df = df.where(cond)
        rels.append((trail, r.types, True))
        if back:
            df = df.withColumns({trail: F.reverse(F.col(f"`{trail}`")), seen: F.reverse(F.col(f"`{seen}`"))})
        return self.target(frame, df, to, b, r.types if lo else (), r.way)

    def match_list(self, frame: Frame, a: NodePattern, r: RelPattern, b: NodePattern) -> Frame:
        """A bound list of relationships is followed from a; the row stays if it is a chain."""
        to = self.fresh("to")
        c = F.col(f"`{r.var}`")

        def step(at: Column, e: Column) -> Column:
            out = F.when(e["_src"] == at, e["_dst"])
            into = F.when(e["_dst"] == at, e["_src"])
            return out if r.way == "out" else into if r.way == "in" else F.coalesce(out, into)

        end = F.aggregate(c, F.col(f"`{a.var}`")["_id"], step)
        lo, hi = r.hops
        df = frame.df.withColumn(to, end).where(F.col(to).isNotNull() & (F.size(c) >= lo) & (F.lit(True) if hi is None else F.size(c) <= hi))
        df = df.withColumn(f"{r.var}_nodes", F.array(F.col(f"`{a.var}`")["_id"]))
        return self.target(frame, df, to, b, (), "both")

    def shortest(self, frame: Frame, p: PathPattern, nodes, r: RelPattern) -> Frame:
        from ..operators.iterate import shortest_paths

        a, b = nodes
        if a.var not in frame.vars or b.var not in frame.vars:
            frame = self.match(frame, [PathPattern(None, (n,), ()) for n in (a, b) if n.var not in frame.vars])
        lo, hi = r.hops or (1, 1)
        if lo > 1:
            raise SemanticError("shortestPath begins at 0 or 1")
        side, rest = self.rel_filter(self.directed(r), frame, r)
        if rest:
            raise SemanticError("properties of a shortest path's relationships must be constant")
        start, end, path = self.fresh("s"), self.fresh("e"), p.var or self.fresh("p")
        pairs = frame.df.select(F.col(f"`{a.var}`")["_id"].alias(start), F.col(f"`{b.var}`")["_id"].alias(end)).distinct()
        edges = side.select("_from", "_to", F.col("_rel")["_id"].alias("_edge"))
        found = shortest_paths(pairs, start, end, edges, lo, hi).withColumnRenamed("path", path)
        s2, e2 = self.fresh("s"), self.fresh("e")
        found = found.withColumnsRenamed({start: s2, end: e2})
        df = frame.df.join(found, (F.col(f"`{a.var}`")["_id"] == F.col(s2)) & (F.col(f"`{b.var}`")["_id"] == F.col(e2)), "left_outer").drop(s2, e2)
        self.notes.append(f"ShortestPath({a.var}, {b.var})")
        return frame.bind(df, **{path: (PATH, "path")})

    # -- filters and correlated patterns
    def filter(self, frame: Frame, where: X | None) -> Frame:
        if where is None:
            return frame
        for part in self.conjuncts(where):
            negated = part.op == "not"
            inner = part.args[0] if negated else part
            if inner.op in ("pattern", "exists") or inner.op == "existsq":
                frame = self.semi(frame, inner, negated)
            else:
                frame, part = self.lower(frame, part)
                e = self.ex(part, frame.vars)
                if e.family not in ("bool", "null"):
                    raise CypherTypeError(f"WHERE needs a boolean, not a {e.family}")
                frame = Frame(frame.df.where(e.col.cast("boolean")), frame.vars)
        return frame

    def conjuncts(self, e: X) -> list[X]:
        return [y for x in e.args for y in self.conjuncts(x)] if e.op == "and" else [e]

    def inner_rows(self, frame: Frame, e: X) -> tuple[DataFrame, list[str], list[str]]:
        """Distinct keys of the outer rows for which a subpattern has a match, their names and the variables."""
        if e.op == "existsq":
            clauses = e.args[0].query.parts[0]
            if any(c.kind in ("create", "merge", "set", "remove", "delete") for c in clauses):
                raise SemanticError("a subquery in exists can't write")
            known = [v for v in frame.vars if v in self.mentioned(e)]
            seeds, keys = self.seeds(frame, known)
            saved, self.outer_keys = getattr(self, "outer_keys", None), keys
            for c in clauses:
                if c.kind == "return":
                    break
                if c.kind == "with":
                    c = Clause("with", c.body)
                seeds = getattr(self, f"do_{c.kind}")(seeds, c.body)
            self.outer_keys = saved
            return seeds.df.select(*keys).distinct(), keys, known
        patterns, where = (e.args[0], e.args[1]) if e.op == "exists" else ((e.args[0],), None)
        known = self.correlated(frame, patterns, where)
        if e.op == "pattern":
            new = {x.var for p in patterns for x in (*p.nodes, *p.rels) if x.var} - set(frame.vars)
            if new:
                raise UnboundVariable(f"{', '.join(sorted(new))} can't be bound in a pattern predicate")
        seeds, keys = self.seeds(frame, known)
        return self.filter(self.match(seeds, list(patterns)), where).df.select(*keys).distinct(), keys, known

    def semi(self, frame: Frame, e: X, negated: bool) -> Frame:
        patterns, where = (e.args[0], e.args[1]) if e.op == "exists" else ((e.args[0],), None) if e.op == "pattern" else ((), None)
        named = e.op == "pattern" and any(x.var and x.var not in frame.vars for p in patterns for x in (*p.nodes, *p.rels))
        if not named and (plain_ := self.one_hop(frame, list(patterns), where)):
            var, pattern = plain_
            fresh = next(n for n in pattern.nodes if n.var and n.var.startswith("_"))
            inner, key = self.filter(self.match(self.unit(), [pattern]), where), self.fresh("k")
            right = inner.df.select(F.col(f"`{fresh.var}`")["_id"].alias(key))
            self.notes.append(("Anti" if negated else "Semi") + f"Join on ({var}), direct")
            return Frame(frame.df.join(right, F.col(f"`{var}`")["_id"] == F.col(key), "left_anti" if negated else "left_semi"), frame.vars)
        rows, keys, known = self.inner_rows(frame, e)
        left, own = self.with_keys(frame, known)
        rows = rows.withColumnsRenamed({k: f"{k}_i" for k in keys})
        joined = left.join(rows, self.all_equal(own, [f"{k}_i" for k in keys]), "left_anti" if negated else "left_semi")
        self.notes.append("AntiJoin" if negated else "SemiJoin")
        return Frame(joined.drop(*own), frame.vars)

    def lower(self, frame: Frame, e: X) -> tuple[Frame, X]:
        """Replaces patterns inside an expression by columns joined to the frame."""
        whole = ("nodes", "relationships", "startnode", "endnode")
        if not any(x.op in ("pattern", "exists", "existsq", "patcomp") or x.op == "call" and x.args[0] in whole for x in e.walk()):
            return frame, e
        if e.op == "call" and e.args[0] in whole and len(e.args[1]) == 1:
            frame, inner = self.lower(frame, e.args[1][0])
            if inner.op == "var" and inner.args[0] in frame.vars:
                v = frame.vars[inner.args[0]]
                if v.kind == "path" and e.args[0] in ("nodes", "relationships"):
                    return self.members(frame, inner.args[0], e.args[0])
                if v.kind == "rel" and e.args[0] in ("startnode", "endnode"):
                    return self.end_of(frame, v, e.args[0])
            return frame, X("call", (e.args[0], (inner,)))
        if e.op == "call" and e.args[0] in ("id", "size") and len(e.args[1]) == 1 and e.args[1][0].op == "call" and e.args[1][0].args[0] in whole:
            return frame, e  # ids are enough
        if e.op == "cmp" and any(a.op == "call" and a.args[0] in ("startnode", "endnode") for a in e.args[1:]):
            return frame, e
        if e.op == "call" and e.args[0] == "exists" and len(e.args[1]) == 1 and e.args[1][0].op == "pattern":
            return self.lower(frame, e.args[1][0])
        if e.op in ("pattern", "exists", "existsq"):
            rows, keys, known = self.inner_rows(frame, e)
            name = self.fresh("has")
            left, own = self.with_keys(frame, known)
            rows = rows.withColumnsRenamed({k: f"{k}_i" for k in keys}).withColumn(name, F.lit(True))
            df = left.join(rows, self.all_equal(own, [f"{k}_i" for k in keys]), "left_outer").drop(*own, *[f"{k}_i" for k in keys])
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
            return frame.bind(df, **{name: (T.BooleanType(), "value")}), X("var", (name,))
        if e.op == "patcomp":
            p, where, out = e.args
            known = [v for v in frame.vars if v in set(self.correlated(frame, [p], where)) | self.mentioned(out)]
            seeds, keys = self.seeds(frame, known)
            inner = self.filter(self.match(seeds, [p]), where)
            inner, out = self.lower(inner, out)
            value = self.ex(out, inner.vars)
            name = self.fresh("list")
            renamed = [F.col(k).alias(f"{k}_i") for k in keys]
            lists = inner.df.groupBy(*renamed).agg(F.collect_list(value.col).alias(name))
            left, own = self.with_keys(frame, known)
            df = left.join(lists, self.all_equal(own, [f"{k}_i" for k in keys]), "left_outer").drop(*own, *[f"{k}_i" for k in keys])
            t = T.ArrayType(value.t)
            df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(t)))
            return frame.bind(df, **{name: (t, "value")}), X("var", (name,))

        def sub(a):
            nonlocal frame
            if isinstance(a, X):
                frame, b = self.lower(frame, a)
                return b
            return tuple(sub(b) for b in a) if isinstance(a, tuple) else a

        out = X(e.op, tuple(sub(a) for a in e.args))
        return frame, out

    def everything(self, table: str, key: str) -> tuple[DataFrame, T.DataType, str]:
        """All nodes or relationships as (key, struct) with all their properties."""
        df = _union(list(getattr(self.graph, table).values()))
        name = self.fresh("whole")
        df = df.select(F.col("_id").alias(key), F.struct(*df.columns).alias(name))
        return df, df.schema[name].dataType, name

    def end_of(self, frame: Frame, rel: E, which: str) -> tuple[Frame, X]:
        key = self.fresh("id")
        side, kind, name = self.everything("nodes", key)
        df = frame.df.join(side, rel.col["_src" if which == "startnode" else "_dst"] == F.col(key), "left_outer").drop(key)
        return frame.bind(df, **{name: (kind, "node")}), X("var", (name,))

    def members(self, frame: Frame, path: str, which: str) -> tuple[Frame, X]:
        """The nodes or relationships of a path with their properties: distinct paths are taken apart, joined and put together."""
        field_, table = ("nodes", "nodes") if which == "nodes" else ("rels", "rels")
        key, p, pos = self.fresh("id"), self.fresh("p"), self.fresh("pos")
        side, kind, name = self.everything(table, key)
        parts = frame.df.select(F.col(f"`{path}`").alias(p)).distinct().select(p, F.posexplode(F.col(p)[field_]).alias(pos, "_member"))
        lists = parts.join(side, F.col("_member") == F.col(key)).groupBy(p).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("at"), F.col(name).alias("it")))).alias("_members"))
        out = self.fresh("list")
        lists = lists.select(F.col(p), F.transform("_members", lambda m: m["it"]).alias(out))
        df = frame.df.join(lists, F.col(f"`{path}`").eqNullSafe(F.col(p)), "left_outer").drop(p)
        t = T.ArrayType(kind)
        df = df.withColumn(out, F.when(F.col(f"`{path}`").isNotNull(), F.coalesce(F.col(out), F.array().cast(t))))
        return frame.bind(df, **{out: (t, "value")}), X("var", (out,))

    # -- projections
    def do_unwind(self, frame: Frame, body) -> Frame:
        e, name = body
        frame, e = self.lower(frame, e)
        v = self.ex(e, frame.vars)
        if v.family == "null":
            return frame.bind(frame.df.where(F.lit(False)).withColumn(name, F.lit(None)), **{name: (T.NullType(), "value")})
        if v.family != "list":
            raise CypherTypeError("UNWIND needs a list")
        item = v.t.elementType
        return frame.bind(frame.df.select("*", F.explode(v.col).alias(name)), **{name: (item, kind_of(item))})

    def do_return(self, frame: Frame, p: Projection) -> Frame:
        out = self.project(frame, p, True)
        return Frame(out.df.select(*[F.col(f"`{n}`") for n in self.columns(frame, p)]), out.vars)

    def columns(self, frame: Frame, p: Projection) -> list[str]:
        star = sorted(v for v in frame.vars if not v.startswith("_")) if p.star else []
        return [*star, *[it.name for it in p.items]]

    def do_with(self, frame: Frame, p: Projection) -> Frame:
        out = self.project(frame, p, False)
        return self.filter(out, p.where) if p.where else out

    def has_agg(self, e: X) -> bool:
        return any(x.op == "agg" for x in e.walk())

    def project(self, frame: Frame, p: Projection, last: bool) -> Frame:
        outer = [k for k in (getattr(self, "outer_keys", None) or []) if k in frame.df.columns]
        items = [(v, X("var", (v,))) for v in sorted(frame.vars) if not v.startswith("_")] if p.star else []
        items += [(it.name, it.expr) for it in p.items]
        if p.star and not items:
            raise SemanticError("there is nothing that * could stand for")
        lowered = []
        for n, e in items:
            frame, e = self.lower(frame, e)
            lowered.append((n, e))
        items = lowered
        order = []
        for e, down in p.order:
            frame, e = self.lower(frame, e)
            order.append((e, down))
        if any(self.has_agg(e) for _, e in items):
            out, sort = self.aggregate(frame, items, order, outer)
        else:
            if any(self.has_agg(e) for e, _ in order):
                raise SemanticError("ORDER BY can't aggregate what the projection doesn't")
            made = {n: self.ex(e, frame.vars) for n, e in items}
            sort, extra = [], {}
            for e, down in order:
                same = next((n for n, x in items if x == e), None)
                scope = dict(made) if p.distinct else {**frame.vars, **made}
                if same is None:
                    v = self.ex(e, scope)
                    same = self.fresh("o")
                    extra[same] = v
                sort.append((same, down))
            cols = [*outer, *[v.col.alias(n) for n, v in made.items()], *[v.col.alias(n) for n, v in extra.items()]]
            df = frame.df.select(*cols)
            if p.distinct:
                df = self.distinct(df, made, outer)
            out = Frame(df, {n: frame.var(n, v.t, v.kind) for n, v in made.items()})
        if sort:
            by = lambda n: sort_key(F.col(f"`{n}`"), out.df.schema[n].dataType)
            out = Frame(out.df.orderBy(*[by(n).desc_nulls_first() if down else by(n).asc_nulls_last() for n, down in sort]), out.vars)
        df = out.df
        if p.skip is not None:
            df = df.offset(self.amount(p.skip, "SKIP"))
        if p.limit is not None:
            df = df.limit(self.amount(p.limit, "LIMIT"))
        keep = [*outer, *out.vars]
        df = df.select(*[F.col(f"`{n}`") for n in keep])
        if sort and not last:  # partitions of a sorted frame are in order, and so are these numbers
            df = df.withColumn(SEQUENCE, F.monotonically_increasing_id())
        return Frame(df, out.vars)

    def distinct(self, df: DataFrame, made: dict[str, E], outer: list[str]) -> DataFrame:
        if all(v.kind not in ("node", "rel") for v in made.values()):
            return df.distinct()
        keys = {self.fresh("d"): self.key_of(E(F.col(f"`{n}`"), v.t, v.kind)) for n, v in made.items()}
        return df.withColumns(keys).dropDuplicates([*outer, *keys]).drop(*keys)

    def amount(self, e: X, what: str) -> int:
        v = self.ex(e, {}).literal if e.op in ("lit", "param") else None
        if v is None:
            row = self.graph.spark.range(1).select(self.ex(e, {}).col).first()[0]
            v = int(row) if isinstance(row, (int, float)) and row == int(row) else row
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherTypeError(f"{what} needs a whole number that isn't negative")
        return v

    def aggregate(self, frame: Frame, items, order, outer) -> tuple[Frame, list]:
        keys = [(n, e) for n, e in items if not self.has_agg(e)]
        aggs: dict[X, tuple[str, E]] = {}
        named: dict[X, str] = {e: n for n, e in keys}

        def collect(e: X):
            if e.op == "agg":
                if e not in aggs:
                    aggs[e] = (self.fresh("a"), self.agg(e, frame.vars, SEQUENCE in frame.df.columns))
                return
            for a in e.args:
                for b in a if isinstance(a, tuple) else (a,):
                    for c in b if isinstance(b, tuple) else (b,):
                        if isinstance(c, X):
                            collect(c)

        self.inputs = {}
        for _, e in (*items, *order_items(order)):
            collect(e)
        if self.inputs:  # columns that an aggregate takes by name
            frame = Frame(frame.df.withColumns(self.inputs), frame.vars)
        group, after = list(outer), []
        key_vals = {}
        for n, e in keys:
            v = self.ex(e, frame.vars)
            key_vals[n] = v
            if v.kind in ("node", "rel"):
                k = self.fresh("g")
                group.append(v.col["_id"].alias(k))
                after.append(F.first(v.col).alias(n))
            else:
                group.append(v.col.alias(n))
        cols = [v.col.alias(n) for n, v in aggs.values()] + after
        df = frame.df.groupBy(*group).agg(*cols) if group else frame.df.agg(*cols)
        scope = {n: frame.var(n, v.t, v.kind) for n, v in key_vals.items()}
        done = {x: E(F.col(f"`{n}`"), v.t, v.kind) for x, (n, v) in aggs.items()}
        self.done = done | {e: scope[n] for e, n in named.items()}
        made = {}
        for n, e in items:
            made[n] = scope[n] if n in scope else self.ex(e, scope)
        sort, extra = [], {}
        for e, down in order:
            same = next((n for n, x in items if x == e), None)
            if same is None:
                same = self.fresh("o")
                extra[same] = self.ex(e, {**made, **scope})
            sort.append((same, down))
        self.done = {}
        out = df.select(*outer, *[v.col.alias(n) for n, v in made.items()], *[v.col.alias(n) for n, v in extra.items()])
        return Frame(out, {n: frame.var(n, v.t, v.kind) for n, v in made.items()}), sort

    def agg(self, x: X, scope, ordered: bool = False) -> E:
        """ordered: the rows have their place in a column, which collect() goes by."""
        name, distinct, args = x.args
        if name == "count" and not args:
            if self.times is not None:
                return E(F.coalesce(F.sum(self.times), F.lit(0).cast("long")), T.LongType())
            return E(F.count(F.lit(1)), T.LongType())
        if any(self.has_agg(a) for a in args):
            raise SemanticError("an aggregate inside an aggregate")
        e = self.ex(args[0], scope)
        if e.family == "mixed" and name not in ("count", "min", "max", "collect", "percentiledisc"):
            text = F.lit(f"{name}() takes numbers")  # only where a value is none
            e = E(F.when(e.col["mixed_rank"] == 3, e.col["mixed_number"]).when(e.col.isNotNull(), F.raise_error(text).cast("double")), T.DoubleType())
        c = self.key_of(e) if name == "count" else e.col
        if name == "count":
            return E(F.count_distinct(c) if distinct else F.count(c), T.LongType())
        if name in ("sum", "avg"):
            if e.family not in ("int", "float", "null"):
                raise CypherTypeError(f"{name}() takes numbers")
            t = T.DoubleType() if e.family == "float" else T.LongType()
            if name == "avg":
                return E(F.avg(c) if not distinct else F.sum_distinct(c.cast("double")) / F.nullif(F.count_distinct(c), F.lit(0)), T.DoubleType())
            return E(F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0).cast(t)).cast(t), t)
        if name in ("min", "max"):
            if e.family in ("node", "map", "rel"):
                raise CypherTypeError(f"{name}() doesn't take a {e.family}")
            if e.family == "list":
                by = sort_key(c, e.t)
                return E(F.min_by(c, by) if name == "min" else F.max_by(c, by), e.t, e.kind)
            return E(F.min(c) if name == "min" else F.max(c), e.t, e.kind)
        if name == "collect" and ordered and not isinstance(e.t, T.NullType):
            placed = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(SEQUENCE).alias("s"), c.alias("v")))))
            values = F.transform(placed, lambda x: x["v"])
            return E(F.array_distinct(values) if distinct else values, T.ArrayType(e.t))
        if name == "collect":
            return E(F.collect_set(c) if distinct else F.collect_list(c), T.ArrayType(e.t))
        p = self.ex(args[1], scope)
        if p.literal is not None and not 0 <= p.literal <= 1:
            raise CypherTypeError("a percentile is between 0 and 1")
        share = p.literal if p.literal is not None else self.graph.spark.range(1).select(p.col).first()[0]
        if name == "percentilecont":
            return E(F.percentile(c.cast("double"), F.lit(float(share))), T.DoubleType())
        if e.family == "float" and not distinct and not isinstance(e.t, T.DecimalType):
            held = self.fresh("x")
            self.inputs[held] = c.cast("double")
            return E(F.expr(f"percentile_disc({float(share)!r}D) WITHIN GROUP (ORDER BY `{held}`)"), T.DoubleType())
        ordered = F.sort_array(F.collect_set(c) if distinct else F.collect_list(c))
        at = F.greatest(F.ceil(F.lit(float(share)) * F.size(ordered)), F.lit(1)).cast("int")
        return E(F.try_element_at(ordered, at), e.t, e.kind)

    # -- expressions
    done: dict = {}

    def ex(self, x: X, scope: dict[str, E]) -> E:
        if x in self.done:
            return self.done[x]
        return getattr(self, f"ex_{x.op}")(x, scope)

    def ex_lit(self, x, scope):
        return lit(x.args[0])

    def ex_param(self, x, scope):
        if x.args[0] not in self.params:
            raise MissingParameter(f"${x.args[0]} has no value")
        return lit(self.params[x.args[0]])

    def ex_var(self, x, scope):
        if x.args[0] not in scope:
            raise UnboundVariable(f"{x.args[0]} is not defined")
        return scope[x.args[0]]

    def bool(self, x, scope) -> Column:
        e = self.ex(x, scope)
        if e.family == "mixed":
            return F.when(e.col["mixed_rank"] == 2, e.col["mixed_number"] != 0).when(e.col.isNotNull(), F.raise_error(F.lit("a boolean is needed")).cast("boolean"))
        if e.family not in ("bool", "null"):
            raise CypherTypeError(f"a boolean is needed, not a {e.family}")
        return e.col.cast("boolean")

    def ex_and(self, x, scope):
        return op.truth(self.bool(x.args[0], scope) & self.bool(x.args[1], scope))

    def ex_or(self, x, scope):
        return op.truth(self.bool(x.args[0], scope) | self.bool(x.args[1], scope))

    def ex_xor(self, x, scope):
        return op.truth(self.bool(x.args[0], scope) != self.bool(x.args[1], scope))

    def ex_not(self, x, scope):
        return op.truth(~self.bool(x.args[0], scope))

    def ex_cmp(self, x, scope):
        return op.compare(x.args[0], self.ex(x.args[1], scope), self.ex(x.args[2], scope))

    def ex_in(self, x, scope):
        needle, l = x.args
        if l.op == "list" and l.args:
            items = [self.ex(y, scope) for y in l.args]
            if len({"number" if e.numeric else e.family for e in items} - {"null"}) > 1:  # no column holds such a list, but it needs none
                e = self.ex(needle, scope)
                return op.truth(reduce(lambda a, b: a | b, [op.equal(e, y) for y in items]))
        return op.contains(self.ex(needle, scope), self.ex(l, scope))

    def text_test(self, x, scope, f):
        a, b = (self.ex(y, scope) for y in x.args)
        a, b = (E(mixed_string(e.col), T.StringType()) if e.family == "mixed" else e for e in (a, b))
        if a.family != "string" or b.family != "string":
            return op.truth(F.lit(None).cast("boolean"))
        return op.truth(f(a.col, b.col))

    def ex_startswith(self, x, scope):
        return self.text_test(x, scope, F.startswith)

    def ex_endswith(self, x, scope):
        return self.text_test(x, scope, F.endswith)

    def ex_contains(self, x, scope):
        return self.text_test(x, scope, F.contains)

    def ex_isnull(self, x, scope):
        return op.truth(self.key_null(self.ex(x.args[0], scope)).isNull())

    def ex_notnull(self, x, scope):
        return op.truth(self.key_null(self.ex(x.args[0], scope)).isNotNull())

    def key_null(self, e: E) -> Column:
        return e.col["_id"] if e.kind in ("node", "rel") else e.col

    def ex_arith(self, x, scope):
        return op.arith(x.args[0], self.ex(x.args[1], scope), self.ex(x.args[2], scope))

    def ex_neg(self, x, scope):
        return op.arith("*", self.ex(x.args[0], scope), lit(-1))

    def ex_prop(self, x, scope):
        return op.prop(self.ex(x.args[0], scope), x.args[1])

    def ex_index(self, x, scope):
        return op.index(self.ex(x.args[0], scope), self.ex(x.args[1], scope))

    def ex_slice(self, x, scope):
        l, a, b = (self.ex(y, scope) if y is not None else None for y in x.args)
        return op.slice_(l, a, b)

    def ex_haslabels(self, x, scope):
        e = self.ex(x.args[0], scope)
        return NULL if e.family == "null" else op.truth(self.has_labels(e, x.args[1]))

    def ex_list(self, x, scope):
        return make_list([self.ex(y, scope) for y in x.args])

    def ex_map(self, x, scope):
        return make_map([(k, self.ex(e, scope)) for k, e in x.args])

    def ex_case(self, x, scope):
        subject, arms, other = x.args
        s = self.ex(subject, scope) if subject else None
        made = []
        for w, v in arms:
            if s is None:
                cond = self.bool(w, scope)
            else:
                e = self.ex(w, scope)
                both_null = s.col.isNull() & e.col.isNull()
                cond = both_null | F.coalesce(op.equal(s, e), F.lit(False))
            made.append((cond, self.ex(v, scope)))
        last = self.ex(other, scope)
        t = last.t
        for _, v in made:
            t = common(t, v.t)
        out = None
        for cond, v in made:
            out = F.when(cond, to(v, t)) if out is None else out.when(cond, to(v, t))
        return E(out.otherwise(to(last, t)), t, kind_of(t))

    def ex_comp(self, x, scope):
        var, src, where, e = x.args
        l = self.ex(src, scope)
        if l.family == "null":
            return NULL
        if l.family != "list":
            raise CypherTypeError("a comprehension needs a list")
        col = l.col
        if where is not None:
            col = F.filter(col, lambda v: self.bool(where, {**scope, var: l.item(v)}))
        if e is None:
            return E(col, l.t)
        t = self.ex(e, {**scope, var: l.item(F.lit(None))}).t
        return E(F.transform(col, lambda v: self.ex(e, {**scope, var: l.item(v)}).col), T.ArrayType(t))

    def ex_quant(self, x, scope):
        which, var, src, where = x.args
        l = self.ex(src, scope)
        if l.family == "null":
            return NULL
        if l.family != "list":
            raise CypherTypeError(f"{which}() needs a list")
        test = lambda v: self.bool(where, {**scope, var: l.item(v)})
        if which == "all":
            return op.truth(F.forall(l.col, test))
        if which == "any":
            return op.truth(F.exists(l.col, test))
        if which == "none":
            return op.truth(~F.exists(l.col, test))
        seen = F.transform(l.col, test)
        yes = F.size(F.filter(seen, lambda v: F.coalesce(v, F.lit(False))))
        unknown = F.size(F.filter(seen, lambda v: v.isNull()))
        return op.truth(F.when(l.col.isNull(), F.lit(None)).when(yes > 1, F.lit(False)).when(unknown > 0, F.lit(None)).otherwise(yes == 1))

    def ex_call(self, x, scope):
        name, args = x.args
        es = [self.ex(a, scope) for a in args]
        if name in ("id", "labels", "type", "startnode", "endnode"):
            if len(es) != 1:
                raise SemanticError(f"{name}() takes one argument")
            e = es[0]
            if e.family == "null":
                return NULL
            want = {"labels": ("node",), "type": ("rel",), "startnode": ("rel",), "endnode": ("rel",)}.get(name, ("node", "rel"))
            if e.kind not in want:
                raise CypherTypeError(f"{name}() doesn't take a {e.family}")
            if name == "id":
                return E(e.col["_id"], T.LongType())
            if name == "labels":
                return E(e.col["_labels"], T.ArrayType(T.StringType()))
            if name == "type":
                return E(e.col["_type"], T.StringType())
            end = e.col["_src" if name == "startnode" else "_dst"]
            return E(F.when(end.isNotNull(), F.struct(end.alias("_id"))), T.StructType([T.StructField("_id", T.LongType())]), "node")
        return scalar.call(name, es, self.instant)

    def ex_agg(self, x, scope):
        raise SemanticError(f"{x.args[0]}() can't stand here")

    def ex_pattern(self, x, scope):
        raise SemanticError("a pattern can't stand here")

    ex_exists = ex_existsq = ex_patcomp = ex_pattern

    # -- procedures
    def do_call(self, frame: Frame, body) -> Frame:
        name, args, yields, where = body
        if name.lower() not in self.procedures:
            raise SemanticError(f"there is no procedure {name}")
        proc = self.procedures[name.lower()]
        if args is None:
            args = tuple(X("param", (n,)) for n, _ in proc.inputs)
        if len(args) != len(proc.inputs):
            raise SemanticError(f"{name} takes {len(proc.inputs)} arguments")
        by_row = any(y.op == "var" for a in args for y in a.walk())
        es = [self.ex(a, frame.vars if by_row else {}) for a in args]
        if by_row:
            frame, side, key = self.call_by_row(frame, proc, es)
        else:
            side, key = proc.call(self.graph, *[self.constant(e) for e in es]), None
        found = [c for c in side.columns if c != key]
        names = [(n, n) for n in found] if yields in (None, "*") else yields
        if missing := [y for y, _ in names if y not in found]:
            raise SemanticError(f"{name} yields no {', '.join(missing)}")
        if yields is None and frame.vars:
            names = []
        side = side.select(*[F.col(f"`{y}`").alias(a) for y, a in names], *([key] if key else []))
        # the procedure's rows for each row of the query, as the language asks
        df = (frame.df.join(side, key) if key else frame.df.crossJoin(side)) if names else frame.df
        frame = frame.bind(df.drop(key) if key else df, **{a: (side.schema[a].dataType, "value") for _, a in names})
        return self.filter(frame, where)

    def constant(self, e: E):
        return e.literal if e.literal is not None or e.family == "null" else self.graph.spark.range(1).select(e.col).first()[0]

    def call_by_row(self, frame: Frame, proc, es: list[E]) -> tuple[Frame, DataFrame, str]:
        """The frame with the number of each row's arguments, and the rows of one call for each number.

        A procedure is called on the driver, so that more than MAX_CALLS different argument lists are an error.
        """
        spark, key, keys = self.graph.spark, self.fresh("call"), [self.fresh("k") for _ in es]
        df = frame.df.withColumns({k: e.col for k, e in zip(keys, es, strict=True)})
        asked = df.select(*keys).distinct()
        rows = asked.limit(MAX_CALLS + 1).collect()
        if len(rows) > MAX_CALLS:
            raise ResourceLimit(f"a procedure is called with more than {MAX_CALLS} different argument lists")
        schema = T.StructType([T.StructField(key, T.LongType()), *[T.StructField(f"{f.name}_i", f.dataType) for f in asked.schema]])
        numbered = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
        calls = [proc.call(self.graph, *row).withColumn(key, F.lit(i).cast("long")) for i, row in enumerate(rows)]
        none = ", ".join(f"`{n}` {OUTPUTS.get(t, 'string')}" for n, t in proc.outputs)
        side = reduce(lambda x, y: x.unionByName(y), calls) if calls else spark.createDataFrame([], f"{none}, {key} long")
        df = df.join(F.broadcast(numbered), self.all_equal(keys, [f"{k}_i" for k in keys])).drop(*keys, *[f"{k}_i" for k in keys])
        return Frame(df, frame.vars), side, key


def order_items(order):
    return [(None, e) for e, _ in order]


def do_write(kind: str):
    def run(self, frame: Frame, body) -> Frame:
        from ..operators import mutate

        return getattr(mutate, kind)(self, frame, body)

    return run


for _kind in ("create", "merge", "set", "remove", "delete"):
    setattr(Compiler, f"do_{_kind}", do_write(_kind))
