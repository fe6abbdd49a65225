"""Query text to syntax tree: a tokenizer and a recursive-descent parser.

An expression is an X(op, args): args are X, plain values, or tuples of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import CypherSyntaxError


@dataclass(frozen=True)
class X:
    op: str
    args: tuple = ()

    def walk(self):
        yield self
        for a in self.args:
            yield from _walk(a)


def _walk(a):
    if isinstance(a, X):
        yield from a.walk()
    elif isinstance(a, tuple):
        for b in a:
            yield from _walk(b)
    elif isinstance(a, (NodePattern, RelPattern)):
        for _, e in a.props:
            yield from e.walk()
    elif isinstance(a, PathPattern):
        for b in (*a.nodes, *a.rels):
            yield from _walk(b)


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...] = ()
    props: tuple = ()


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...] = ()
    props: tuple = ()
    way: str = "both"  # out, in, both
    hops: tuple[int, int | None] | None = None


@dataclass(frozen=True)
class PathPattern:
    var: str | None
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    shortest: bool = False


@dataclass(frozen=True)
class Item:
    expr: X
    name: str
    aliased: bool = False


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[X, bool]] = field(default_factory=list)
    skip: X | None = None
    limit: X | None = None
    where: X | None = None


@dataclass
class Clause:
    kind: str
    body: Any


@dataclass
class Query:
    parts: list[list[Clause]]
    union_all: list[bool] = field(default_factory=list)


@dataclass
class Statement:
    kind: str  # query, explain, begin, commit, rollback, index
    body: Any = None


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
  |(?P<number>0x[0-9a-fA-F]+|0o[0-7]+|(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
  |(?P<quoted>`(?:``|[^`])*`)
  |(?P<param>\$(?:\w+|`[^`]*`))
  |(?P<name>[^\W\d]\w*)
  |(?P<sign><>|<=|>=|=~|\.\.|\+=|[-+*/%^=<>()\[\]{},.:;|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", "'": "'", '"': '"'}


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherSyntaxError(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup
        # 1..3 is a range, not 1. and .3
        if kind == "number" and (dots := re.match(r"\d+(?=\.\.)", text[at:])):
            out.append(("number", dots[0], at))
            at += dots.end()
            continue
        if kind != "space":
            out.append((kind, m[0], at))
        at = m.end()
    out.append(("end", "", at))
    return out


def _string(raw: str) -> str:
    def one(m):
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "uU" and len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, raw[1:-1], flags=re.S)


def split_batch(text: str) -> list[str]:
    """Statements between semicolons that are outside strings, quoted names and comments."""
    cuts = [at for kind, s, at in tokens(text) if kind == "sign" and s == ";"]
    bounds = [-1, *cuts, len(text)]
    return [s for a, b in zip(bounds, bounds[1:], strict=False) if (s := text[a + 1 : b].strip()) and len(tokens(s)) > 1]


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i = text, tokens(text), 0

    # -- tokens
    def peek(self, *words: str, ahead: int = 0) -> bool:
        if self.i + ahead >= len(self.toks):
            return False
        kind, s, _ = self.toks[self.i + ahead]
        return kind in ("name", "sign") and (s.upper() if kind == "name" else s) in words

    def take(self, *words: str) -> bool:
        """The words in a row, or nothing."""
        if all(self.peek(w, ahead=k) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            _, s, at = self.toks[self.i]
            raise CypherSyntaxError(f"expected {' '.join(words)} but found {s or 'the end'!r} at {at}")

    def name(self) -> str:
        kind, s, at = self.toks[self.i]
        if kind == "name":
            self.i += 1
            return s
        if kind == "quoted":
            self.i += 1
            return s[1:-1].replace("``", "`")
        raise CypherSyntaxError(f"expected a name but found {s or 'the end'!r} at {at}")

    def at_name(self) -> bool:
        return self.toks[self.i][0] in ("name", "quoted")

    # -- statements
    def statement(self) -> Statement:
        if self.take("BEGIN"):
            self.take("TRANSACTION")
            out = Statement("begin")
        elif self.take("COMMIT"):
            out = Statement("commit")
        elif self.take("ROLLBACK"):
            out = Statement("rollback")
        elif self.take("EXPLAIN"):
            out = Statement("explain", self.query())
        elif self.peek("CREATE", "DROP") and self.peek("INDEX", "UNIQUE", ahead=1):
            drop = self.take("DROP")
            if not drop:
                self.need("CREATE")
            unique = self.take("UNIQUE")
            self.need("INDEX", "ON", ":")
            label = self.name()
            self.need("(")
            prop = self.name()
            self.need(")")
            unique = self.take("UNIQUE") or unique
            out = Statement("drop_index" if drop else "index", (label, prop, unique))
        else:
            out = Statement("query", self.query())
        self.take(";")
        if self.toks[self.i][0] != "end":
            raise CypherSyntaxError(f"unexpected {self.toks[self.i][1]!r} at {self.toks[self.i][2]}")
        return out

    def query(self, until: str | None = None) -> Query:
        parts, alls = [self.single(until)], []
        while self.take("UNION"):
            alls.append(self.take("ALL"))
            parts.append(self.single(until))
        if len(set(alls)) > 1:
            raise CypherSyntaxError("UNION and UNION ALL can't be mixed")
        return Query(parts, alls)

    def single(self, until: str | None) -> list[Clause]:
        out: list[Clause] = []
        while not (self.toks[self.i][0] == "end" or self.peek(";", "UNION") or (until and self.peek(until))):
            if out and out[-1].kind == "return":
                raise CypherSyntaxError("RETURN must be the last clause")
            out.append(self.clause())
        if not out:
            raise CypherSyntaxError("an empty query")
        if out[-1].kind in ("match", "optional", "with", "unwind"):
            raise CypherSyntaxError("a query can't end with this clause")
        return out

    def clause(self) -> Clause:
        if self.take("OPTIONAL", "MATCH"):
            return Clause("optional", (self.patterns(), self.where()))
        if self.take("MATCH"):
            return Clause("match", (self.patterns(), self.where()))
        if self.take("UNWIND"):
            e = self.expr()
            self.need("AS")
            return Clause("unwind", (e, self.name()))
        if self.take("WITH"):
            p = self.projection()
            p.where = self.where()
            for it in p.items:
                if not it.aliased and it.expr.op != "var":
                    raise SyntaxErrorAlias(it)
            return Clause("with", p)
        if self.take("RETURN"):
            return Clause("return", self.projection())
        if self.take("CREATE"):
            return Clause("create", self.patterns())
        if self.take("MERGE"):
            pattern, on = self.path(), {"CREATE": [], "MATCH": []}
            while self.take("ON"):
                which = "CREATE" if self.take("CREATE") else "MATCH"
                if which == "MATCH":
                    self.need("MATCH")
                self.need("SET")
                on[which] += self.sets()
            return Clause("merge", (pattern, on["CREATE"], on["MATCH"]))
        if self.take("SET"):
            return Clause("set", self.sets())
        if self.take("REMOVE"):
            out = []
            while True:
                base = self.postfix(labels=False)
                if self.peek(":"):
                    out.append(("labels", base, self.labels()))
                elif base.op == "prop":
                    out.append(("prop", base.args[0], base.args[1]))
                else:
                    raise CypherSyntaxError("REMOVE takes properties and labels")
                if not self.take(","):
                    return Clause("remove", out)
        detach = self.take("DETACH")
        if self.take("DELETE"):
            out = [self.expr()]
            while self.take(","):
                out.append(self.expr())
            return Clause("delete", (out, detach))
        if self.take("CALL"):
            name = self.name()
            while self.take("."):
                name += "." + self.name()
            args = None
            if self.take("("):
                args = self.list_of(")")
            yields, where = None, None
            if self.take("YIELD"):
                if self.take("*"):
                    yields = "*"
                else:
                    yields = []
                    while True:
                        y = self.name()
                        yields.append((y, self.name() if self.take("AS") else y))
                        if not self.take(","):
                            break
                where = self.where()
            return Clause("call", (name, args, yields, where))
        _, s, at = self.toks[self.i]
        raise CypherSyntaxError(f"expected a clause but found {s!r} at {at}")

    def where(self) -> X | None:
        return self.expr() if self.take("WHERE") else None

    def sets(self) -> list[tuple]:
        out = []
        while True:
            base = self.postfix(labels=False)
            if self.peek(":"):
                out.append(("labels", base, self.labels()))
            elif self.take("+="):
                out.append(("add", base, self.expr()))
            else:
                self.need("=")
                e = self.expr()
                out.append(("prop", base.args[0], base.args[1], e) if base.op == "prop" else ("replace", base, e))
            if not self.take(","):
                return out

    def projection(self) -> Projection:
        p = Projection([], distinct=self.take("DISTINCT"))
        if self.take("*"):
            p.star = True
            more = self.take(",")
        else:
            more = True
        while more:
            start = self.toks[self.i][2]
            e = self.expr()
            text = self.text[start : self.toks[self.i - 1][2] + len(self.toks[self.i - 1][1])]
            aliased = self.take("AS")
            p.items.append(Item(e, self.name() if aliased else e.args[0] if e.op == "var" else text, aliased))
            more = self.take(",")
        names = [it.name for it in p.items]
        if len(set(names)) < len(names):
            raise CypherSyntaxError("two columns have the same name")
        if self.take("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                p.order.append((e, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            p.skip = self.expr()
        if self.take("LIMIT"):
            p.limit = self.expr()
        return p

    # -- patterns
    def patterns(self) -> list[PathPattern]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def path(self) -> PathPattern:
        var = None
        if self.at_name() and self.peek("=", ahead=1):
            var = self.name()
            self.need("=")
        if self.take("SHORTESTPATH"):
            self.need("(")
            nodes, rels = self.chain()
            self.need(")")
            if len(rels) != 1:
                raise CypherSyntaxError("shortestPath takes one relationship")
            return PathPattern(var, nodes, rels, True)
        return PathPattern(var, *self.chain())

    def chain(self) -> tuple[tuple[NodePattern, ...], tuple[RelPattern, ...]]:
        nodes, rels = [self.node()], []
        while self.peek("-") or (self.peek("<") and self.peek("-", ahead=1)):
            rels.append(self.rel())
            nodes.append(self.node())
        return tuple(nodes), tuple(rels)

    def labels(self) -> tuple[str, ...]:
        out = []
        while self.take(":"):
            out.append(self.name())
        return tuple(out)

    def props(self) -> tuple:
        if self.peek("{"):
            return self.map_literal().args
        if self.toks[self.i][0] == "param":
            raise CypherSyntaxError("a parameter can't stand for a pattern's properties here")
        return ()

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.at_name() else None
        out = NodePattern(var, self.labels(), self.props())
        self.need(")")
        return out

    def rel(self) -> RelPattern:
        left = self.take("<", "-")
        if not left:
            self.need("-")
        var, types, props, hops = None, (), (), None
        if self.take("["):
            var = self.name() if self.at_name() else None
            if self.take(":"):
                types = (self.name(),)
                while self.take("|"):
                    self.take(":")
                    types += (self.name(),)
            if self.take("*"):
                lo = hi = None
                if self.toks[self.i][0] == "number":
                    lo = self.integer()
                    hi = lo
                if self.take(".."):
                    hi = self.integer() if self.toks[self.i][0] == "number" else None
                hops = (1 if lo is None else lo, hi)
            props = self.props()
            self.need("]")
        self.need("-")
        right = self.take(">")
        way = "both" if left == right else "in" if left else "out"
        return RelPattern(var, types, props, way, hops)

    def integer(self) -> int:
        _, s, at = self.toks[self.i]
        if not s.isdigit():
            raise CypherSyntaxError(f"expected a whole number at {at}")
        self.i += 1
        return int(s)

    # -- expressions, by precedence
    def expr(self) -> X:
        e = self.xor()
        while self.take("OR"):
            e = X("or", (e, self.xor()))
        return e

    def xor(self) -> X:
        e = self.conj()
        while self.take("XOR"):
            e = X("xor", (e, self.conj()))
        return e

    def conj(self) -> X:
        e = self.negation()
        while self.take("AND"):
            e = X("and", (e, self.negation()))
        return e

    def negation(self) -> X:
        return X("not", (self.negation(),)) if self.take("NOT") else self.comparison()

    def comparison(self) -> X:
        first = self.predicate()
        links, left = [], first
        while self.peek("=", "<>", "<", "<=", ">", ">="):
            op = self.toks[self.i][1]
            self.i += 1
            right = self.predicate()
            links.append(X("cmp", (op, left, right)))
            left = right
        if not links:
            return first
        out = links[0]
        for x in links[1:]:
            out = X("and", (out, x))
        return out

    def predicate(self) -> X:
        e = self.sum()
        while True:
            if self.take("IN"):
                e = X("in", (e, self.sum()))
            elif self.take("STARTS", "WITH"):
                e = X("startswith", (e, self.sum()))
            elif self.take("ENDS", "WITH"):
                e = X("endswith", (e, self.sum()))
            elif self.take("CONTAINS"):
                e = X("contains", (e, self.sum()))
            elif self.take("IS", "NOT", "NULL"):
                e = X("notnull", (e,))
            elif self.take("IS", "NULL"):
                e = X("isnull", (e,))
            else:
                return e

    def sum(self) -> X:
        e = self.product()
        while self.peek("+", "-"):
            op = self.toks[self.i][1]
            self.i += 1
            e = X("arith", (op, e, self.product()))
        return e

    def product(self) -> X:
        e = self.power()
        while self.peek("*", "/", "%"):
            op = self.toks[self.i][1]
            self.i += 1
            e = X("arith", (op, e, self.power()))
        return e

    def power(self) -> X:
        e = self.unary()
        while self.take("^"):
            e = X("arith", ("^", e, self.unary()))
        return e

    def unary(self) -> X:
        if self.take("-"):
            e = self.unary()
            return X("lit", (-e.args[0],)) if e.op == "lit" and type(e.args[0]) in (int, float) else X("neg", (e,))
        if self.take("+"):
            return self.unary()
        return self.postfix()

    def postfix(self, labels: bool = True) -> X:
        e = self.atom()
        while True:
            if self.take("."):
                e = X("prop", (e, self.name()))
            elif self.take("["):
                if self.take(".."):
                    e = X("slice", (e, None, None if self.peek("]") else self.expr()))
                else:
                    a = self.expr()
                    e = X("slice", (e, a, None if self.peek("]") else self.expr())) if self.take("..") else X("index", (e, a))
                self.need("]")
            elif labels and self.peek(":") and self.toks[self.i + 1][0] in ("name", "quoted"):
                e = X("haslabels", (e, self.labels()))
            else:
                return e

    def list_of(self, end: str) -> tuple[X, ...]:
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.expr())
        return tuple(out)

    def map_literal(self) -> X:
        self.need("{")
        out = []
        while not self.take("}"):
            if out:
                self.need(",")
            k = self.name()
            self.need(":")
            out.append((k, self.expr()))
        return X("map", tuple(out))

    def try_pattern(self) -> PathPattern | None:
        """A chain of at least one relationship, or nothing taken."""
        at = self.i
        try:
            nodes, rels = self.chain()
            if rels:
                return PathPattern(None, nodes, rels)
        except CypherSyntaxError:
            pass
        self.i = at
        return None

    def atom(self) -> X:
        kind, s, at = self.toks[self.i]
        if kind == "number":
            self.i += 1
            if s[:2] in ("0x", "0o"):
                return X("lit", (int(s, 0),))
            if re.fullmatch(r"\d+", s):
                if int(s) > 2**63:
                    raise CypherSyntaxError(f"{s} is too large")
                return X("lit", (int(s),))
            if float(s) == float("inf"):
                raise CypherSyntaxError(f"{s} is too large")
            return X("lit", (float(s),))
        if kind == "string":
            self.i += 1
            return X("lit", (_string(s),))
        if kind == "param":
            self.i += 1
            return X("param", (s[1:].strip("`"),))
        if self.peek("("):
            if p := self.try_pattern():
                return X("pattern", (p,))
            self.need("(")
            e = self.expr()
            self.need(")")
            return e
        if self.peek("["):
            return self.bracket()
        if self.peek("{"):
            return self.map_literal()
        if kind == "name":
            up = s.upper()
            if up in ("TRUE", "FALSE", "NULL") and not self.peek("(", ahead=1):
                self.i += 1
                return X("lit", ({"TRUE": True, "FALSE": False, "NULL": None}[up],))
            if up == "CASE":
                return self.case()
            if up == "COUNT" and self.peek("(", ahead=1) and self.peek("*", ahead=2):
                self.i += 3
                self.need(")")
                return X("agg", ("count", False, ()))
            if up == "EXISTS" and self.peek("{", ahead=1):
                self.i += 2
                if self.peek("MATCH", "OPTIONAL", "WITH", "UNWIND", "CALL", "RETURN"):
                    q = Query([self.inner_query()])
                    self.need("}")
                    return X("existsq", (_Held(q),))
                patterns = self.patterns()
                w = self.where()
                self.need("}")
                return X("exists", (tuple(patterns), w))
            if up in ("ALL", "ANY", "NONE", "SINGLE") and self.peek("(", ahead=1):
                self.i += 2
                var = self.name()
                self.need("IN")
                src = self.expr()
                w = self.where()
                self.need(")")
                return X("quant", (up.lower(), var, src, w or X("lit", (True,))))
            save = self.i
            name = self.name()
            while self.take("."):
                if not self.at_name():
                    break
                name += "." + self.name()
            if self.peek("("):
                self.i += 1
                distinct = self.take("DISTINCT")
                args = self.list_of(")")
                low = name.lower()
                if low in AGGREGATES:
                    return X("agg", (low, distinct, args))
                if distinct:
                    raise CypherSyntaxError(f"{low}() is no aggregate, and takes no DISTINCT")
                return X("call", (low, args))
            self.i = save
            return X("var", (self.name(),))
        if kind == "quoted":
            return X("var", (self.name(),))
        raise CypherSyntaxError(f"unexpected {s or 'the end'!r} at {at}")

    def inner_query(self) -> list[Clause]:
        out = []
        while not self.peek("}"):
            out.append(self.clause())
        return out

    def case(self) -> X:
        self.need("CASE")
        subject = None if self.peek("WHEN") else self.expr()
        arms = []
        while self.take("WHEN"):
            w = self.expr()
            self.need("THEN")
            arms.append((w, self.expr()))
        other = self.expr() if self.take("ELSE") else X("lit", (None,))
        self.need("END")
        return X("case", (subject, tuple(arms), other))

    def bracket(self) -> X:
        self.need("[")
        save = self.i
        if self.at_name() and self.peek("IN", ahead=1):
            var = self.name()
            self.need("IN")
            src = self.expr()
            w = self.where()
            e = self.expr() if self.take("|") else None
            if self.take("]"):
                return X("comp", (var, src, w, e))
            self.i = save
        var = None
        if self.at_name() and self.peek("=", ahead=1):
            var = self.name()
            self.need("=")
        if self.peek("(") and (p := self.try_pattern()):
            w = self.where()
            if self.take("|"):
                e = self.expr()
                self.need("]")
                return X("patcomp", (PathPattern(var, p.nodes, p.rels), w, e))
        self.i = save
        return X("list", self.list_of("]"))


class _Held:
    """A query inside an expression; equal to itself only."""

    def __init__(self, query: Query):
        self.query = query


AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentilecont", "percentiledisc"}


def SyntaxErrorAlias(item: Item) -> CypherSyntaxError:  # noqa: N802
    return CypherSyntaxError(f"an expression in WITH needs a name: {item.name}")


def parse(text: str) -> Statement:
    return Parser(text).statement()
