"""Scalar functions by lower-case name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError, SemanticError
from . import temporal
from .operators import mixed_text
from .values import DURATION, NULL, E, common, kind_of, make_list, mixed_string, to

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
#: What Unicode calls white space.
_SPACE = r"[\s\u0085   -     　]+"


def _int(c: Column) -> Column:
    return c.cast("int")


def _number(e: E, name: str) -> E:
    if not e.numeric:
        raise CypherTypeError(f"{name}() takes a number, not a {e.family}")
    return e


def by_type(e: E, **each) -> Column:
    """What a function of strings, booleans or numbers gives for a mixed value."""
    x = e.col
    of = lambda name: each[name](x).col if name in each else F.lit(None)
    return F.when(x["mixed_rank"] == 1, of("string")).when(x["mixed_rank"] == 2, of("bool")).when(x["mixed_rank"] == 3, of("number"))


def to_integer(e: E) -> E:
    if e.family == "mixed":
        whole = lambda x: F.coalesce(x["mixed_int"], x["mixed_number"].try_cast("long"))
        return E(by_type(e, string=lambda x: to_integer(E(x["mixed_text"], _S)), number=lambda x: E(whole(x), _L)), _L)
    if e.family == "bool":
        return E(F.lit(None).cast("long"), _L)
    if e.family == "string":
        s = F.btrim(e.col)
        return E(F.coalesce(s.try_cast("long"), s.try_cast("double").try_cast("long")), _L)
    if e.family == "float":
        return E(e.col.try_cast("long"), _L)
    return E(_number(e, "toInteger").col.cast("long"), _L)


def to_float(e: E) -> E:
    if e.family == "mixed":
        return E(by_type(e, string=lambda x: to_float(E(x["mixed_text"], _S)), number=lambda x: E(x["mixed_number"], _D)), _D)
    if e.family == "string":
        return E(F.btrim(e.col).try_cast("double"), _D)
    return E(_number(e, "toFloat").col.cast("double"), _D)


def to_boolean(e: E) -> E:
    if e.family == "bool":
        return e
    if e.family == "mixed":
        return E(by_type(e, string=lambda x: to_boolean(E(x["mixed_text"], _S)), bool=lambda x: E(x["mixed_number"] != 0, _B)), _B)
    if e.family != "string":
        raise CypherTypeError("toBoolean() takes a string or a boolean")
    s = F.lower(F.btrim(e.col))
    return E(F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False)), _B)


def to_string(e: E) -> E:
    if e.family in ("list", "map", "node", "rel", "path"):
        raise CypherTypeError(f"toString() doesn't take a {e.family}")
    if e.family == "mixed":
        return E(mixed_text(e), _S)
    return E(temporal.text(e), _S)


def size(e: E) -> E:
    if e.family == "list":
        return E(F.size(e.col).cast("long"), _L)
    if e.family in ("string", "mixed"):
        return E(F.length(e.col if e.family == "string" else mixed_string(e.col)).cast("long"), _L)
    raise CypherTypeError("size() takes a list or a string")


def _no_path(e: E, name: str = "length") -> E:
    raise CypherTypeError(f"{name}() takes a path, not a {e.family}")


def range_(a: E, b: E, step: E | None = None) -> E:
    s = step.col.cast("long") if step else F.lit(1).cast("long")
    if step and step.literal == 0:
        raise CypherTypeError("range() needs a step other than 0")
    x, y = a.col.cast("long"), b.col.cast("long")
    # sequence() refuses a wrong direction, so it never sees one
    right = ((s > 0) & (x <= y)) | ((s < 0) & (x >= y))
    none = F.array().cast("array<bigint>")
    return E(F.when(x.isNull() | y.isNull() | s.isNull(), F.lit(None)).when(right, F.sequence(x, F.when(right, y).otherwise(x), F.when(right, s).otherwise(F.lit(1).cast("long")))).otherwise(none), T.ArrayType(_L))


def reverse(e: E) -> E:
    if e.family not in ("string", "list"):
        raise CypherTypeError("reverse() takes a string or a list")
    return E(F.reverse(e.col), e.t)


def substring(s: E, start: E, n: E | None = None) -> E:
    i = _int(start.col) + 1
    return E(F.substr(s.col, i, _int(n.col)) if n else F.substr(s.col, i), _S)


def split(s: E, by: E) -> E:
    quoted = F.concat(F.lit(r"\Q"), by.col, F.lit(r"\E"))
    return E(F.when(by.col == "", F.filter(F.split(s.col, ""), lambda x: x != "")).otherwise(F.split(s.col, quoted)), T.ArrayType(_S))


def strip(left: bool, right: bool):
    pattern = "|".join(p for p, on in ((f"^{_SPACE}", left), (f"{_SPACE}$", right)) if on)
    return lambda e: E(F.regexp_replace(e.col, pattern, ""), _S)


def round_(e: E) -> E:
    c = _number(e, "round").col.cast("double")
    half = F.floor(F.abs(c) + 0.5).cast("double") * F.signum(c)
    return E(F.when(F.isnan(c) | (F.abs(c) >= 2.0**52), c).otherwise(half), _D)


def whole(name: str, f):
    def run(e: E) -> E:
        c = _number(e, name).col.cast("double")
        return E(F.when(F.isnan(c) | (F.abs(c) >= 2.0**52), c).otherwise(f(c).cast("double")), _D)

    return run


def coalesce(*es: E) -> E:
    t: T.DataType = T.NullType()
    for e in es:
        t = common(t, e.t)
    kind = next((e.kind for e in es if e.kind not in ("value", "mixed")), kind_of(t))
    return E(F.coalesce(*[to(e, t) for e in es]), t, kind)


def keys(e: E) -> E:
    if not isinstance(e.t, T.StructType):
        raise CypherTypeError("keys() takes a map, a node or a relationship")
    names = [F.when(e.col[f.name].isNotNull() | F.lit(e.kind == "map"), F.lit(f.name)) for f in e.t if not f.name.startswith("_")]
    if not names:
        return E(F.array().cast("array<string>"), T.ArrayType(_S))
    return E(F.when(e.col.isNotNull(), F.filter(F.array(*names), lambda x: x.isNotNull())), T.ArrayType(_S))


def properties(e: E) -> E:
    if not isinstance(e.t, T.StructType):
        raise CypherTypeError("properties() takes a map, a node or a relationship")
    fields = [f for f in e.t if not f.name.startswith("_")]
    return E(F.when(e.col.isNotNull(), F.struct(*[e.col[f.name].alias(f.name) for f in fields])), T.StructType(fields), "map")


def _simple(f, t):
    return lambda *es: E(f(*[e.col for e in es]), t)


FUNCTIONS = {
    "coalesce": coalesce,
    "tointeger": to_integer,
    "tofloat": to_float,
    "toboolean": to_boolean,
    "tostring": to_string,
    "size": size,
    "length": lambda p: E(F.size(p.col["rels"]).cast("long"), _L) if p.kind == "path" else _no_path(p),
    "nodes": lambda p: E(p.col["nodes"], T.ArrayType(_L)) if p.kind == "path" else _no_path(p, "nodes"),
    "relationships": lambda p: E(p.col["rels"], T.ArrayType(_L)) if p.kind == "path" else _no_path(p, "relationships"),
    "head": lambda l: l.item(F.get(l.col, F.lit(0))),
    "last": lambda l: l.item(F.try_element_at(l.col, F.lit(-1))),
    "tail": lambda l: E(F.slice(l.col, F.lit(2), F.greatest(F.size(l.col) - 1, F.lit(0))), l.t),
    "range": range_,
    "reverse": reverse,
    "toupper": _simple(F.upper, _S),
    "upper": _simple(F.upper, _S),
    "tolower": _simple(F.lower, _S),
    "lower": _simple(F.lower, _S),
    "trim": strip(True, True),
    "ltrim": strip(True, False),
    "rtrim": strip(False, True),
    "replace": lambda s, a, b: E(F.when(a.col == "", s.col).otherwise(F.replace(s.col, a.col, b.col)), _S),
    "split": split,
    "substring": substring,
    "left": lambda s, n: E(F.left(s.col, _int(n.col)), _S),
    "right": lambda s, n: E(F.right(s.col, _int(n.col)), _S),
    "abs": lambda e: E(F.abs(_number(e, "abs").col), e.t),
    "ceil": whole("ceil", F.ceil),
    "floor": whole("floor", F.floor),
    "round": round_,
    "sqrt": lambda e: E(F.sqrt(_number(e, "sqrt").col.cast("double")), _D),
    "sign": lambda e: E(F.signum(_number(e, "sign").col.cast("double")).cast("long"), _L),
    "rand": lambda: E(F.rand(), _D),
    "keys": keys,
    "properties": properties,
    "exists": lambda e: E(e.col.isNotNull(), _B),
    "date": temporal.date,
    "localdatetime": temporal.localdatetime,
    "localtime": temporal.localtime,
    "time": temporal.time,
    "datetime": temporal.zoned,
    "datetime.fromepoch": lambda s, n: temporal.zoned(E(F.timestamp_micros(s.col * 1000000 + F.call_function("div", n.col, F.lit(1000))).cast("timestamp_ntz"), T.TimestampNTZType())),
    "datetime.fromepochmillis": lambda ms: temporal.zoned(E(F.timestamp_millis(ms.col).cast("timestamp_ntz"), T.TimestampNTZType())),
    "duration": temporal.duration,
    "duration.between": temporal.between,
    "duration.inmonths": lambda a, b: temporal.between(a, b, "inmonths"),
    "duration.indays": lambda a, b: temporal.between(a, b, "indays"),
    "duration.inseconds": lambda a, b: temporal.between(a, b, "inseconds"),
    "date.truncate": lambda u, e, parts=None: temporal.truncate("date", u, e, parts),
    "localdatetime.truncate": lambda u, e, parts=None: temporal.truncate("localdatetime", u, e, parts),
    "datetime.truncate": lambda u, e, parts=None: temporal.truncate("datetime", u, e, parts),
    "localtime.truncate": lambda u, e, parts=None: temporal.truncate("localtime", u, e, parts),
    "time.truncate": lambda u, e, parts=None: temporal.truncate("time", u, e, parts),
}
NOW = {f"{k}{s}": k for k in ("date", "localtime", "time", "localdatetime", "datetime") for s in ("", ".transaction", ".statement", ".realtime")}
#: A null argument makes these null whatever the others are.
_KEEPS_NULL = {"coalesce", "exists"}


def call(name: str, args: list[E], instant) -> E:
    if name in NOW and not args:
        return temporal.now(NOW[name], instant)
    if name in NOW and name not in FUNCTIONS:
        return NULL
    if name not in FUNCTIONS:
        raise SemanticError(f"there is no function {name}()")
    if name not in _KEEPS_NULL and any(a.family == "null" for a in args):
        return NULL
    try:
        return FUNCTIONS[name](*args)
    except TypeError as e:
        if "positional argument" in str(e):
            raise SemanticError(f"{name}() has another number of arguments") from None
        raise


__all__ = ["DURATION", "FUNCTIONS", "call", "make_list"]
