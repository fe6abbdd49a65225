"""Comparison, arithmetic and list operators with three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError
from .values import DURATION, E, MIXED, NULL, RANKS, common, float_text, kind_of, make_list, pack, to

_BOOL = T.BooleanType()


def truth(col: Column) -> E:
    return E(col, _BOOL)


def both_known(a: Column, b: Column, then: bool) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(then))


def equal(a: E, b: E) -> Column:
    fa, fb = a.family, b.family
    if "null" in (fa, fb):
        return F.lit(None).cast("boolean")
    if "mixed" in (fa, fb):
        if {fa, fb} - {"mixed", *RANKS}:
            return both_known(a.col, b.col, False)
        return _mixed(a, b, lambda x, y: x == y, F.lit(False))
    if {fa, fb} <= {"node", "rel"}:
        return a.col["_id"] == b.col["_id"] if fa == fb else both_known(a.col, b.col, False)
    if a.numeric and b.numeric:
        same = a.col == b.col
        nan = [x for x in (a, b) if x.family == "float" and x.literal is None]
        return same & ~F.isnan(nan[0].col) if len(nan) == 2 else same
    if fa != fb:
        return both_known(a.col, b.col, False)
    if fa in CLOCKS:
        return instant(a) == instant(b)
    if fa == "list":
        if isinstance(a.t.elementType, T.NullType) or isinstance(b.t.elementType, T.NullType):
            return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).when(F.size(a.col) == 0, F.lit(True))
        each = F.zip_with(a.col, b.col, lambda x, y: equal(a.item(x), b.item(y)))
        return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(F.forall(each, lambda x: x))
    if fa == "map" and isinstance(a.t, T.StructType) and isinstance(b.t, T.StructType):
        if set(a.t.names) != set(b.t.names):
            return both_known(a.col, b.col, False)
        out = F.lit(True)
        for f in a.t:
            out = out & equal(prop(a, f.name), prop(b, f.name))
        return out
    return a.col == b.col


def _mixed(a: E, b: E, test, other: Column) -> Column:
    """test() on the values of mixed ones if both are of one type; NaN passes none."""
    x, y = pack(a), pack(b)
    ints = x["mixed_int"].isNotNull() & y["mixed_int"].isNotNull()
    numbers = test(x["mixed_number"], y["mixed_number"]) & ~F.isnan(x["mixed_number"]) & ~F.isnan(y["mixed_number"])
    same = F.when(x["mixed_rank"] == 1, test(x["mixed_text"], y["mixed_text"])).when(ints, test(x["mixed_int"], y["mixed_int"])).otherwise(numbers)
    return F.when(x["mixed_rank"].isNotNull() & y["mixed_rank"].isNotNull(), F.when(x["mixed_rank"] == y["mixed_rank"], same).otherwise(other))


def compare(op: str, a: E, b: E) -> E:
    if op == "=":
        return truth(equal(a, b))
    if op == "<>":
        return truth(~equal(a, b))
    if a.family in ("node", "rel", "path") or b.family in ("node", "rel", "path"):
        raise CypherTypeError("nodes, relationships and paths have no order")
    if "mixed" in (a.family, b.family) and not {a.family, b.family} - {"mixed", *RANKS}:
        test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        return truth(_mixed(a, b, test, F.lit(None).cast("boolean")))
    same = a.numeric and b.numeric or a.family == b.family and a.family in ("string", "bool", "date", "localdatetime", "datetime", "list")
    if a.family == b.family and a.family in CLOCKS:
        a, b, same = E(instant(a), T.LongType()), E(instant(b), T.LongType()), True
    if not same:
        return truth(F.lit(None).cast("boolean"))
    col = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    # NaN stands above all numbers for Spark, and compares with none here
    for e, above in ((a, op in (">", ">=")), (b, op in ("<", "<="))):
        if e.family == "float" and e.literal is None and above:
            col = col & ~F.isnan(e.col)
    return truth(col)


CLOCKS = ("localtime", "time", "zoned")


def instant(e: E) -> Column:
    """What times of one kind are compared by."""
    if e.family == "localtime":
        return e.col["localtime_nanos"]
    if e.family == "time":
        return e.col["time_nanos"] - e.col["time_offset"].cast("long") * 1000000000
    return F.unix_micros(e.col["utc"].cast("timestamp"))


def add_duration(a: E, d: Column, sign: int) -> E:
    if a.family in CLOCKS:
        from . import temporal

        return temporal.add_to_clock(a, d, sign)
    if a.family == "date":
        months, days = sign * d["months"], sign * (d["days"] + F.call_function("div", d["seconds"], F.lit(86400)))
        return E(F.date_add(F.add_months(a.col, months.cast("int")), days.cast("int")), a.t)
    if a.family in ("localdatetime", "datetime"):
        step = F.make_interval(F.lit(0), (sign * d["months"]).cast("int"), F.lit(0), (sign * d["days"]).cast("int"), F.lit(0), F.lit(0), (sign * (d["seconds"] + d["nanos"] / 1e9)).cast("decimal(18,6)"))
        return E(a.col + step, a.t)
    raise CypherTypeError(f"a duration can't be added to a {a.family}")


def duration_sum(a: Column, b: Column, sign: int) -> E:
    return E(F.struct(*[(a[n] + sign * b[n]).alias(n) for n in DURATION.names]), DURATION, "duration")


def arith(op: str, a: E, b: E) -> E:
    fa, fb = a.family, b.family
    if "null" in (fa, fb):
        return NULL
    if op == "+":
        if fa == "list" and fb == "list":
            t = common(a.t, b.t)
            return E(F.concat(to(a, t), to(b, t)), t)
        if fa == "list":
            t = common(a.t.elementType, b.t)
            return E(F.array_append(to(a, T.ArrayType(t)), to(b, t)), T.ArrayType(t))
        if fb == "list":
            t = common(b.t.elementType, a.t)
            return E(F.array_prepend(to(b, T.ArrayType(t)), to(a, t)), T.ArrayType(t))
        if "string" in (fa, fb):
            shown = lambda e: mixed_text(e) if e.family == "mixed" else float_text(e.col) if e.family == "float" else e.col.cast("string")
            return E(F.concat(shown(a), shown(b)), T.StringType())
    if "mixed" in (fa, fb) and not {fa, fb} - {"mixed", *RANKS}:
        return _mixed_arith(op, a, b)
    if op in "+-" and fb == "duration":
        if fa == "duration":
            return duration_sum(a.col, b.col, 1 if op == "+" else -1)
        return add_duration(a, b.col, 1 if op == "+" else -1)
    if op == "+" and fa == "duration":
        return add_duration(b, a.col, 1)
    if op in "*/" and fa == "duration" and b.numeric:
        k = b.col.cast("double") if op == "*" else F.lit(1.0) / b.col.cast("double")
        return scale(a.col, k)
    if not (a.numeric and b.numeric):
        raise CypherTypeError(f"{fa} {op} {fb}")
    if op == "^":
        return E(F.pow(a.col.cast("double"), b.col.cast("double")), T.DoubleType())
    if fa == fb == "int":
        x, y = a.col.cast("long"), b.col.cast("long")
        return E({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.call_function("div", x, y), "%": lambda: x % y}[op](), T.LongType())
    x, y = a.col.cast("double"), b.col.cast("double")
    if op in "/%" and not (b.literal is not None and b.literal != 0):
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        zero = F.when(F.isnan(x) | (x == 0) | (F.lit(op) == "%"), nan).when(x > 0, inf).otherwise(-inf)
        return E(F.when(y == 0, zero).otherwise(x / F.nullif(y, F.lit(0.0)) if op == "/" else x % F.nullif(y, F.lit(0.0))), T.DoubleType())
    return E({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[op](), T.DoubleType())


def mixed_text(e: E) -> Column:
    x = e.col
    number = F.coalesce(x["mixed_int"].cast("string"), float_text(x["mixed_number"]))
    return F.when(x["mixed_rank"] == 2, (x["mixed_number"] != 0).cast("string")).when(x["mixed_rank"] == 3, number).otherwise(x["mixed_text"])


def _mixed_arith(op: str, a: E, b: E) -> E:
    """Numbers as ever, whole ones stay whole; + joins texts; anything else is an error when it is met."""
    x, y = E(pack(a), MIXED, "mixed"), E(pack(b), MIXED, "mixed")
    ints = (x.col["mixed_rank"] == 3) & (y.col["mixed_rank"] == 3) & x.col["mixed_int"].isNotNull() & y.col["mixed_int"].isNotNull()
    part = lambda e, name, t, when: E(F.when(when, e.col[name]), t)
    whole = pack(arith(op, part(x, "mixed_int", T.LongType(), ints), part(y, "mixed_int", T.LongType(), ints)))
    numbers = (x.col["mixed_rank"] == 3) & (y.col["mixed_rank"] == 3)
    real = pack(arith(op, part(x, "mixed_number", T.DoubleType(), numbers), part(y, "mixed_number", T.DoubleType(), numbers)))
    out = F.when(x.col.isNull() | y.col.isNull(), F.lit(None).cast(MIXED)).when(ints, whole).when(numbers, real)
    if op == "+":
        out = out.when((x.col["mixed_rank"] == 1) | (y.col["mixed_rank"] == 1), pack(E(F.concat(mixed_text(x), mixed_text(y)), T.StringType())))
    return E(out.otherwise(F.raise_error(F.lit(f"values of these types have no {op}")).cast(MIXED)), MIXED, "mixed")


def scale(d: Column, k: Column) -> E:
    """A duration times a number; fractions go down to the next unit (a month is 30.436875 days)."""
    from .temporal import let

    def scaled(x: Column) -> Column:
        d, k = x["d"], x["k"]
        months = d["months"] * k
        whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
        days = d["days"] * k + (months - whole) * 30.436875
        whole_days = F.when(days < 0, F.ceil(days)).otherwise(F.floor(days))
        seconds = (d["seconds"] + d["nanos"] / 1e9) * k + (days - whole_days) * 86400
        floor = F.floor(seconds)
        return F.struct(whole.cast("long").alias("months"), whole_days.cast("long").alias("days"), floor.cast("long").alias("seconds"), F.round((seconds - floor) * 1e9).cast("long").alias("nanos"))

    return E(let(F.struct(d.alias("d"), k.alias("k")), scaled), DURATION, "duration")


def contains(x: E, l: E) -> E:
    if l.family == "null":
        return truth(F.lit(None).cast("boolean"))
    if l.family != "list":
        raise CypherTypeError("IN needs a list")
    if isinstance(l.t.elementType, T.NullType):
        return truth(F.when(F.size(l.col) == 0, F.lit(False)))
    if isinstance(l.literal, list) and l.literal and x.family in ("int", "float", "string") and all(isinstance(v, str if x.family == "string" else (int, float)) and not isinstance(v, bool) for v in l.literal):
        return truth(x.col.isin(l.literal))  # reaches the scan
    return truth(F.when(F.size(l.col) == 0, F.lit(False)).otherwise(F.exists(l.col, lambda y: equal(x, l.item(y)))))


def index(l: E, i: E) -> E:
    if "null" in (l.family, i.family):
        return NULL
    if l.family == "list":
        n = i.col.cast("int")
        return l.item(F.get(l.col, F.when(n < 0, F.size(l.col) + n).otherwise(n)))
    if i.literal is not None and isinstance(i.literal, str):
        return prop(l, i.literal)
    if isinstance(l.t, T.StructType):
        fields = [f for f in l.t if not f.name.startswith("_")]
        t = T.NullType()
        for f in fields:
            t = common(t, f.dataType)
        out = F.lit(None)
        for f in fields:
            out = F.when(i.col == f.name, to(prop(l, f.name), t)).otherwise(out)
        return E(out, t, kind_of(t))
    raise CypherTypeError(f"{l.family}[{i.family}]")


def prop(base: E, key: str) -> E:
    from .temporal import component

    if base.family == "null":
        return NULL
    if base.family in ("date", "localdatetime", "datetime", "duration", *CLOCKS):
        return component(base, key)
    if isinstance(base.t, T.StructType):
        if key in base.t.names and not key.startswith("_"):
            t = base.t[key].dataType
            return E(base.col[key], t, kind_of(t))
        return NULL
    raise CypherTypeError(f"a {base.family} has no properties")


def slice_(l: E, a: E | None, b: E | None) -> E:
    if l.family == "null" or (a and a.family == "null") or (b and b.family == "null"):
        return NULL
    n = F.size(l.col)

    def bound(e: E | None, default: Column) -> Column:
        if e is None:
            return default
        i = e.col.cast("int")
        return F.least(F.greatest(F.when(i < 0, n + i).otherwise(i), F.lit(0)), n)

    lo, hi = bound(a, F.lit(0)), bound(b, n)
    return E(F.slice(l.col, lo + 1, F.greatest(hi - lo, F.lit(0))), l.t)


__all__ = ["add_duration", "arith", "compare", "contains", "equal", "index", "make_list", "prop", "slice_", "truth"]
