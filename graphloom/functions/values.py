"""Typed expressions: a Column, its Spark type, and what it stands for."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError

DURATION = T.StructType([T.StructField("months", T.LongType()), T.StructField("days", T.LongType()), T.StructField("seconds", T.LongType()), T.StructField("nanos", T.LongType())])
LOCALTIME = T.StructType([T.StructField("localtime_nanos", T.LongType())])
TIME = T.StructType([T.StructField("time_nanos", T.LongType()), T.StructField("time_offset", T.IntegerType())])
ZONED = T.StructType([T.StructField("utc", T.TimestampNTZType()), T.StructField("utc_offset", T.IntegerType()), T.StructField("zone", T.StringType())])
#: A string, boolean, number or instant where one column holds several of these: its place in the order of types, then its
#: value. An instant is a whole number (days, nanoseconds or microseconds) and its text.
MIXED = T.StructType([T.StructField("mixed_rank", T.IntegerType()), T.StructField("mixed_number", T.DoubleType()), T.StructField("mixed_int", T.LongType()), T.StructField("mixed_text", T.StringType())])
#: Kinds whose values may differ in their fields.
RECORDS = ("map", "node", "rel")
RANKS = {"string": 1, "bool": 2, "int": 3, "float": 3, "date": 4, "localtime": 5, "time": 6, "localdatetime": 7, "zoned": 8}
PATH = T.StructType([T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("rels", T.ArrayType(T.LongType()))])


@dataclass(frozen=True)
class E:
    col: Column
    t: T.DataType
    kind: str = "value"  # value, node, rel, path, map, mixed, duration, localtime, time, zoned
    literal: Any = None

    @property
    def family(self) -> str:
        if self.kind != "value":
            return self.kind
        t = self.t
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return "int"
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            return "float"
        for cls, name in ((T.StringType, "string"), (T.BooleanType, "bool"), (T.DateType, "date"), (T.TimestampNTZType, "localdatetime"), (T.TimestampType, "datetime"), (T.ArrayType, "list"), (T.MapType, "map"), (T.StructType, "map")):
            if isinstance(t, cls):
                return name
        return "other"

    @property
    def numeric(self) -> bool:
        return self.family in ("int", "float")

    def item(self, col: Column) -> "E":
        """An element of this list."""
        t = self.t.elementType if isinstance(self.t, T.ArrayType) else T.NullType()
        return E(col, t, kind_of(t))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StructType):
        names = t.names
        for known, kind in ((DURATION, "duration"), (LOCALTIME, "localtime"), (TIME, "time"), (ZONED, "zoned"), (MIXED, "mixed")):
            if names == known.names:
                return kind
        if names[:2] == ["nodes", "rels"] and len(names) == 2:
            return "path"
        if "_src" in names:
            return "rel"
        if "_id" in names:
            return "node"
        return "map"
    return "value"


class _Null(E):
    """The null literal; its column is made when it is used, since that needs a session."""

    def __init__(self):
        for name, value in (("t", T.NullType()), ("kind", "value"), ("literal", None)):
            object.__setattr__(self, name, value)

    @property
    def col(self) -> Column:
        return F.lit(None)


NULL = _Null()


def lit(v: Any) -> E:
    """A Python value (also a list or dict) as a literal."""
    if v is None:
        return NULL
    if isinstance(v, bool):
        return E(F.lit(v), T.BooleanType(), literal=v)
    if isinstance(v, int):
        if not -(2**63) <= v < 2**63:
            raise CypherTypeError(f"{v} is out of range")
        return E(F.lit(v).cast("long"), T.LongType(), literal=v)
    if isinstance(v, float):
        return E(F.lit(v), T.DoubleType(), literal=v)
    if isinstance(v, str):
        return E(F.lit(v), T.StringType(), literal=v)
    if isinstance(v, (list, tuple)):
        return make_list([lit(x) for x in v])
    if isinstance(v, dict):
        return make_map([(k, lit(x)) for k, x in v.items()])
    import datetime as dt

    if isinstance(v, dt.datetime):
        return E(F.lit(v.replace(tzinfo=None)).cast("timestamp_ntz"), T.TimestampNTZType(), literal=v)
    if isinstance(v, dt.date):
        return E(F.lit(v), T.DateType(), literal=v)
    raise CypherTypeError(f"a parameter can't be a {type(v).__name__}")


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both, or an error."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    nums = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
    if isinstance(a, nums) and isinstance(b, nums):
        return T.DoubleType() if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)) else T.LongType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common(a.elementType, b.elementType))
    if _mixable(a) and _mixable(b):
        return MIXED
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and (a.names == b.names or kind_of(a) == kind_of(b) in RECORDS):
        # what one of them lacks is null there
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        of = lambda t, n: t[n].dataType if n in t.names else T.NullType()
        return T.StructType([T.StructField(n, common(of(a, n), of(b, n))) for n in names])
    raise CypherTypeError(f"values of {a.simpleString()} and {b.simpleString()} can't share a column")


def _mixable(t: T.DataType) -> bool:
    return E(None, t, kind_of(t)).family in (*RANKS, "mixed")


def pack(e: E) -> Column:
    """A string, boolean, number or instant as a mixed value."""
    if e.family == "mixed":
        return e.col
    if e.family == "null":
        return F.lit(None).cast(MIXED)
    if e.family not in RANKS:
        raise CypherTypeError(f"a {e.family} can't share a column with other types")
    number = e.col.cast("double") if RANKS[e.family] in (2, 3) else F.lit(None).cast("double")
    whole = e.col.cast("long") if e.family == "int" else _place(e) if RANKS[e.family] > 3 else F.lit(None).cast("long")
    words = e.col if e.family == "string" else _words(e) if RANKS[e.family] > 3 else F.lit(None).cast("string")
    return F.when(e.col.isNotNull(), F.struct(F.lit(RANKS[e.family]).alias("mixed_rank"), number.alias("mixed_number"), whole.alias("mixed_int"), words.alias("mixed_text")))


def _place(e: E) -> Column:
    """What instants of one type are ordered by."""
    c = e.col
    if e.family == "date":
        return F.unix_date(c).cast("long")
    if e.family == "localtime":
        return c["localtime_nanos"]
    if e.family == "time":
        return c["time_nanos"] - c["time_offset"].cast("long") * 10**9
    return F.unix_micros((c["utc"] if e.family == "zoned" else c).cast("timestamp"))


def _words(e: E) -> Column:
    from . import temporal

    return temporal.text(e)


def mixed_string(col: Column) -> Column:
    """The string in a mixed value; null for other types."""
    return F.when(col["mixed_rank"] == 1, col["mixed_text"])


def plain(col: Column, t: T.DataType) -> tuple[Column, bool]:
    """A column for the outside, with its mixed values as variants; and whether there were any."""
    if kind_of(t) == "mixed":
        number = F.coalesce(col["mixed_int"].cast("variant"), col["mixed_number"].cast("variant"))
        local = F.timestamp_micros(col["mixed_int"]).cast("timestamp_ntz")
        instant = {RANKS["date"]: F.date_from_unix_date(col["mixed_int"].cast("int")), RANKS["localdatetime"]: local}
        out = F.when(col["mixed_rank"] == 2, (col["mixed_number"] != 0).cast("variant")).when(col["mixed_rank"] == 3, number)
        for rank, value in instant.items():
            out = out.when(col["mixed_rank"] == rank, value.cast("variant"))
        return out.otherwise(col["mixed_text"].cast("variant")), True
    if isinstance(t, T.ArrayType) and plain(col, t.elementType)[1]:
        return F.transform(col, lambda x: plain(x, t.elementType)[0]), True
    if isinstance(t, T.StructType):
        parts = [(f.name, *plain(col[f.name], f.dataType)) for f in t]
        if any(p[2] for p in parts):
            return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c, _ in parts])), True
    return col, False


def float_text(c: Column) -> Column:
    """A float in digits: no exponent, and no fraction where there is none."""
    s = F.abs(c).cast("string")
    digits, e = F.regexp_replace(s, r"\.|E.*$", ""), F.coalesce(F.nullif(F.regexp_extract(s, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    large = F.when(F.length(digits) <= e + 1, F.rpad(digits, e + 1, "0")).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.rtrim(digits, F.lit("0")))
    plain_ = F.when(e > 0, large).when(e < 0, small).otherwise(s)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(plain_, r"\.0+$", ""))


def sort_key(c: Column, t: T.DataType) -> Column:
    """What a column is sorted by: nulls inside lists come last, as they do outside."""
    if not isinstance(t, T.ArrayType) or isinstance(t.elementType, T.NullType):
        return c
    return F.transform(c, lambda x: F.struct(x.isNull().alias("n"), sort_key(x, t.elementType).alias("v")))


def to(e: E, t: T.DataType) -> Column:
    """e as a value of a type that common() gave."""
    if e.t == t:
        return e.col
    if isinstance(e.t, T.NullType):
        return e.col.cast(t)
    if kind_of(t) == "mixed":
        return pack(e)
    if isinstance(t, T.ArrayType) and isinstance(e.t, T.ArrayType) and not isinstance(e.t.elementType, T.NullType):
        return F.transform(e.col, lambda x: to(e.item(x), t.elementType))
    if isinstance(t, T.StructType) and isinstance(e.t, T.StructType) and kind_of(t) in RECORDS:
        of = lambda f: to(E(e.col[f.name], e.t[f.name].dataType, kind_of(e.t[f.name].dataType)), f.dataType) if f.name in e.t.names else F.lit(None).cast(f.dataType)
        return F.when(e.col.isNotNull(), F.struct(*[of(f).alias(f.name) for f in t]))
    return e.col.cast(t)


def make_list(items: list[E]) -> E:
    t: T.DataType = T.NullType()
    for i in items:
        t = common(t, i.t)
    if not items:
        return E(F.array().cast("array<string>"), T.ArrayType(T.NullType()), literal=[])
    return E(F.array(*[to(i, t) for i in items]), T.ArrayType(t), literal=[i.literal for i in items] if all(i.literal is not None for i in items) else None)


def make_map(pairs: list[tuple[str, E]]) -> E:
    if not pairs:
        return E(F.struct(F.lit(None).alias("_empty")), T.StructType([T.StructField("_empty", T.NullType())]), "map")
    return E(F.struct(*[v.col.alias(k) for k, v in pairs]), T.StructType([T.StructField(k, v.t) for k, v in pairs]), "map")
