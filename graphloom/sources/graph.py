"""A property graph as DataFrames, and its lifting from relational tables.

nodes: label set -> table (_id, _labels, properties); rels: type -> table
(_id, _src, _dst, _type, properties).  Tables are immutable; a change makes a
new graph that shares all others.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.values import E, common, kind_of, to

SPAN = 1 << 48
NODE_META, REL_META = ("_id", "_labels"), ("_id", "_src", "_dst", "_type")


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: dict = field(default_factory=dict)
    rels: dict = field(default_factory=dict)
    #: type -> (labels every source has, labels every target has), where known
    ends: dict = field(default_factory=dict)
    #: (label, property) -> unique, as declared; a hint and a check, not a structure
    indexes: dict = field(default_factory=dict)
    next_id: int = 1 << 60

    def node_tables(self, labels) -> list[tuple[tuple, DataFrame]]:
        want = set(labels)
        return [(k, t) for k, t in self.nodes.items() if want <= set(k)]

    def rel_tables(self, types) -> list[tuple[str, DataFrame]]:
        return [(k, t) for k, t in self.rels.items() if not types or k in types]

    def with_(self, **changes) -> "Graph":
        return replace(self, **changes)

    def labels(self) -> list[str]:
        return sorted({label for k in self.nodes for label in k})

    def property_keys(self) -> list[str]:
        return sorted({c for t in (*self.nodes.values(), *self.rels.values()) for c in t.columns if not c.startswith("_")})

    def check_integrity(self) -> DataFrame:
        """problem, id: relationships without an end, and ids that stand twice."""
        ids = _union([t.select("_id") for t in self.nodes.values()])
        ends = _union([t.select("_id", "_src", "_dst") for t in self.rels.values()])
        named = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("_id").alias("id"))
        lost = [named(ends.join(ids.select(F.col("_id").alias(c)), c, "left_anti"), f"dangling {c}") for c in ("_src", "_dst")]
        twice = ids.groupBy("_id").count().where("count > 1")
        return _union([*lost, named(twice, "duplicate id")])


def _union(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column of several types gets the one that holds them all."""
    types: dict = {}
    for f in frames:
        for x in f.schema:
            types[x.name] = common(types.get(x.name, T.NullType()), x.dataType)
    fitted = lambda f: f.select(*[to(E(F.col(f"`{x.name}`"), x.dataType, kind_of(x.dataType)), types[x.name]).alias(x.name) for x in f.schema])
    same = lambda f: all(x.dataType == types[x.name] for x in f.schema)
    out, *rest = [f if same(f) else fitted(f) for f in frames]
    for f in rest:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def node_table(df: DataFrame, labels: tuple[str, ...], key, props: dict) -> DataFrame:
    return df.select(key.alias("_id"), F.array(*[F.lit(x) for x in labels]).alias("_labels"), *[c.alias(n) for n, c in props.items()])


def rel_table(df: DataFrame, kind: str, key, src, dst, props: dict | None = None) -> DataFrame:
    return df.select(key.alias("_id"), src.alias("_src"), dst.alias("_dst"), F.lit(kind).alias("_type"), *[c.alias(n) for n, c in (props or {}).items()])


def _plain(df: DataFrame, prefix: str, skip: tuple[str, ...] = ()) -> dict:
    """Properties: columns without their prefix; whole numbers as 64-bit."""
    out = {}
    for name, kind in df.dtypes:
        if name not in skip:
            out[name.removeprefix(prefix)] = F.col(name).cast("long") if kind in ("int", "smallint", "tinyint") else F.col(name)
    return out


def lift(spark: SparkSession, sf_dir: str) -> Graph:
    """The test tables as one graph: projections only, except for the numbering of CONTAINS and NEXT inside one key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    order = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "User", "Event"]
    at = {n: i * SPAN for i, n in enumerate(order)}
    kinds = ["IN_REGION", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIES", "DID", "NEXT"]
    rid = {n: (16 + i) * SPAN for i, n in enumerate(kinds)}
    ref = lambda label, c: F.col(c).cast("long") + F.lit(at[label])
    rel = lambda kind, c: (F.col(c) if isinstance(c, str) else c).cast("long") + F.lit(rid[kind])
    region, nation, customer, supplier, part, orders, lines, events = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    nodes = {}
    for label, df, prefix, key in (("Region", region, "r_", "r_regionkey"), ("Nation", nation, "n_", "n_nationkey"), ("Customer", customer, "c_", "c_custkey"), ("Supplier", supplier, "s_", "s_suppkey"), ("Part", part, "p_", "p_partkey"), ("Order", orders, "o_", "o_orderkey"), ("Event", events, "", "event_id")):
        nodes[(label,)] = node_table(df, (label,), ref(label, key), _plain(df, prefix))
    nodes[("User",)] = node_table(events.select("user_id").distinct(), ("User",), ref("User", "user_id"), {"user_id": F.col("user_id")})
    numbered = lines.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    supplies = lines.select("l_suppkey", "l_partkey").distinct()
    following = events.withColumn("_next", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("_next IS NOT NULL")
    in_nation = customer.select(ref("Customer", "c_custkey").alias("s"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") * 2).alias("k")).unionByName(supplier.select(ref("Supplier", "s_suppkey").alias("s"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") * 2 + 1).alias("k")))
    rels = {
        "IN_REGION": rel_table(nation, "IN_REGION", rel("IN_REGION", "n_nationkey"), ref("Nation", "n_nationkey"), ref("Region", "n_regionkey")),
        "IN_NATION": rel_table(in_nation, "IN_NATION", rel("IN_NATION", "k"), F.col("s"), ref("Nation", "n")),
        "PLACED": rel_table(orders, "PLACED", rel("PLACED", "o_orderkey"), ref("Customer", "o_custkey"), ref("Order", "o_orderkey")),
        "CONTAINS": rel_table(numbered, "CONTAINS", rel("CONTAINS", F.col("l_orderkey") * 1024 + F.col("_n")), ref("Order", "l_orderkey"), ref("Part", "l_partkey"), {k: v for k, v in _plain(lines, "l_").items() if k not in ("orderkey", "partkey")}),
        "SUPPLIES": rel_table(supplies, "SUPPLIES", rel("SUPPLIES", F.col("l_suppkey") * (1 << 30) + F.col("l_partkey")), ref("Supplier", "l_suppkey"), ref("Part", "l_partkey")),
        "DID": rel_table(events, "DID", rel("DID", "event_id"), ref("User", "user_id"), ref("Event", "event_id")),
        "NEXT": rel_table(following, "NEXT", rel("NEXT", "event_id"), ref("Event", "event_id"), ref("Event", "_next")),
    }
    ends = {"IN_REGION": ({"Nation"}, {"Region"}), "IN_NATION": (set(), {"Nation"}), "PLACED": ({"Customer"}, {"Order"}), "CONTAINS": ({"Order"}, {"Part"}), "SUPPLIES": ({"Supplier"}, {"Part"}), "DID": ({"User"}, {"Event"}), "NEXT": ({"Event"}, {"Event"})}
    return Graph(spark, nodes, rels, ends)
