"""A graph as a folder of parquet tables, one for each label set and relationship type."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .graph import Graph


def save(graph: Graph, path: str) -> None:
    """Writes all tables; an existing folder is an error."""
    names = {"nodes": [], "rels": []}
    for i, (k, t) in enumerate(graph.nodes.items()):
        t.write.parquet(f"{path}/nodes/{i}")
        names["nodes"].append(list(k))
    for i, (k, t) in enumerate(graph.rels.items()):
        t.write.parquet(f"{path}/rels/{i}")
        names["rels"].append(k)
    meta = names | {"ends": {k: [sorted(a), sorted(b)] for k, (a, b) in graph.ends.items()}, "indexes": [[*k, u] for k, u in graph.indexes.items()], "next_id": graph.next_id}
    graph.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Graph:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = {tuple(k): spark.read.parquet(f"{path}/nodes/{i}") for i, k in enumerate(meta["nodes"])}
    rels = {k: spark.read.parquet(f"{path}/rels/{i}") for i, k in enumerate(meta["rels"])}
    return Graph(spark, nodes, rels, {k: (set(a), set(b)) for k, (a, b) in meta["ends"].items()}, {(a, b): u for a, b, u in meta["indexes"]}, meta["next_id"])
