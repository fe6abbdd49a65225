"""Loops over DataFrames: reliable cuts of the lineage, and shortest paths."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import PATH


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the folder that all executors share (spark.checkpoint.dir); a local session may lack it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(found)
    return df.checkpoint(eager=True)


def shortest_paths(pairs: DataFrame, start: str, end: str, edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """start, end and one shortest path of each pair that has one; most None: however long.

    Breadth first for all pairs at once, until all ends are met or nothing new is
    reached.  A row is (start, node) with the node before it and the relationship
    between; of several ways to a node the one with the smallest relationship id
    stays.  Searches share their start, so that a start with many ends is walked
    once; only starts with an open end go on.  Paths are put together backwards
    at the end, for the pairs asked alone.
    """
    goals = cut(pairs.select(F.col(start).alias("s"), F.col(end).alias("e")).where("s IS NOT NULL AND e IS NOT NULL").distinct())
    none = F.array().cast("array<bigint>")
    open_goals = goals.where("s <> e") if least == 0 else goals
    seen = level = cut(open_goals.select("s").distinct().select("s", F.col("s").alias("at")))
    steps, hits = [], []  # by depth: the rows reached, the pairs met
    while (most is None or len(steps) < most) and not level.isEmpty():
        step = level.join(edges, F.col("at") == F.col("_from")).select("s", F.col("_to").alias("to"), F.col("at").alias("before"), F.col("_edge").alias("edge"))
        best = cut(step.groupBy("s", "to").agg(F.min(F.struct("edge", "before")).alias("p")).select("s", F.col("to").alias("at"), "p.before", "p.edge"))
        steps.append(best)
        hit = open_goals.join(best.select("s", F.col("at").alias("e")), ["s", "e"], "left_semi")
        hits.append(hit)
        open_goals = cut(open_goals.join(best.select("s", F.col("at").alias("e")), ["s", "e"], "left_anti"))
        fresh = best.select("s", "at").join(seen, ["s", "at"], "left_anti")
        level = cut(fresh.join(open_goals.select("s").distinct(), "s", "left_semi"))
        seen = seen.unionByName(level)
        if len(steps) % 16 == 0:
            seen = cut(seen)
    begin = lambda rows: rows.select("s", "e", F.col("e").alias("at"), F.array("e").alias("nodes"), none.alias("rels"))
    paths = None
    for depth in range(len(steps), 0, -1):
        here = begin(hits[depth - 1])
        paths = here if paths is None else paths.unionByName(here)
        back = paths.join(steps[depth - 1], ["s", "at"])
        paths = back.select("s", "e", F.col("before").alias("at"), F.array_prepend("nodes", F.col("before")).alias("nodes"), F.array_prepend("rels", F.col("edge")).alias("rels"))
        if depth % 8 == 1 and depth > 1:
            paths = cut(paths)
    here = goals.where("s = e") if least == 0 else goals.limit(0)
    here = begin(here).drop("at")
    out = here if paths is None else here.unionByName(paths.drop("at"))
    return out.select(F.col("s").alias(start), F.col("e").alias(end), F.struct("nodes", "rels").cast(PATH).alias("path"))
