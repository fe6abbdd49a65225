"""Writing clauses: each computes new tables and leaves the old graph as it was.

New ids are pinned by a checkpoint before anything refers to them, so that a
lost executor doesn't number rows anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError, GraphError, SemanticError
from ..functions import operators as op
from ..functions.values import E, common, kind_of, to
from ..sources.graph import _union
from .iterate import cut


@dataclass
class Stats:
    nodes_created: int = 0
    nodes_deleted: int = 0
    relationships_created: int = 0
    relationships_deleted: int = 0
    properties_set: int = 0
    labels_added: int = 0
    labels_removed: int = 0


def number(c, df: DataFrame, names: list[str]) -> DataFrame:
    """Adds dense new ids, one column for each name, to a pinned frame."""
    pinned = cut(df.withColumn("_gl_at", F.monotonically_increasing_id()))
    part = F.shiftright("_gl_at", 33).cast("int")
    sizes = {r[0]: r[1] for r in pinned.groupBy(part.alias("p")).count().collect()}  # one row per partition
    base, starts = c.graph.next_id, []
    for p in sorted(sizes):
        starts.append((p, base))
        base += sizes[p] * len(names)
    c.graph = c.graph.with_(next_id=base)
    # one row a partition
    bases = F.broadcast(df.sparkSession.createDataFrame(starts, "_gl_part int, _gl_base long"))
    first = F.col("_gl_base") + (F.col("_gl_at").bitwiseAND((1 << 33) - 1)) * len(names)
    placed = pinned.withColumn("_gl_part", part).join(bases, "_gl_part")
    return placed.withColumns({n: (first + i).cast("long") for i, n in enumerate(names)}).drop("_gl_at", "_gl_part", "_gl_base")


def _add(c, table: str, key, new: DataFrame) -> None:
    tables = dict(getattr(c.graph, table))
    tables[key] = _union([tables[key], new]) if key in tables else new
    c.graph = c.graph.with_(**{table: tables})


def create(c, frame, patterns, stats: Stats | None = None):
    """CREATE: unbound nodes and all relationships of the patterns, once for each row."""
    stats = stats or c.stats
    made_nodes, made_rels, names = [], [], {}
    for p in patterns:
        ends = []
        for n in p.nodes:
            var = n.var or c.fresh("n")
            if var in frame.vars or var in names:
                if n.labels or n.props:
                    raise SemanticError(f"{var} is bound already")
            else:
                names[var] = c.fresh("new")
                made_nodes.append((var, n))
            ends.append(var)
        for i, r in enumerate(p.rels):
            if len(r.types) != 1 or r.way == "both" or r.hops:
                raise SemanticError("a new relationship needs one type and a direction")
            if r.var and (r.var in frame.vars or r.var in names):
                raise SemanticError(f"{r.var} is bound already")
            var = r.var or c.fresh("r")
            names[var] = c.fresh("new")
            a, b = (ends[i], ends[i + 1]) if r.way == "out" else (ends[i + 1], ends[i])
            made_rels.append((var, r, a, b))
    df = number(c, frame.df, list(names.values()))
    out = frame.bind(df)
    for var, n in made_nodes:
        props = [(k, c.ex(x, out.vars)) for k, x in n.props]
        df = out.df.withColumn(var, F.struct(F.col(names[var]).alias("_id"), F.array(*[F.lit(x) for x in n.labels]).cast("array<string>").alias("_labels"), *[v.col.alias(k) for k, v in props]))
        out = out.bind(df, **{var: (df.schema[var].dataType, "node")})
    for var, r, a, b in made_rels:
        props = [(k, c.ex(x, out.vars)) for k, x in r.props]
        end = lambda v: F.col(f"`{v}`")["_id"]
        df = out.df.withColumn(var, F.struct(F.col(names[var]).alias("_id"), end(a).alias("_src"), end(b).alias("_dst"), F.lit(r.types[0]).alias("_type"), *[v.col.alias(k) for k, v in props]))
        out = out.bind(df, **{var: (df.schema[var].dataType, "rel")})
    out = out.bind(cut(out.df.drop(*names.values())))
    n_rows = out.df.count()
    for var, n in made_nodes:
        _add(c, "nodes", tuple(sorted(n.labels)), out.df.select(f"`{var}`.*"))
        stats.nodes_created += n_rows
        stats.labels_added += n_rows * len(n.labels)
    known = dict(c.graph.ends)
    for var, r, _, _ in made_rels:
        if out.df.where(F.col(f"`{var}`")["_src"].isNull() | F.col(f"`{var}`")["_dst"].isNull()).limit(1).count():
            raise GraphError("a relationship needs both its nodes")
        _add(c, "rels", r.types[0], out.df.select(f"`{var}`.*"))
        known.pop(r.types[0], None)  # nothing is known of new ends
        stats.relationships_created += n_rows
    c.graph = c.graph.with_(ends=known)
    for label, prop in [k for k, unique in c.graph.indexes.items() if unique]:
        check_unique(c.graph, label, prop)
    return out


def check_unique(graph, label: str, prop: str) -> None:
    tables = [t.select(prop) for _, t in graph.node_tables([label]) if prop in t.columns]
    if tables and _union(tables).where(F.col(prop).isNotNull()).groupBy(prop).count().where("count > 1").limit(1).count():
        raise GraphError(f"two nodes :{label} have the same {prop}")


def merge(c, frame, body):
    """MERGE: rows with a match keep it; the missing distinct patterns are created once."""
    pattern, on_create, on_match = body
    if len(pattern.rels) > 1:
        raise SemanticError("MERGE takes one relationship at most")
    from ..plans.syntax import NodePattern, PathPattern, RelPattern, X

    rels = tuple(RelPattern(r.var or c.fresh("r"), r.types, r.props, r.way, r.hops) for r in pattern.rels)
    for r in rels:
        if len(r.types) != 1 or r.hops:
            raise SemanticError("MERGE needs one relationship type")
        if r.var in frame.vars:
            raise SemanticError(f"{r.var} is bound already")
    # values of the pattern's properties, once per row
    df, keys, scope = frame.df, [], dict(frame.vars)

    def fixed(part):
        nonlocal df
        out = []
        for k, x in part.props:
            e = c.ex(x, frame.vars)
            if e.family == "null":
                raise SemanticError("MERGE doesn't take null properties")
            name = c.fresh("m")
            df = df.withColumn(name, e.col)
            scope[name] = E(F.col(name), e.t, e.kind)
            keys.append(name)
            out.append((k, X("var", (name,))))
        return tuple(out)

    nodes = tuple(NodePattern(n.var or c.fresh("n"), n.labels, fixed(n)) for n in pattern.nodes)
    rels = tuple(RelPattern(r.var, r.types, fixed(r), r.way, r.hops) for r in rels)
    for n in nodes:
        if n.var in frame.vars:
            if n.labels or n.props:
                raise SemanticError(f"{n.var} is bound already")
            k = c.fresh("m")
            df = df.withColumn(k, F.col(f"`{n.var}`")["_id"])
            keys.append(k)
    if not keys:
        keys.append(k := c.fresh("m"))
        df = df.withColumn(k, F.lit(True))
    df = cut(df)
    if df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).limit(1).count():
        raise SemanticError("MERGE doesn't take null properties")
    rows = type(frame)(df, scope)
    p = PathPattern(None, nodes, rels)
    matched = c.match(rows, [p])
    matched = matched.bind(cut(matched.df))
    missing = df.join(matched.df.select(*keys).distinct(), keys, "left_anti")
    bound = [n.var for n in nodes if n.var in frame.vars]
    seeds = missing.dropDuplicates(keys).select(*keys, *[F.col(f"`{v}`") for v in bound])
    made = create(c, type(frame)(seeds, {v: scope[v] for v in [*[k for k in keys if k in scope], *bound]}), [PathPattern(None, tuple(NodePattern(n.var) if n.var in frame.vars else n for n in nodes), tuple(RelPattern(r.var, r.types, r.props, "out" if r.way == "both" else r.way) for r in rels))])
    new = [v for v in made.vars if v not in scope]
    created = missing.join(made.df.select(*keys, *[F.col(f"`{v}`") for v in new]), keys)
    frames = []
    for part, actions in ((matched.df, on_match), (created, on_create)):
        # both parts refer to whole, current nodes
        part = part.select(*[F.col(f"`{v}`") for v in frame.vars], *[F.col(f"`{v}`")["_id"].alias(f"{v}_id") for v in new])
        f = type(frame)(part, dict(frame.vars))
        frames.append((f, actions))
    ids = []
    for f, actions in frames:
        if actions:
            f = set(c, rebind(c, f, {v: f"{v}_id" for v in new}, nodes, rels), actions)
            f = type(frame)(f.df.select(*[F.col(f"`{v}`") for v in frame.vars], *[F.col(f"`{v}`")["_id"].alias(f"{v}_id") for v in new]), dict(frame.vars))
        ids.append(f.df)
    # a SET in one part may have changed what the other has read, so both are bound here
    both = type(frame)(_union(ids) if c.ending else cut(_union(ids)), dict(frame.vars))
    return rebind(c, both, {v: f"{v}_id" for v in new}, nodes, rels)


def tables_of(c, frame, var: str, kind: str) -> list:
    """Keys of the tables that hold some nodes or relationships, read from the rows themselves: one key a label set or type."""
    e = frame.vars[var]
    name = "_labels" if kind == "node" else "_type"
    store = c.graph.nodes if kind == "node" else c.graph.rels
    if name not in e.t.names:
        return list(store)
    col = e.col[name]
    found = frame.df.where(e.col["_id"].isNotNull()).select((F.sort_array(col) if kind == "node" else col).alias("k")).distinct().collect()
    wanted = {tuple(r["k"]) if kind == "node" else r["k"] for r in found}
    return [k for k in store if (tuple(sorted(k)) if kind == "node" else k) in wanted]


def rebind(c, frame, ids: dict[str, str], nodes, rels, only: dict | None = None):
    """Joins whole current nodes and relationships by id columns: from the tables that can have them, by pattern or as told by only."""
    is_rel, labels = {r.var: r for r in rels}, {n.var: n.labels for n in nodes}
    for v, col in ids.items():
        if v in is_rel:
            tables = dict(c.graph.rel_tables(is_rel[v].types))
        else:
            tables = dict(c.graph.node_tables(labels.get(v, ())))
        if only and only.get(v):
            tables = {k: t for k, t in tables.items() if k in only[v]}
        side = _union(list((tables or (c.graph.rels if v in is_rel else c.graph.nodes)).values()))
        key = c.fresh("id")
        side = side.select(F.col("_id").alias(key), F.struct(*side.columns).alias(v))
        df = frame.df.join(side, F.col(col) == F.col(key), "left_outer").drop(col, key)
        frame = frame.bind(df, **{v: (side.schema[v].dataType, "rel" if v in is_rel else "node")})
    return frame


def _targets(frame, base):
    if base.op != "var" or base.args[0] not in frame.vars or frame.vars[base.args[0]].kind not in ("node", "rel"):
        raise CypherTypeError("only nodes and relationships have properties to set")
    return base.args[0], frame.vars[base.args[0]].kind


def _update(c, frame, var: str, kind: str, values: dict[str, E], replace: bool = False, labels=None):
    """Rewrites the tables that hold some nodes or relationships; a later row of the frame wins over an earlier one by value."""
    ids = frame.df.where(F.col(f"`{var}`")["_id"].isNotNull()).select(F.col(f"`{var}`")["_id"].alias("_gl_id"), *[v.col.alias(f"_gl_{k}") for k, v in values.items()])
    one = cut(ids.groupBy("_gl_id").agg(F.max(F.struct(F.lit(1).alias("x"), *[F.col(f"_gl_{k}") for k in values])).alias("v")))
    n = one.count()
    store = "nodes" if kind == "node" else "rels"
    tables = dict(getattr(c.graph, store))
    for key in tables_of(c, frame, var, kind):
        t = tables[key]
        joined = t.join(one, F.col("_id") == F.col("_gl_id"), "left_outer")
        hit = F.col("_gl_id").isNotNull()
        cols = {}
        for k, v in values.items():
            new = F.col("v")[f"_gl_{k}"]
            old = F.col(k) if k in t.columns else F.lit(None).cast(v.t)
            if k in t.columns and t.schema[k].dataType != v.t and not isinstance(v.t, T.NullType):
                both = common(t.schema[k].dataType, v.t)
                new, old = to(E(new, v.t, kind_of(v.t)), both), to(E(old, t.schema[k].dataType, kind_of(t.schema[k].dataType)), both)
            elif isinstance(v.t, T.NullType):
                new = new.cast(t.schema[k].dataType if k in t.columns else "string")
                old = old if k in t.columns else old.cast("string")
            cols[k] = F.when(hit, new).otherwise(old)
        if replace:
            for k in t.columns:
                if not k.startswith("_") and k not in values:
                    cols[k] = F.when(~hit, F.col(k))
        if labels is not None:
            cols["_labels"] = F.when(hit, labels(F.col("_labels"))).otherwise(F.col("_labels"))
        changed = joined.withColumns(cols).drop("_gl_id", "v")
        if labels is None:
            tables[key] = cut(changed)
            continue
        # nodes move to the table of their new labels
        changed = cut(changed)
        del tables[key]
        for row in changed.select(F.sort_array("_labels").alias("l")).distinct().collect():  # as many rows as there are label sets
            own = tuple(row["l"])
            rows = changed.where(F.sort_array("_labels") == F.array(*[F.lit(x) for x in own]).cast("array<string>"))
            tables[own] = _union([tables[own], rows]) if own in tables else rows
    c.graph = c.graph.with_(**{store: tables})
    for (label, prop), unique in c.graph.indexes.items():
        if unique and prop in values:
            check_unique(c.graph, label, prop)
    return n


def _reread(c, frame, moved: str | None = None):
    """Rows with the current state of their nodes and relationships; one whose labels were changed may be in any table."""
    from ..plans.syntax import RelPattern

    only = {v: tables_of(c, frame, v, e.kind) for v, e in frame.vars.items() if e.kind in ("node", "rel")}
    if moved is not None:  # other names may stand for the same nodes
        only = {v: k for v, k in only.items() if frame.vars[v].kind == "rel"}
    ids = {v: f"_gl_{v}_id" for v, e in frame.vars.items() if e.kind in ("node", "rel")}
    rest = {v: e for v, e in frame.vars.items() if v not in ids}
    df = frame.df.select(*[F.col(f"`{v}`") for v in rest], *[F.col(f"`{v}`")["_id"].alias(i) for v, i in ids.items()])
    rels = [RelPattern(v) for v in ids if frame.vars[v].kind == "rel"]
    return rebind(c, type(frame)(cut(df), rest), ids, (), rels, only)


def set(c, frame, actions):  # noqa: A001
    """SET: properties, maps and labels; null removes a property; a null target is left alone."""
    actions, at = list(actions), 0
    while at < len(actions):
        a = actions[at]
        at += 1
        if a[0] == "labels":
            var, kind = _targets(frame, a[1])
            if kind != "node":
                raise CypherTypeError("a relationship has no labels")
            new = F.array(*[F.lit(x) for x in a[2]])
            c.stats.labels_added += _update(c, frame, var, kind, {}, labels=lambda l, new=new: F.array_union(l, new))
        elif a[0] == "prop":
            var, kind = _targets(frame, a[1])
            wide, x = c.lower(frame, a[3])
            values = {a[2]: c.ex(x, wide.vars)}
            # following constants for the same target go along: one join, one new table
            while at < len(actions) and (b := actions[at])[0] == "prop" and b[1] == a[1] and b[2] not in values and not any(y.op not in ("lit", "param", "neg", "list", "map") for y in b[3].walk()):
                values[b[2]] = c.ex(b[3], wide.vars)
                at += 1
            c.stats.properties_set += len(values) * _update(c, wide, var, kind, values)
        else:
            var, kind = _targets(frame, a[1])
            e = c.ex(a[2], frame.vars)
            if e.kind not in ("map", "node", "rel"):
                raise CypherTypeError("SET takes a map here")
            values = {f.name: E(e.col[f.name], f.dataType, kind_of(f.dataType)) for f in e.t if not f.name.startswith("_")}
            c.stats.properties_set += len(values) * _update(c, frame, var, kind, values, a[0] == "replace")
        if at < len(actions) or not c.ending:
            frame = _reread(c, frame, var if a[0] == "labels" else None)
    return frame


def remove(c, frame, items):
    for at, (what, base, names) in enumerate(items, 1):
        var, kind = _targets(frame, base)
        if what == "labels":
            gone = F.array(*[F.lit(x) for x in names])
            c.stats.labels_removed += _update(c, frame, var, kind, {}, labels=lambda l, gone=gone: F.array_except(l, gone))
        else:
            c.stats.properties_set += _update(c, frame, var, kind, {names: E(F.lit(None), T.NullType())})
        if at < len(items) or not c.ending:
            frame = _reread(c, frame, var if what == "labels" else None)
    return frame


def delete(c, frame, body):
    """DELETE: relationships first, then nodes, which must have none left unless detached."""
    targets, detach = body
    nodes, rels = [], []
    for x in targets:
        frame, x = c.lower(frame, x)
        e = c.ex(x, frame.vars)
        if e.family == "null":
            continue
        if e.kind == "node":
            nodes.append(frame.df.select(e.col["_id"].alias("_gl_id")))
        elif e.kind == "rel":
            rels.append(frame.df.select(e.col["_id"].alias("_gl_id")))
        elif e.kind == "path":
            nodes.append(frame.df.select(F.explode(e.col["nodes"]).alias("_gl_id")))
            rels.append(frame.df.select(F.explode(e.col["rels"]).alias("_gl_id")))
        else:
            raise CypherTypeError(f"a {e.family} can't be deleted")
    ids = lambda frames: cut(_union(frames).where("_gl_id IS NOT NULL").distinct()) if frames else None
    dead_rels, dead_nodes = ids(rels), ids(nodes)
    frame = frame.bind(cut(frame.df))

    def gone(store: dict, dead, on: tuple[str, ...]) -> dict:
        """key -> how many rows of a table refer to what is deleted; tables without any are left as they are."""
        return {k: n for k, t in store.items() if (n := reduce(lambda x, y: x.unionAll(y), [t.select(F.col(c_).alias("_gl_id")) for c_ in on]).join(dead, "_gl_id", "left_semi").count())}

    def without(t, dead, on: str):
        return t.join(dead.withColumnRenamed("_gl_id", "_gl_dead"), F.col(on) == F.col("_gl_dead"), "left_anti")

    new_nodes, new_rels, changed = dict(c.graph.nodes), dict(c.graph.rels), {}
    if dead_nodes is not None:
        hit = gone(new_nodes, dead_nodes, ("_id",))
        c.stats.nodes_deleted += sum(hit.values())
        for k in hit:
            new_nodes[k] = cut(without(new_nodes[k], dead_nodes, "_id"))
    if dead_rels is not None:
        for k, n in gone(new_rels, dead_rels, ("_id",)).items():
            changed[k] = without(new_rels[k], dead_rels, "_id")
            c.stats.relationships_deleted += n
    if dead_nodes is not None:
        # types whose ends can't have the labels of a deleted node aren't read
        may = lambda need: any(need <= frozenset(k) for k in hit)
        open_ = {k: changed.get(k, t) for k, t in new_rels.items() if k not in c.graph.ends or any(may(frozenset(e)) for e in c.graph.ends[k])}
        for k in gone(open_, dead_nodes, ("_src", "_dst")):
            if not detach:
                raise GraphError("a node that still has relationships can't be deleted")
            left = cut(without(without(open_[k], dead_nodes, "_src"), dead_nodes, "_dst"))
            c.stats.relationships_deleted += open_[k].count() - left.count()
            new_rels[k] = left
            changed.pop(k, None)
    new_rels |= {k: cut(t) for k, t in changed.items()}
    c.graph = c.graph.with_(rels=new_rels, nodes=new_nodes)
    return frame
