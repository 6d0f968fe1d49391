"""Dependency graphs: edges, components, elementary cycles, their scores, and whether a change breaks a cycle.

A graph is a DataFrame of edges ``(key, src, dst)``; ``key`` tells independent graphs apart. Everything relational is
declared; only the enumeration of cycles runs as a function, on one strongly connected component at a time. Components
of a graph that fits no task are found by label propagation (:func:`components_distributed`).

Edges with a null end, and rows without a key, are no edges. Repeated edges count once unless a docstring says otherwise.
"""

from __future__ import annotations

import fnmatch
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir

#: Weights of the impact score and thresholds of severity; fixed values.
CENTRALITY, EDGE, LAYERS, KNOWN, OVERLAP, OVERLAP_CAP = 2.0, 0.5, 10.0, 10.0, 0.5, 5.0
CRITICAL, MAJOR = 15.0, 8.0
#: Cycles that leave a task at a time.
FRAME = 10_000


# ------------------------------------------------------------------------------------------------ edges and adjacency
def job_edges(jobs: DataFrame) -> DataFrame:
    """``(cycle_id, project, pos, src, dst)`` of graph structs with ``edges`` as arrays; pairs shorter than two are skipped."""
    e = jobs.select("cycle_id", "project", F.posexplode("graph.edges").alias("pos", "_e")).where(F.size("_e") >= 2)
    return e.select("cycle_id", "project", "pos", F.col("_e")[0].alias("src"), F.col("_e")[1].alias("dst"))


def adjacency(edges: DataFrame, key: str) -> DataFrame:
    """``(key, src, targets)``: the sorted distinct targets of each node that has one."""
    return distinct_edges(edges, key).groupBy(key, "src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def distinct_edges(edges: DataFrame, key: str) -> DataFrame:
    return edges.select(key, "src", "dst").where(F.col(key).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def nodes(edges: DataFrame, key: str) -> DataFrame:
    """``(key, node)``: all ends of edges, once."""
    e = distinct_edges(edges, key)
    return e.select(key, F.col("src").alias("node")).union(e.select(key, F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame, key: str, *, distinct: bool = False) -> DataFrame:
    """``(key, node, in_degree, out_degree)``; repeated edges count each time unless ``distinct``. One shuffle: every
    edge gives a row to either end."""
    e = distinct_edges(edges, key) if distinct else edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    ends = e.select(key, F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("_in"), F.lit(1).alias("_out")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("_in"), F.lit(0).alias("_out")))))
    return ends.groupBy(key, "node").agg(F.sum("_in").alias("in_degree"), F.sum("_out").alias("out_degree"))


def edge_weights(imports: DataFrame, key: str, symbols: str | None = None) -> DataFrame:
    """``(key, src, dst, weight)``: each import counts as many symbols as it names, at least 1."""
    one = F.greatest(F.coalesce(F.size(symbols), F.lit(0)), F.lit(1)) if symbols else F.lit(1)
    return imports.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy(key, "src", "dst").agg(F.sum(one).cast("double").alias("weight"))


def ignored(node: Column, modules: list[str], patterns: list[str]) -> Column:
    """Whether a node, its last path part, or that without extension is listed, or matches a shell pattern (either case)."""
    base = F.regexp_extract(node, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(.)\.[^.]*$", "$1")
    hit = F.lit(False)
    for c in (node, base, stem):
        if modules:
            hit = hit | c.isin(modules)
        for p in patterns:
            hit = hit | c.rlike(fnmatch.translate(p).replace(r"\Z", r"\z")) | F.lower(c).rlike(fnmatch.translate(p.lower()).replace(r"\Z", r"\z"))
    return F.coalesce(hit, F.lit(False))


def drop_ignored(edges: DataFrame, modules: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Edges neither end of which is ignored."""
    return edges.where(~ignored(F.col("src"), list(modules), list(patterns)) & ~ignored(F.col("dst"), list(modules), list(patterns)))


def drop_listed(edges: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Edges that aren't in ``listed`` (``key, src, dst``), such as type-only imports."""
    return edges.join(listed.select(key, "src", "dst").distinct(), [key, "src", "dst"], "left_anti")


# ------------------------------------------------------------------------------------------------------- components
def _tarjan(graph: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, without recursion."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    out: list[list[str]] = []
    for root in sorted(graph):
        if root in order:
            continue
        work: list[tuple[str, Iterator[str]]] = []
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        work.append((root, iter(graph[root])))
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    held.add(nxt)
                    work.append((nxt, iter(graph[nxt])))
                    break
                if nxt in held:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        held.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    out.append(part)
    return out


def _graph(edges) -> dict[str, list[str]]:
    g: dict[str, list[str]] = {}
    for s, d in sorted({(e["src"], e["dst"]) for e in edges}):
        g.setdefault(s, []).append(d)
        g.setdefault(d, [])
    return g


def _gathered(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row per graph with its distinct edges, so that many small graphs share an Arrow batch."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col(keys[0]).isNotNull())
    return e.groupBy(*keys).agg(F.collect_set(F.struct("src", "dst")).alias("_edges"))


def components(edges: DataFrame, key: str) -> DataFrame:
    """``(key, node, component, size)`` for graphs of which each fits a task; the label is the component's least node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, min(part), len(part)) for k, e in zip(pdf[key], pdf["_edges"], strict=True) for part in _tarjan(_graph(e)) for n in part]
            yield pd.DataFrame(rows, columns=[key, "node", "component", "size"])

    kind = edges.schema[key].dataType.simpleString()
    return _gathered(edges, [key]).mapInPandas(run, f"{key} {kind}, node string, component string, size int")


def components_distributed(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(node, component)`` of one graph of any size, by trimming and forward-backward colouring.

    Nodes without an edge to or from what is left are components by themselves and are taken off until none is left, so
    that paths and trees never reach the colouring. Then in each round the least label travels along the edges until
    nothing changes; the nodes of a colour that also reach its root backwards are a component and leave the graph. Every
    step is a join and an aggregation of one row a node; the lineage is cut in the shared folder, so a lost executor costs
    one step. More than ``max_rounds`` rounds of any of these raise an error.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    left = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct().checkpoint()
    e = e.where("src <> dst").checkpoint()
    done: DataFrame | None = None

    def rounds() -> Iterator[int]:
        yield from range(max_rounds)
        raise RuntimeError(f"no components after {max_rounds} rounds")

    def between(e: DataFrame, nodes: DataFrame) -> DataFrame:
        return e.join(nodes, e["src"] == nodes["node"], "left_semi").join(nodes, F.col("dst") == nodes["node"], "left_semi").checkpoint()

    def spread(start: DataFrame, edge: DataFrame, a: str, b: str) -> DataFrame:
        """The least label that reaches each node along ``a`` to ``b``."""
        now = start.checkpoint()
        for _ in rounds():
            sent = edge.join(now, edge[a] == now["node"]).select(edge[b].alias("node"), "label")
            new = now.union(sent).groupBy("node").agg(F.min("label").alias("label")).checkpoint()
            changed = new.join(now.withColumnRenamed("label", "_old"), "node").where("label <> _old").limit(1).count()
            now = new
            if not changed:
                return now

    for _ in rounds():
        for _ in rounds():
            both = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").checkpoint()
            off = left.join(both, "node", "left_anti").checkpoint()
            if not off.limit(1).count():
                break
            part = off.select("node", F.col("node").alias("component"))
            done = (part if done is None else done.unionByName(part)).checkpoint()
            left, e = both, between(e, both)
        if not left.limit(1).count():
            break
        colour = spread(left.select("node", F.col("node").alias("label")), e, "src", "dst")
        c = colour.withColumnRenamed("label", "colour")
        inside = e.join(c, e["src"] == c["node"]).select("src", "dst", "colour").join(c.select(F.col("node").alias("_d"), F.col("colour").alias("_dc")), F.col("dst") == F.col("_d")).where("colour = _dc").select("src", "dst").checkpoint()
        # backwards from the root of each colour, within the colour
        reached = c.where("node = colour").select("node").checkpoint()
        n = reached.count()
        for _ in rounds():
            more = inside.join(reached, inside["dst"] == reached["node"], "left_semi").select(F.col("src").alias("node")).union(reached).distinct().checkpoint()
            m = more.count()
            if m == n:
                break
            reached, n = more, m
        part = c.join(reached, "node", "left_semi").select("node", F.col("colour").alias("component"))
        done = (part if done is None else done.unionByName(part)).checkpoint()
        left = left.join(reached, "node", "left_anti").checkpoint()
        if not left.limit(1).count():
            break
        e = between(e, left)
    if done is None:
        return left.select("node", F.col("node").alias("component"))
    least = done.groupBy("component").agg(F.min("node").alias("_least"))
    return done.join(least, "component").select("node", F.col("_least").alias("component"))


def cyclic_nodes(parts: DataFrame) -> DataFrame:
    """Nodes of components with more than one node; a node with an edge to itself alone is none."""
    return parts.where("size > 1")


# ------------------------------------------------------------------------------------------------------------ cycles
def _circuits(graph: dict[str, list[str]], limit: int | None) -> Iterator[list[str]]:
    """Elementary circuits of two nodes or more, each once from its least node on, in sorted order."""
    n = 0
    for start in sorted(graph):
        allowed = {x for x in graph if x >= start}
        part = next((set(p) for p in _tarjan({k: [v for v in graph[k] if v in allowed] for k in allowed}) if start in p), set())
        if len(part) < 2:
            continue
        blocked: set[str] = {start}
        waits: dict[str, set[str]] = {x: set() for x in part}
        path, closed = [start], [False]
        work = [iter([v for v in graph[start] if v in part and v != start])]
        while work:
            for nxt in work[-1]:
                if nxt == start:
                    yield list(path)
                    n += 1
                    if limit and n >= limit:
                        return
                    closed[-1] = True
                elif nxt not in blocked:
                    path.append(nxt)
                    closed.append(False)
                    blocked.add(nxt)
                    work.append(iter([v for v in graph[nxt] if v in part and v != nxt]))
                    break
            else:
                node = path.pop()
                was = closed.pop()
                work.pop()
                if was:
                    free = {node}
                    while free:
                        x = free.pop()
                        if x in blocked:
                            blocked.discard(x)
                            free |= waits[x]
                            waits[x] = set()
                    if closed:
                        closed[-1] = True
                else:
                    for v in graph[node]:
                        if v in part:
                            waits[v].add(node)


def elementary_cycles(edges: DataFrame, key: str, max_cycles: int | None = None, component: DataFrame | None = None) -> DataFrame:
    """``(key, nodes, size)``: all elementary cycles, each from its least node on; edges of a node to itself make none.

    A graph is one task's work; for one too large give its ``component`` (``node, component``, from
    :func:`components_distributed`), and each component is a task's. With a limit, the first cycles of each graph in
    sorted order are given (a feature for dense graphs, whose cycles grow exponentially).
    """
    kind = edges.schema[key].dataType.simpleString()
    keys = [key]
    if component is not None:
        c = component.select(F.col("node").alias("src"), "component")
        edges = edges.join(c, "src").join(c.select(F.col("src").alias("dst"), F.col("component").alias("_c")), "dst").where("component = _c")
        keys.append("component")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((k, c, len(c)) for k, e in zip(pdf[key], pdf["_edges"], strict=True) for c in _circuits(_graph(e), max_cycles))
            # a dense graph has more cycles than a task holds: they leave in frames of bounded size
            while part := list(itertools.islice(rows, FRAME)):
                yield pd.DataFrame(part, columns=[key, "nodes", "size"])

    return _gathered(edges, keys).mapInPandas(run, f"{key} {kind}, nodes array<string>, size int")


def rotated(n: Column) -> Column:
    """A cycle's nodes from the least one on; direction is kept."""
    at = F.array_position(n, F.array_min(n)).cast("int")
    return F.when(F.size(n) > 0, F.concat(F.slice(n, at, F.size(n)), F.slice(n, F.lit(1), at - 1))).otherwise(n)


def cycle_key(n: Column) -> Column:
    """``cycle_`` and twelve hex digits of the canonical form; ``cycle_empty`` without nodes."""
    return F.when(F.size(n) > 0, F.concat(F.lit("cycle_"), F.substring(F.md5(F.array_join(rotated(n), "->")), 1, 12))).otherwise(F.lit("cycle_empty"))


def ring(n: Column) -> Column:
    """The edges of a cycle as an array of ``(src, dst)``."""
    return F.transform(n, lambda x, i: F.struct(x.alias("src"), n[(i + 1) % F.size(n)].alias("dst")))


def describe(n: Column) -> Column:
    """A sentence for a cycle."""
    return F.when(F.size(n) == 2, F.concat(F.lit("Direct circular dependency between "), n[0], F.lit(" and "), n[1])).otherwise(
        F.concat(F.lit("Circular dependency chain: "), F.array_join(F.concat(n, F.array(n[0])), " → "))
    )


def layer_of(path: Column, layers: Column) -> Column:
    """The first part of ``path`` (its stem first, then its base name, then its folders in order, exactly before in
    either case) that is one of ``layers``; ``Unknown`` without one."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    base = F.element_at(parts, -1)
    stem = F.regexp_replace(base, r"(.)\.[^.]*$", "$1")
    tries = F.concat(F.array(stem, base), F.filter(parts, lambda x: x != ""))
    low = F.transform(layers, F.lower)
    exact = F.filter(tries, lambda x: F.array_contains(layers, x))
    loose = F.filter(tries, lambda x: F.array_contains(low, F.lower(x)))
    named = F.filter(layers, lambda x: F.lower(x) == F.lower(F.get(loose, F.lit(0))))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(named, F.lit(0)), F.lit("Unknown"))


def overlaps(cycles: DataFrame, key: str, id_col: str) -> DataFrame:
    """``(key, id, overlap)``: how many other cycles of the graph share a node but aren't on the same nodes.

    Cycles on the same nodes are one set with a count, so a set many cycles share meets the others once. Sets meet at
    their nodes, one row a node; a pair that meets more than once is counted once.
    """
    c = cycles.select(key, F.col(id_col).alias("_id"), F.array_sort(F.array_distinct("nodes")).alias("_set"))
    sets = c.groupBy(key, "_set").agg(F.count("*").alias("_times")).withColumn("_h", F.xxhash64("_set"))
    at = sets.select(key, "_h", "_times", F.explode("_set").alias("_node"))
    other = at.select(key, F.col("_h").alias("_oh"), F.col("_times").alias("_ot"), "_node")
    met = at.join(other, [key, "_node"]).where("_h <> _oh").select(key, "_h", "_oh", "_ot").distinct()
    n = met.groupBy(key, "_h").agg(F.sum("_ot").alias("overlap"))
    return c.withColumn("_h", F.xxhash64("_set")).join(n, [key, "_h"], "left").select(key, F.col("_id").alias(id_col), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def known(cycles: DataFrame, listed: DataFrame) -> Column | DataFrame:
    """The cycles whose nodes are, in any order, those of a row of ``listed``."""
    s = F.array_sort(F.array_distinct("nodes"))
    return cycles.join(listed.select(s.alias("_set")).distinct(), s == F.col("_set"), "left_semi")


def impact(cycles: DataFrame, edges: DataFrame, key: str, id_col: str = "cycle_key", node_layers: DataFrame | None = None, weights: DataFrame | None = None, known_sets: DataFrame | None = None) -> DataFrame:
    """``cycles`` with the parts of their impact score, its sum and their severity.

    ``node_layers`` has ``(key, node, layer)``, ``weights`` ``(key, src, dst, weight)``, ``known_sets`` ``nodes``. An edge
    without a weight counts 1. Centrality is the mean degree of the cycle's nodes over ``2 (N - 1)``, N being the nodes
    of the graph; with fewer than two it is 0.
    """
    checkpoint_dir(cycles.sparkSession)
    cycles = cycles.checkpoint()  # read by four branches below, and costly to enumerate again
    e = distinct_edges(edges, key)
    deg = degrees(e, key, distinct=True)
    size = deg.groupBy(key).agg(F.count("*").alias("_n"))
    at = cycles.select(key, id_col, F.explode("nodes").alias("node")).join(deg, [key, "node"], "left").join(size, key, "left")
    part = F.when(F.col("_n") > 1, (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))) / (2.0 * (F.col("_n") - 1))).otherwise(F.lit(0.0))
    if node_layers is not None:
        at = at.join(node_layers.select(key, "node", "layer"), [key, "node"], "left")
        layers = F.array_sort(F.array_distinct(F.filter(F.collect_set("layer"), lambda x: x != "Unknown")))
    else:
        layers = F.array().cast("array<string>")
    by_node = at.groupBy(key, id_col).agg(F.avg(part).alias("_central"), layers.alias("layers"))
    on = cycles.select(key, id_col, F.inline(ring(F.col("nodes"))))
    if weights is not None:
        on = on.join(weights.select(key, "src", "dst", "weight"), [key, "src", "dst"], "left")
    else:
        on = on.withColumn("weight", F.lit(1.0))
    by_edge = on.groupBy(key, id_col).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("_w"))
    df = cycles.join(by_node, [key, id_col]).join(by_edge, [key, id_col]).join(overlaps(cycles, key, id_col), [key, id_col])
    if known_sets is not None:
        df = df.join(known_sets.select(F.array_sort(F.array_distinct("nodes")).alias("_set")).distinct().withColumn("_known", F.lit(True)), F.array_sort(F.array_distinct("nodes")) == F.col("_set"), "left").drop("_set")
    else:
        df = df.withColumn("_known", F.lit(None).cast("boolean"))
    df = df.select(
        *cycles.columns, "layers", F.size("nodes").cast("double").alias("length_score"), (CENTRALITY * F.col("_central")).alias("centrality_score"), (EDGE * F.col("_w")).alias("edge_weight_score"),
        F.when(F.size("layers") > 1, LAYERS).otherwise(0.0).alias("cross_layer_score"), F.when(F.col("_known"), KNOWN).otherwise(0.0).alias("known_cycle_boost"),
        F.least(OVERLAP * F.col("overlap"), F.lit(OVERLAP_CAP)).alias("overlap_score"),
    )
    total = sum((F.col(c) for c in ("centrality_score", "edge_weight_score", "cross_layer_score", "known_cycle_boost", "overlap_score")), F.col("length_score"))
    df = df.withColumn("impact_score", total)
    why = F.concat_ws(
        " | ",
        F.when(F.col("cross_layer_score") > 0, F.concat(F.lit("crosses layers "), F.array_join("layers", ", "))), F.when(F.col("edge_weight_score") / EDGE > 5, F.lit("strong coupling")),
        F.when(F.size("nodes") > 3, F.concat(F.size("nodes").cast("string"), F.lit(" modules"))), F.when(F.col("overlap_score") > 0, F.lit("overlaps other cycles")), F.when(F.col("known_cycle_boost") > 0, F.lit("known problem")),
    )
    return df.withColumn("severity", severity(F.col("impact_score"), F.col("cross_layer_score") > 0)).withColumn("explanation", F.when(why == "", F.lit("Simple cycle between few modules")).otherwise(why))


def severity(score: Column, crosses: Column) -> Column:
    return F.when((score >= CRITICAL) | crosses, F.lit("critical")).when(score >= MAJOR, F.lit("major")).otherwise(F.lit("minor"))


def severity_by_shape(size: Column, overlap: Column) -> Column:
    """The alternative rule, by size and overlap only."""
    return F.when((size >= 5) | (overlap >= 3), F.lit("critical")).when(size == 2, F.lit("major")).when((size <= 3) & (overlap == 0), F.lit("minor")).otherwise(F.lit("major"))


def severity_rank(s: Column) -> Column:
    """minor 0, major 1, critical 2; anything else 0."""
    low = F.lower(s)
    return F.when(low == "critical", 2).when(low == "major", 1).otherwise(0)


def at_least(cycles: DataFrame, level: str = "minor", min_score: float = 0.0) -> DataFrame:
    """Cycles of a severity from ``level`` on and, if ``min_score`` is above 0, a score from it on."""
    df = cycles.where(severity_rank(F.col("severity")) >= {"minor": 0, "major": 1, "critical": 2}.get(level.lower(), 0))
    return df.where(F.col("impact_score") >= min_score) if min_score > 0 else df


def summary(cycles: DataFrame) -> DataFrame:
    """One row of counts: total, by severity, direct (two nodes) and indirect."""
    s = F.lower("severity")
    c = lambda x, n: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).alias(n)
    return cycles.agg(F.count("*").alias("total"), c(s == "critical", "critical"), c(s == "major", "major"), c(s == "minor", "minor"), c(F.size("nodes") == 2, "direct"), c(F.size("nodes") > 2, "indirect"))


def prioritized(cycles: DataFrame, strategy: str, partition: list[str], id_col: str) -> DataFrame:
    """``cycles`` with ``position`` in the order of a strategy: impact_first (default), severity_first, size_first or
    cross_layer_first; ties go to the smaller id."""
    imp, sev = F.desc("impact_score"), F.desc(severity_rank(F.col("severity")))
    orders = {"impact_first": [imp, sev], "severity_first": [sev, imp], "size_first": [F.asc(F.size("nodes")), imp], "cross_layer_first": [F.desc("cross_layer_score"), imp]}
    w = W.partitionBy(*partition).orderBy(*orders.get(strategy, orders["impact_first"]), id_col)
    return cycles.withColumn("position", F.row_number().over(w))


# ------------------------------------------------------------------------------------------------------ verification
def broken(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, removed, added, remaining, is_broken, confidence)``: edges of a cycle before and after a change.

    A cycle is broken if no component of more than one node remains; the confidence is 0.8 with a removed edge and 0.3
    without, less 0.2 for each remaining component, within 0.1 and 1.
    """
    b, a = distinct_edges(before, key), distinct_edges(after, key)
    keys = before.select(key).distinct()
    removed = b.join(a, [key, "src", "dst"], "left_anti").groupBy(key).agg(F.count("*").alias("removed"))
    added = a.join(b, [key, "src", "dst"], "left_anti").groupBy(key).agg(F.count("*").alias("added"))
    left = components(a, key).where("size > 1").groupBy(key).agg(F.countDistinct("component").alias("remaining"))
    j = keys.join(removed, key, "left").join(added, key, "left").join(left, key, "left").na.fill(0, ["removed", "added", "remaining"])
    conf = F.when(F.col("removed") > 0, 0.8).otherwise(0.3) - 0.2 * F.col("remaining")
    return j.select(key, "removed", "added", "remaining", (F.col("remaining") == 0).alias("is_broken"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), conf)).alias("confidence"))


def mentions(files: DataFrame, node_names: DataFrame, key: str) -> DataFrame:
    """``(key, src, dst)``: an edge from the node of a file to each other node of the same graph that its content names as a whole word.

    The words of a file are exploded and joined to the names, so no pattern is tried against every text.
    """
    words = files.select(key, F.col("node").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("_w"))
    return words.join(node_names.select(key, F.col("node").alias("_w")).distinct(), [key, "_w"]).where("src <> _w").select(key, "src", F.col("_w").alias("dst")).distinct()
