import itertools
import random

import pytest
from pyspark.sql import functions as F

from loopweave.operators import graph as g

EDGES = "key string, src string, dst string"


def edges(spark, rows, key="k"):
    return spark.createDataFrame([(key, *r) for r in rows], EDGES)


def brute_cycles(es):
    adj = {}
    for s, d in es:
        adj.setdefault(s, set()).add(d)
    out = set()

    def walk(start, path):
        for n in adj.get(path[-1], ()):
            if n == start and len(path) > 1:
                out.add(tuple(path))
            elif n > start and n not in path:
                walk(start, [*path, n])

    for s in adj:
        walk(s, [s])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cycles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    es = [(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(14)]
    got = [tuple(r["nodes"]) for r in g.elementary_cycles(edges(spark, es), "key").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(es)


def test_complete_graph_has_84_cycles(spark):
    es = list(itertools.permutations("abcde", 2))
    c = g.elementary_cycles(edges(spark, es), "key")
    assert {r["size"]: r["count"] for r in c.groupBy("size").count().collect()} == {2: 10, 3: 20, 4: 30, 5: 24}
    assert g.elementary_cycles(edges(spark, es), "key", max_cycles=7).count() == 7


def test_components_agree(spark):
    rng = random.Random(5)
    es = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)]
    a = {(r["node"], r["component"]) for r in g.components(edges(spark, es), "key").collect()}
    b = {(r["node"], r["component"]) for r in g.components_distributed(edges(spark, es)).collect()}
    assert a == b
    with_component = g.elementary_cycles(edges(spark, es), "key", component=g.components_distributed(edges(spark, es)))
    assert {tuple(r["nodes"]) for r in with_component.collect()} == brute_cycles(es)


def test_deep_chain_needs_no_recursion(spark):
    n = 3000
    es = [(f"{i:05d}", f"{(i + 1) % n:05d}") for i in range(n)]
    assert g.components(edges(spark, es), "key").select("component").distinct().count() == 1
    assert g.elementary_cycles(edges(spark, es), "key").first()["size"] == n


def test_self_loops_nulls_and_empty(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "a"), (None, "a"), ("b", None), ("a", "b")]
    assert [r["nodes"] for r in g.elementary_cycles(edges(spark, rows), "key").collect()] == [["a", "b"]]
    assert g.elementary_cycles(edges(spark, [("a", "a")]), "key").count() == 0
    empty = edges(spark, [])
    for df in (g.elementary_cycles(empty, "key"), g.components(empty, "key"), g.degrees(empty, "key"), g.adjacency(empty, "key"), g.nodes(empty, "key")):
        assert df.count() == 0


def test_worked_example_of_the_score(spark):
    e = edges(spark, [("A", "B"), ("B", "A")])
    c = g.elementary_cycles(e, "key").withColumn("cycle_key", g.cycle_key(F.col("nodes")))
    r = g.impact(c, e, "key").first()
    assert r["impact_score"] == pytest.approx(5.0) and r["severity"] == "minor"


def test_layers_make_a_cycle_critical(spark):
    e = edges(spark, [("A", "B"), ("B", "A")])
    c = g.elementary_cycles(e, "key").withColumn("cycle_key", g.cycle_key(F.col("nodes")))
    layers = spark.createDataFrame([("k", "A", "ui"), ("k", "B", "data")], "key string, node string, layer string")
    r = g.impact(c, e, "key", node_layers=layers, known_sets=c.select("nodes")).first()
    assert r["cross_layer_score"] == 10 and r["known_cycle_boost"] == 10 and r["severity"] == "critical"


def test_cycle_key_ignores_rotation_but_not_direction(spark):
    df = spark.createDataFrame([(["B", "C", "A"],), (["A", "B", "C"],), (["A", "C", "B"],), ([],)], "n array<string>")
    a, b, c, d = (r[0] for r in df.select(g.cycle_key(F.col("n"))).collect())
    assert a == b != c and d == "cycle_empty"


def test_broken(spark):
    before = edges(spark, [("A", "B"), ("B", "A")])
    r = g.broken(before, edges(spark, [("A", "B")]), "key").first()
    assert (r["removed"], r["added"], r["remaining"], r["is_broken"], r["confidence"]) == (1, 0, 0, True, 0.8)
    r = g.broken(before, before, "key").first()
    assert not r["is_broken"] and r["confidence"] == pytest.approx(0.1)


def test_extra_columns_may_clash(spark):
    e = edges(spark, [("A", "B"), ("B", "A")]).withColumn("_edges", F.lit(1)).withColumn("component", F.lit("x")).withColumn("node", F.lit("y"))
    assert g.elementary_cycles(e, "key").count() == 1
    assert g.components(e, "key").count() == 2
    assert g.degrees(e, "key").count() == 2
