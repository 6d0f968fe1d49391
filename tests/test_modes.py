import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loopweave.operators import briefing, compiling, explaining, graph, matching, rules, suggestions
from loopweave.operators import history as h
from loopweave.plans import modes
from loopweave.sources import memory, projects, settings, sinks, templates

FILES = [("c", 1, "src/app/Order_Service.ts", 0, "class OrderService {\n  a = 1;\n}\n"), ("c", 2, "src/app/order-store.ts", 1, "class OrderStore {}\n"), ("c", 3, None, 2, None), ("d", 4, "x/y.py", 0, "x = 1\n")]


def files(spark):
    return spark.createDataFrame(FILES, "cycle_id string, file_id bigint, path string, ord int, content string")


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), "cycle_id string, pos int, node string")


def test_nodes_and_files(spark):
    n = nodes(spark, ("c", 0, "OrderService"), ("c", 1, "Store"), ("c", 2, "order-store"), ("e", 0, "X"))
    got = {(r["cycle_id"], r["pos"]): r["path"] for r in matching.node_files(n, files(spark), "cycle_id").collect()}
    assert got == {("c", 0): FILES[0][2], ("c", 1): FILES[1][2], ("c", 2): FILES[1][2], ("e", 0): None}
    explicit = spark.createDataFrame([("c", "Store", "z.ts")], "cycle_id string, node string, path string")
    assert {r["path"] for r in matching.node_files(n, files(spark), "cycle_id", explicit).where("node = 'Store'").collect()} == {"z.ts"}
    strict = spark.createDataFrame([("c", 1, "a/IOrder.ts"), ("c", 2, "a/my.Order.ts"), ("c", 3, "a/PreOrder.ts"), ("c", 4, None)], "cycle_id string, file_id bigint, path string")
    got = {r["file_id"]: r["node"] for r in matching.file_nodes(strict, nodes(spark, ("c", 0, "Order")), "cycle_id", "file_id", strict=True).collect()}
    assert got == {1: "Order", 2: "Order", 3: None, 4: None}
    assert matching.node_files(n.where("false"), files(spark), "cycle_id").count() == 0


def test_mentions(spark):
    df = spark.createDataFrame([(1, "uses A.b and Foo, not FooBar", ["Foo", "Bar", "A.b", "FooBar", "oo", "Foo"]), (2, None, ["A"]), (3, "A", None)], "i int, t string, n array<string>")
    assert {r["i"]: r["m"] for r in df.select("i", matching.mentions(F.col("t"), F.col("n")).alias("m")).collect()} == {1: ["Foo", "A.b", "FooBar"], 2: [], 3: None}


def test_reasons_against_breaking(spark):
    f = spark.createDataFrame([("a", "The Parser calls the Lexer here." * 5), ("b", "x = 1\n" * 40), ("c", "y = 2\n" * 40), ("d", "z")], "k string, content string")
    common = spark.createDataFrame([("b", "Cycle_not_broken"), ("c", "syntax")], "k string, issue string")
    n = spark.createDataFrame([("c", "System.IO"), ("b", "Own")], "k string, node string")
    got = {r["k"]: r["reason"] for r in rules.unbreakable(f, "k", repeated=rules.coupled(common, "k"), external=rules.external_nodes(n, "k")).collect()}
    assert got == {"a": "mutual_recursion", "b": "coupled_by_design", "c": "external", "d": "incomplete"}


def test_components_of_a_long_path(spark):
    e = [(f"n{i:03}", f"n{i + 1:03}") for i in range(24)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "n000"), ("n010", "a"), ("z", "z")]
    df = spark.createDataFrame(e, "src string, dst string")
    got = {r["node"]: r["component"] for r in graph.components_distributed(df).collect()}
    ring = {"a", "b", "c", *(f"n{i:03}" for i in range(11))}
    assert {n for n, c in got.items() if c == "a"} == ring and all(got[n] == n for n in got if n not in ring) and len(got) == 29
    with pytest.raises(RuntimeError):
        graph.components_distributed(df, max_rounds=2)
    assert graph.components_distributed(df.where("false")).count() == 0


def test_many_cycles_leave_in_frames(spark, monkeypatch):
    monkeypatch.setattr(graph, "FRAME", 3)
    e = spark.createDataFrame([("k", a, b) for a in "abcde" for b in "abcde" if a != b], "key string, src string, dst string")
    assert graph.elementary_cycles(e, "key").count() == 84


def test_overlap_of_equal_cycles(spark):
    c = spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, ["b", "a"]), ("k", 3, ["b", "c"]), ("k", 4, ["x", "y"]), ("m", 5, ["a"])], "k string, id int, nodes array<string>")
    assert {r["id"]: r["overlap"] for r in graph.overlaps(c, "k", "id").collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0}


def test_suggestions_of_an_answer(spark):
    answer = json.dumps({
        "strategy_used": "interface_extraction", "new_files": [{"path": "src/interface/IOrder.ts", "content": "export interface IOrder {}"}, {"path": "e.ts"}, {"content": "no path"}],
        "changes": [{"path": "order-store.ts", "prepend": "import { IOrder } from 'x';", "search_replace": [{"search": "class OrderStore {}", "replace": "class OrderStore implements IOrder {}"}, {"search": "not there", "replace": ""}, {"search": "", "replace": "x"}]}, {"path": "Order_Service.ts"}],
    })
    a = spark.createDataFrame([("c", 1, f"```json\n{answer}\n```"), ("c", 1, f"```json\n{answer}\n```"), ("c", 2, "no json"), ("c", 3, None)], "cycle_id string, proposal_id bigint, llm_response string")
    rows = {(r["is_new"], r["pos"]): r for r in suggestions.suggestions(a, files(spark)).collect()}
    assert {k: r["confidence"] for k, r in rows.items()} == {(True, 0): 0.9, (True, 1): 0.5, (False, 0): 0.6, (False, 1): 0.3}
    assert [(c["first"], c["last"]) for c in rows[False, 0]["codes"]] == [(1, 1), (1, 1), (0, 0)]
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (0, 5), (3, 4)], "c int, m int")
    assert [r[0] for r in df.select(suggestions.difficulty(F.col("c"), F.col("m"))).collect()] == ["easy", "moderate", "moderate", "complex", "moderate"]
    o = spark.createDataFrame([([0.9, 0.5], True, 0), ([0.3], False, 5), ([], False, 0), ([1.0], True, 0)], "c array<double>, n boolean, w int")
    assert [round(r[0], 6) for r in o.select(suggestions.overall(F.col("c"), F.col("n"), F.col("w"))).collect()] == [0.75, 0.0, 0.0, 1.0]


def test_snippets_of_long_files(spark):
    lines = [f"value{i} = {i}" for i in range(200)]
    lines[50], lines[120] = "def run(self):", "from order.store import Thing"
    text = "\n".join(lines) + "\n"
    df = spark.createDataFrame([(1, "zebra.py", text), (2, "a.py", "short"), (3, "a.py", None), (4, "qq.zzz", "ward " * 1000)], "i int, p string, c string")
    got = {r["i"]: r["s"] for r in briefing.with_snippet(df, F.col("p"), F.col("c"), F.array(F.lit("order")), F.lit(900), "s").collect()}
    assert got[1] == "\n".join(lines[48:60]) + "\n\n...\n\n" + "\n".join(lines[118:123]) and got[2] == "short" and got[3] == ""
    assert got[4] == ("ward " * 1000)[:900] + "\n...[truncated]"


def test_feedback_and_reports(spark):
    i = spark.createDataFrame([("c", "syntax", f"f{n}", "bad") for n in range(7)] + [("c", "cycle", None, f"A -> B {n}") for n in range(2)] + [("c", "odd", "x", None)], "k string, kind string, path string, comment string")
    text = explaining.feedback(i, ["k"]).first()["feedback"]
    assert text == "### syntax\n" + "\n".join(f"- f{n}: bad" for n in range(5)) + "\n- and 2 more\n\n### cycle\n- A -> B 0\n- A -> B 1\n\n### other\n- x: "
    assert explaining.feedback(i.where("false"), ["k"]).count() == 0


def test_prompt_within_its_room(spark):
    p = "## Task\nDo.\n\n## Reference\n" + "r" * 300 + "\n## Code\n" + "c" * 100
    df = spark.createDataFrame([(p,), ("short",), ("x" * 500,)], "p string")
    got = [r[0] for r in df.select(modes.within(F.col("p"), 200)).collect()]
    assert got[0] == "## Task\nDo.\n\n\n## Code\n" + "c" * 100 and got[1] == "short" and got[2] == "x" * 100 + "\n\n... [cut]"


def test_answers_are_applied_to_the_files_they_mean(spark):
    a = spark.createDataFrame([
        ("c", 1, '{"patches": [{"path": "order-store.ts", "search_replace": [{"search": "class OrderStore {}", "replace": "class Store {}"}]}]}'), ("c", 2, "FILE: src/app/order-store.ts\nCHANGE: 1-1\n---\nclass S {}\n---\n"), ("c", 3, '{"new_files": [{"path": "n.ts", "content": "export {}"}]}'),
        ("d", 4, '{"patches": [{"path": "y.py", "search_replace": [{"search": "zzz", "replace": "q"}]}]}'), ("d", 5, '{"patches": [{"path": "x/y.py", "patched": "x = 1\\n"}]}'), ("d", 6, None),
    ], "cycle_id string, proposal_id bigint, llm_response string")
    got = {r["proposal_id"]: r for r in modes.apply_answers(a.where("llm_response is not null"), files(spark).where("content is not null"), ["cycle_id", "proposal_id"], "llm_response").collect()}
    assert {i: (r["path"], r["status"]) for i, r in got.items()} == {1: (FILES[1][2], "applied"), 2: (FILES[1][2], "applied"), 3: ("n.ts", "new_file"), 4: ("x/y.py", "failed"), 5: ("x/y.py", "unchanged")}
    assert "-class OrderStore {}\n+class Store {}" in got[1]["diff"] and got[5]["diff"] == ""


def test_scaffolds(spark):
    a = spark.createDataFrame([(1, json.dumps({"scaffold_files": [{"path": "I.cs", "content": "namespace A { interface I { } }", "purpose": "interface"}, {"path": "b.ts", "content": "interface B {"}]})), (2, "none"), (3, None)], "i int, t string")
    assert {(r["path"], tuple(r["errors"]), r["valid"]) for r in modes.scaffolds(a, "i", "t").collect()} == {("I.cs", (), True), ("b.ts", ("unbalanced", "not exported"), False)}


def test_checks_of_files(spark):
    f = spark.createDataFrame([(1, "a.py", "x = 1"), (2, "a.py", "x = "), (3, "a.json", "{}"), (4, "a.json", "{"), (5, "a.cs", "class"), (6, "a.zzz", "?"), (7, None, None), (8, "a.py", None)], "i int, path string, content string")
    got = {r["i"]: (r["success"], r["tool"], r["tool_available"], len(r["errors"])) for r in compiling.checked(f, "i").collect()}
    assert got == {1: (True, "python", True, 0), 2: (False, "python", True, 1), 3: (True, "json", True, 0), 4: (False, "json", True, 1), 5: (True, "csharp", False, 0), 6: (True, "none", True, 0), 7: (True, "none", True, 0), 8: (True, "python", True, 0)}


def test_projects(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"name": "p", "dependencies": {"a": "1"}}')
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"paths": {"@x": ["y"]}}}')
    (tmp_path / "a.ts").write_text("import { b } from './b';\n")
    (tmp_path / "b.ts").write_text("import './a';\n")
    assert projects.project_info(str(tmp_path)) == {"has_package_json": True, "has_tsconfig": True, "name": "p", "type": "typescript", "dependencies": ["a"], "devDependencies": [], "ts_paths": {"@x": ["y"]}}
    adjacency = tmp_path / "out.json"
    adjacency.write_text('{"a.ts": ["b.ts", "lib"]}')
    e, how = projects.project_edges(spark, str(tmp_path), str(adjacency))
    assert how == "tool" and {(r["src"], r["dst"]) for r in e.collect()} == {("a.ts", "b.ts"), ("a.ts", "lib")}
    adjacency.write_text("{")
    e, how = projects.project_edges(spark, str(tmp_path), str(adjacency))
    assert how == "imports" and {(r["src"], r["dst"]) for r in e.collect()} == {("a.ts", "b.ts"), ("b.ts", "a.ts")}
    assert [r["node"] for r in projects.graph(e).collect()] == ["a.ts", "b.ts"]
    circular = tmp_path / "c.json"
    circular.write_text('[["a.ts", "b.ts"]]')
    assert [r["nodes"] for r in projects.circular_json(spark, str(circular)).collect()] == [["a.ts", "b.ts"]]
    with pytest.raises(FileNotFoundError):
        projects.checked_root(str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        projects.checked_root(str(circular))
    assert projects.tools(("no-such-tool",)) == {"no-such-tool": False}


def test_settings(tmp_path, monkeypatch):
    p = tmp_path / "c.yml"
    p.write_text("# a comment\nretriever:\n  k: 7 # seven\npipeline:\n  enable:\n    validator: false\n  agents_order:\n    - describer\n    - refactor\nprompts:\n  refactor: 'Do {x}'\nauth:\n  key: MY_KEY_ENV\n  other: plain\n")
    monkeypatch.setenv("MY_KEY_ENV", "secret")
    s = settings.load_settings(str(p))
    assert s["retriever"] == {"search_type": "similarity", "k": 7} and s["pipeline"]["agents_order"] == ["describer", "refactor"] and s["auth"] == {"key": "secret", "other": "plain"}
    assert not settings.enabled(s, "validator") and settings.enabled(s, "refactor") and settings.prompt(s, "refactor", compact=True) == "Do {x}" and settings.prompt(s, "x") == ""
    assert settings.load_settings(str(tmp_path / "none"))["retriever"]["k"] == 4
    t = tmp_path / "t.txt"
    t.write_text("from a file")
    assert templates.load_template(str(t)) == "from a file" and templates.load_template("a/b.txt") == "a/b.txt" and templates.load_template(None) == ""


def test_templates(spark):
    df = spark.createDataFrame([("Hello {name}, {\"k\": 1} {other} {{x}}", None)], "t string, v string")
    r = df.select(templates.filled(F.col("t"), {"name": F.lit("A"), "other": F.col("v")}).alias("a"), templates.placeholders(F.col("t")).alias("b")).first()
    assert r["a"] == 'Hello A, {"k": 1}  {{x}}' and r["b"] == ["name", "other", "x"]


def test_memory_and_index(spark, tmp_path):
    a = spark.createDataFrame([(i, "c", "lazy", i % 2 == 0) for i in range(60)], "attempt_id bigint, cycle_id string, strategy string, approved boolean")
    assert memory.load_state(spark, str(tmp_path / "m")) == (None, None)
    memory.save_state(a, str(tmp_path / "m"))
    patterns, recent = memory.load_state(spark, str(tmp_path / "m"))
    assert patterns.first()["successes"] == 30 and {r["attempt_id"] for r in recent.collect()} == set(range(10, 60))
    assert h.without_cycle(a, "c").count() == 0 and h.without_cycle(a, None).count() == 60
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("breaking cycles with an interface\fsecond page about layers")
    (tmp_path / "d" / "b.pdf").write_bytes(b"not a pdf")
    assert memory.open_index(spark, str(tmp_path / "i")) is None
    assert memory.build_index(spark, str(tmp_path / "d"), str(tmp_path / "i")) == 2
    q = spark.createDataFrame([("k", 0, "an interface for breaking cycles"), ("k", 1, "layers page"), ("k", 9, "never asked"), ("m", 0, "layers")], "key string, pos int, query string")
    got = {r["key"]: r["context"] for r in memory.context(q, memory.open_index(spark, str(tmp_path / "i")), "key", k=1, source="id").collect()}
    assert set(got) == {"k", "m"} and "[a.txt:00001]\nbreaking cycles with an interface" in got["k"] and "second page" in got["m"]
    assert memory.context(q, None, "key").count() == 0
    with pytest.raises(ValueError):
        memory.embedding("none")
    assert memory.hashed(pd.Series(["a b", None]))[1] == [0.0] * 64


def test_named_artifacts(spark):
    df = spark.createDataFrame([("c", "text")], "cycle_id string, t string")
    assert sinks.named(df, "response", "cycle_id", "t", "refactor").first()["path"] == "refactor/response.txt"
    with pytest.raises(ValueError):
        sinks.named(df, "other", "cycle_id", "t")
