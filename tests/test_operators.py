import pytest
from pyspark.sql import functions as F

from loopweave.functions import text as t
from loopweave.operators import context, history, patching, reports, retrieval, rules
from loopweave.sources import readers, sinks
from loopweave.streaming import streams
from loopweave.tables import extension


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", None), ("function f() { return [1, 2", None), ("function f() { if (a) { while (b) { x", "open braces"), ("return value; // ...", "left out"), ("const a = 'b',", "trailing comma"), ('const a = "b', "open string")])
def test_truncation_note(spark, text, want):
    assert one(spark, text, t.truncation_note) == want


def test_bracket_issues(spark):
    df = spark.createDataFrame([("((a)", "py"), ("a < b", "ts"), ("a < b", "py"), (None, None)], "x string, e string")
    got = [[i["pair"] for i in r[0]] for r in df.select(t.bracket_issues(F.col("x"), F.col("e"))).collect()]
    assert got == [["()"], ["<>"], [], []]


def test_extension(spark):
    assert [one(spark, p, extension) for p in ("a/b.TS", "x", "a.b.py", None)] == ["ts", "", "py", None]


def test_packing_truncates_the_last_file(spark):
    df = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate((10, 20, 30, 5))], "k string, i int, c string")
    got = {r["i"]: r["given"] for r in context.packed(df, "k", ["i"], F.length("c"), 35).collect()}
    assert got == {0: 10, 1: 20, 2: 5}
    whole = {r["i"] for r in context.whole_files(df, "k", "i", F.length("c"), 36, 25).collect()}
    assert whole == {0, 1, 3}


def test_islands(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 4, 6), ("k", 9, 9), ("k", 2, 2), ("k", 9, 12)], "k string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in context.islands(df, "k").collect()) == [(1, 6), (9, 12)]


def test_history_of_nothing(spark):
    empty = spark.createDataFrame([], "attempt_id bigint, cycle_id string, strategy string, approved boolean, issue_types array<string>, approach_summary string, ts string")
    assert history.stats(empty).first()["total"] == 0
    for df in (history.learning(empty), history.tips(empty), history.recurring(empty), history.common_issues(empty), history.accumulated(empty), history.memory_context(empty)):
        assert df.count() == 0


def test_history_nulls(spark):
    rows = [(1, "c", None, None, None, None, None), (2, "c", " Lazy-Import ", False, ["Syntax", "syntax", None], "a", "2024-01-02T03:04:05"), (3, "c", "lazy_import", False, ["syntax"], "b", "20240102T030405Z")]
    df = spark.createDataFrame(rows, "attempt_id bigint, cycle_id string, strategy string, approved boolean, issue_types array<string>, approach_summary string, ts string")
    got = {r["strategy"]: (r["successes"], r["failures"]) for r in history.learning(df).collect()}
    assert got == {"unknown": (0, 0), "lazy_import": (0, 2)}
    assert [r["issue"] for r in history.recurring(df).collect()] == ["syntax"]
    assert [r[0] is None for r in df.orderBy("attempt_id").select(history.attempt_time(F.col("ts"))).collect()] == [True, False, False]


def test_readers_of_answers():
    js = '{"patches": [{"path": "a.ts", "patched": "```ts\\nx\\n```"}, {"path": ""}, 3], "new_files": [{"path": "n.ts", "content": "y"}]}'
    assert [c[:4] for c in patching.read_changes(js)] == [("a.ts", "whole", None, "x"), ("n.ts", "new", None, "y")]
    fenced = "Here:\n```json\n" + '{"changes": [{"path": "a", "search_replace": [{"search": "p", "replace": "q"}]}]}' + "\n```\nDone"
    assert [c[:4] for c in patching.read_changes(fenced)] == [("a", "replace", "p", "q")]
    blocks = "--- FILE: a.py ---\n<<<<<<< SEARCH\nold\n=======\nnew\n>>>>>>> REPLACE\n--- FILE: b.py ---\nwhole file\n"
    assert [c[:4] for c in patching.read_changes(blocks)] == [("a.py", "replace", "old", "new"), ("b.py", "whole", None, "whole file")]
    simple = "STRATEGY: lazy import\nFILE: a.py\nLINES 2-3:\nx\ny\nNEW_FILE: c.py\nz\n"
    assert [(c[0], c[1], c[3], c[4], c[5]) for c in patching.read_changes(simple)] == [("a.py", "lines", "x\ny", 2, 3), ("c.py", "new", "z", None, None)]
    for nothing in (None, "", "no change", "{", "[]", '{"patches": null}'):
        assert patching.read_changes(nothing) == []


def test_diff_and_repair():
    assert patching.unified("a\nb\n", "a\nb\n", "p") == ""
    assert patching.unified("a\n", "b\n", "p").startswith("--- a/p\n+++ b/p\n")
    assert patching.line_counts("a\nb\nc", "a\nx\nc\nd") == (2, 1, 2)
    assert patching.line_counts(None, None) == (0, 0, 0)
    assert patching.repair("f({a: 1,})")[0] == "f({a: 1})"
    assert patching.repair("if (a) {\n  b(\"}\");\n")[0].count("}") == 2
    assert patching.repair("ok();") == ("ok();", [], 1.0)
    assert patching.count_brackets("f('(') // (", "(", ")") == (1, 1)


def test_chunks_stay_small():
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(60)) for i in range(10))
    cs = retrieval.chunk_text(text, 300, 60)
    assert max(map(len, cs)) <= 300 and set(text.split()) == {w for c in cs for w in c.split()}
    assert retrieval.chunk_text("x" * 1000, 300, 60)[0] == "x" * 300
    assert retrieval.chunk_text("", 10, 2) == []


def test_nearest_nulls_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in retrieval.nearest(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(0, 1), (0, 2)]
    assert retrieval.nearest(v, v.where("false"), 2).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 5))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.nearest(v, v.where("vec_id % 3 = 0"), 4).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert got == {(i, n + 1): int(j) for i in range(0, 60, 3) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:4])}


def test_rules(spark):
    assert one(spark, "Use a Mutual import", lambda c: rules.first_rule(c, rules.STRATEGIES)) == "interface_extraction"
    assert one(spark, None, lambda c: rules.first_rule(c, rules.STRATEGIES)) is None
    df = spark.createDataFrame([("c", "class Parser { use(Lexer l) {} } " * 5), ("d", "x"), ("e", None)], "k string, content string")
    assert {r["k"]: r["reason"] for r in rules.unbreakable(df, "k").collect()} == {"c": "mutual_recursion", "d": "incomplete", "e": "incomplete"}


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "a" / "one.ts").write_text("import { two } from '../two';\nimport x from 'pkg';\n")
    (tmp_path / "src" / "two.ts").write_text("const one = require('./a/one');\n")
    (tmp_path / "src" / "node_modules" / "m.ts").write_text("import './x';\n")
    (tmp_path / "graph.json").write_text('{"a.ts": ["b.ts", "c.ts"], "b.ts": []}')
    (tmp_path / "package.json").write_text('{"name": "p", "dependencies": {"b": "1", "a": "2"}}')
    files = readers.source_tree(spark, str(tmp_path), exclude=("node_modules",))
    assert sorted(r["path"] for r in files.collect()) == ["src/a/one.ts", "src/two.ts"]
    assert sorted(map(tuple, readers.resolved_imports(files).collect())) == [("src/a/one.ts", "src/two.ts"), ("src/two.ts", "src/a/one.ts")]
    assert sorted(map(tuple, readers.adjacency_json(spark, str(tmp_path / "graph.json")).collect())) == [("a.ts", "b.ts"), ("a.ts", "c.ts")]
    assert readers.project_files(spark, str(tmp_path)).first()["dependencies"] == ["a", "b"]


def test_graph_json_layouts(spark):
    texts = ['[{"id": "1", "nodes": ["A", {"id": "B"}], "edges": [["A", "B"], {"source": "B", "target": "A"}, ["A"]]}]', '{"cycles": [{"id": "2", "graph": {"nodes": [], "edges": []}}]}', '{"id": "3", "graph": {"nodes": ["X"], "edges": [["X", "X"]]}}', "no json", None]
    df = spark.createDataFrame([(x,) for x in texts], "value string")
    got = {r["id"]: (r["nodes"], [list(e) for e in r["edges"]]) for r in readers.graph_jobs(df).collect()}
    assert got == {"1": (["A", "B"], [["A", "B"], ["B", "A"]]), "2": ([], []), "3": (["X"], [["X", "X"]])}
    assert readers.graph_jobs(df, cycle_id="3").count() == 1


def test_sinks(spark, tmp_path):
    assert [one(spark, p, sinks.safe_path) for p in ("../../etc/x", "C:\\a\\..\\b", "/a/./b", None)] == ["etc/x", "a/b", "a/b", ""]
    df = spark.createDataFrame([("c", "a.ts", "text")], "k string, path string, text string")
    assert sinks.write(df, str(tmp_path / "o"), "k", dry_run=True) == 0 and not (tmp_path / "o").exists()
    assert sinks.write(df, str(tmp_path / "o"), "k") == 1 and (tmp_path / "o" / "k=c").exists()


def test_logs(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["ok", "ERROR a", "Traceback", "fine", "ValueException"])], "pos int, line string")
    assert [r["pos"] for r in readers.log_errors(df, 2).collect()] == [2, 4]


def test_reports(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"],), (["a"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(reports.listing(F.col("n"))).collect()] == ["a -> b -> c -> d ... (5 total)", "a", ""]


def test_streams(spark, tmp_path):
    rows = [(1, "Lazy-Import", True, "2024-01-01 10:00:00"), (1, "Lazy-Import", True, "2024-01-01 11:00:00"), (2, None, False, "2024-01-02 10:00:00"), (3, "x", True, "2024-01-20 10:00:00")]
    df = spark.createDataFrame(rows, "attempt_id bigint, strategy string, approved boolean, t string").select("attempt_id", "strategy", "approved", F.to_timestamp("t").alias("ingested_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.learning_stream(stream), "learned", str(tmp_path / "ck"))
    got = {(r["strategy"], r["successes"], r["failures"]) for r in spark.table("learned").collect()}
    assert {("lazy_import", 1, 0), ("unknown", 0, 1)} <= got
