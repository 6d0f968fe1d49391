from loopweave.plans import pipeline


def test_directory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.ts").write_text("import { two } from '../two';\n")
    (tmp_path / "two.ts").write_text("import { one } from './a/one';\nimport { three } from './three';\n")
    (tmp_path / "three.ts").write_text("export const three = 3;\n")
    got = pipeline.analyze_directory(spark, str(tmp_path)).collect()
    assert [(r["nodes"], r["position"], r["severity"]) for r in got] == [(["a/one.ts", "two.ts"], 1, "minor")]
    assert pipeline.analyze_directory(spark, str(tmp_path), ignore_patterns=["two*"]).count() == 0
    assert pipeline.analyze_directory(spark, str(tmp_path), min_severity="major").count() == 0


def test_processing(spark):
    src = "import { B } from './b';\nexport class A {\n  run() { return 1; }\n}\n"
    block = "--- FILE: {} ---\n<<<<<<< SEARCH\n{}\n=======\n{}\n>>>>>>> REPLACE\n"
    answers = [
        ("c", 1, block.format("a.ts", "import { B } from './b';", "import type { B } from './b';")), ("c", 2, block.format("a.ts", "nothing like it at all, sorry", "x") + block.format("b.ts", "b", "c")),
        ("c", 3, block.format("a.ts", "import { B } from './b';", "import { B } from './b';")), ("c", 4, block.format("a.ts", "  run() { return 1; }", "  run() { if (x) { y(")), ("c", 5, "no change"), ("c", 6, None), ("c", 7, block.format("zzz.ts", "a", "b")),
    ]
    a = spark.createDataFrame(answers, "cycle_id string, proposal_id bigint, llm_response string")
    f = spark.createDataFrame([("c", "a.ts", src), ("c", "b.ts", "a\nb\n"), ("c", "n.ts", None)], "cycle_id string, path string, content string")
    p = pipeline.process(a, f, ["cycle_id", "proposal_id"], "llm_response")
    assert sorted((r["proposal_id"], r["path"], r["status"]) for r in p.collect()) == [(1, "a.ts", "applied"), (2, "a.ts", "failed"), (2, "b.ts", "reverted"), (3, "a.ts", "unchanged"), (4, "a.ts", "partial"), (7, "zzz.ts", "failed")]
    v = {r["proposal_id"]: r["approved"] for r in pipeline.verdicts(p, ["cycle_id", "proposal_id"]).collect()}
    assert v == {1: True, 2: False, 3: False, 4: False, 7: False}
    assert pipeline.process(a.where("false"), f, ["cycle_id", "proposal_id"], "llm_response").count() == 0
