import random

import pytest

from loopweave.llm import pairs, truncation

PROMPT = "Break the cycle with the smallest change you can find. It lives in a.ts and needs a new owner.\n\ncycle_1: A -> B -> A\n\n--- FILE: src/a.ts ---\nimport { B } from './b';\nexport class A {\n  run(limit) {\n    return this.owner.load(limit);\n  }\n}\n"
PATCH = '{"patches": [{"path": "a.ts", "search_replace": [{"search": "import { B }", "replace": "import type { B }"}]}], "rationale": "Lazy imports hide the loop; they do not remove it."}'


@pytest.mark.parametrize(("answer", "want"), [
    ("", "empty"), (" \n\u200b", "empty"), ("-", "empty"), ("N/A", "empty"), ("null", "empty"), ("{}", "empty"), ('{"patches": []}', "empty"), ("``` ```", "empty"), ("<answer></answer>", "empty"), ('{"patches": [], "rationale": ""}', "empty"),
    ('{"patches": [], "rationale": "A uses B only as a type, so nothing has to change."}', ""), ("Use LedgerService", ""), ("Remove line 23.", ""), (PATCH, ""), ("```json\n" + PATCH + "\n```\n\nDone", ""),
    ("I'm sorry, but I can't help with changes to a.ts.", "refusal"), ('{"status": "refused", "reason": "policy"}', "refusal"), ('{"error": "I am unable to comply with this request.", "patches": []}', "refusal"), ("Вынужден отказаться от ответа.", "refusal"), ("Lo siento, no puedo ayudar con esta solicitud.", "refusal"),
    ("I can't find any use of B, so its import can go.", ""), ("Sorry for the long diff, here is the patch.\n\n```ts\nimport type { B } from './b';\n```", ""), ("Unfortunately b.ts also needs a new parameter.", ""), ("A cannot load before B; that is the root of the loop.", ""),
    (PROMPT, "copied"), (PROMPT.upper(), "copied"), ("> " + PROMPT.replace("\n", "\n> "), "copied"), (" ".join(PROMPT.split()), "copied"), ("Question: " + PROMPT, "copied"), (PROMPT.split("\n")[0], "copied"), ('You asked to "break the cycle", so the import of B should become a type import, which is enough here.', ""),
    ("Das Modul wird erst beim Aufruf geladen und die Klasse kennt nur noch ein Interface.", "other_language"), ("Die Datei a.ts wird nicht mehr geladen.\n\n```ts\nimport type { B } from './b';\n```", "other_language"), ('{"patches": [{"path": "a.ts", "patched": "x"}], "rationale": "Файл загружается при первом вызове, это всё."}', "other_language"),
    ('The ticket says "第27行的导入可以删除。" but that is a different loop.', ""), ("循环已断开，其余代码不变，文件在第一次调用时才加载。", "other_language"),
])
def test_defect(answer, want):
    assert pairs.defect(PROMPT, answer) == want


def test_copies_and_patches_with_blocks():
    prompt = PROMPT + "const SAMPLE = `\n<<<<<<< SEARCH\nimport old\n=======\n>>>>>>> REPLACE\n`;\nfunction f() {\n"
    assert pairs.defect(prompt, prompt) == "copied"
    patch = "--- FILE: src/a.ts ---\n<<<<<<< SEARCH\n    return this.owner.load(limit);\n=======\nthis.a(1);\n>>>>>>> REPLACE\n"
    assert pairs.defect(prompt, patch) == "" and pairs.defect(prompt, patch[:80]) == "" and pairs.defect(prompt, patch[:33]) == ""


def test_copies_with_short_runs():
    rng = random.Random(5)
    prompt = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(5)) for _ in range(60))
    altered = list(pairs.squash(prompt))
    altered[12::30] = "x" * len(altered[12::30])
    assert pairs.is_copied(prompt, "".join(altered), None)
    short = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(2)) for _ in range(60))
    for text in (prompt, short):
        assert pairs.is_copied(text, "\n".join(f"{n:3}: {x}" for n, x in enumerate(text.split("\n"), 1)), None)
    altered[12::15] = "x" * len(altered[12::15])
    assert not pairs.is_copied(prompt, "".join(altered), None)


def test_bound_of_copies_rejects_nothing():
    def held(a, p):
        runs = {p[i : i + pairs.RUN] for i in range(len(p) - pairs.RUN + 1)}
        return len({i + k for i in range(len(a) - pairs.RUN + 1) if a[i : i + pairs.RUN] in runs for k in range(pairs.RUN)}) / len(a)

    rng, seen = random.Random(7), set()
    for _ in range(400):
        p = "".join(rng.choices("abcdefgh", k=rng.randint(40, 300)))
        a = ""
        while len(a) < 150:
            at = rng.randrange(len(p) - 20)
            a += p[at : at + rng.randint(15, 60)] + "x" * rng.randint(0, 3)
        seen.add(held(a, p) >= pairs.COPIED_SHARE)
        assert pairs._in_runs(a, p, pairs.COPIED_SHARE) == (held(a, p) >= pairs.COPIED_SHARE)
    assert seen == {True, False}


def test_prompt_in_another_language():
    prompt = "Bitte den Zyklus mit einer möglichst kleinen Änderung auflösen. Die Klasse wird nur noch von einer Datei geladen.\n\n--- FILE: a.ts ---\nconst a = 1;\n"
    assert pairs.defect(prompt, "Die Datei wird erst beim Aufruf geladen und der Import entfällt.") == ""
    assert pairs.defect(prompt, "The file is loaded when it is called, and so the import can go.") == "other_language"
    assert pairs.defect(None, "The file is loaded when it is called.") == ""


@pytest.mark.parametrize(("text", "want"), [
    (PATCH[:-30], "cut"), (PATCH, "whole"), ("```json\n" + PATCH, "whole"), ("Text.\n\n```ts\nconst a", "cut"), ("--- FILE: a.ts ---\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE", "whole"), ("--- FILE: a.ts ---\n<<<<<<< SEARCH\na\n=====", "cut"),
    ("It is done.", "whole"), ("It is the first of the", "ask"), ("It started at 9 p.m.", "whole"), ("See e.g.", "cut"), ("Text\ufffd", "cut"), ("ไม่จำเป็นอีกต่อไป", "whole"), ("", "whole"), ("1. Add A.b\n2. Add", "ask"), ("So it stayed ...", "whole"),
])
def test_answer_end(text, want):
    assert truncation.answer_end(text)[0] == want


ORIGINAL = "import { B } from './b';\n\nexport class A {\n  run(limit) {\n    return this.owner.load(limit);\n  }\n}\n"


@pytest.mark.parametrize(("text", "want"), [(ORIGINAL, "whole"), (ORIGINAL[:-1], "whole"), (ORIGINAL[:70], "cut"), (ORIGINAL[:60] + "\ufffd", "cut"), (ORIGINAL.replace("(limit) {", "(limit {"), "whole"), (ORIGINAL + "```", "whole"), ("", "whole"), ("<<<<<<< HEAD\n" + ORIGINAL, "whole")])
def test_code_end(text, want):
    assert truncation.code_end("ts", text, ORIGINAL) == want
    assert truncation.code_end(None, text, ORIGINAL) == "whole"


JAVA = "class A {\n    int a;\n\n    int b() {\n        return a;\n    }\n}\n"


@pytest.mark.parametrize(("ext", "text", "original", "want"), [
    ("ts", ORIGINAL[:-2], ORIGINAL, "cut"), ("ts", ORIGINAL[:-3], ORIGINAL, "cut"), ("ts", ORIGINAL[:-2].replace("owner", "hopper"), ORIGINAL, "cut"), ("ts", ORIGINAL[:-2].replace("\n", "\r\n").replace("load", "read"), ORIGINAL, "cut"),
    ("ts", ORIGINAL[: ORIGINAL.index("    return")], None, "cut"), ("ts", ORIGINAL[: ORIGINAL.index("    return")].replace("run", "go"), ORIGINAL, "cut"), ("java", JAVA[:-2], None, "cut"), ("java", JAVA[: JAVA.index("        return")], "class B {\n}\n", "cut"),
    ("py", "def a():\n    return 1\n\n\ndef b():\n", None, "cut"), ("json", '{\n  "a": [\n    1,\n', None, "cut"), ("java", JAVA.replace("    }\n", ""), JAVA, "whole"), ("java", JAVA.replace("    }\n", ""), None, "whole"), ("java", JAVA.replace("b()", "b("), None, "whole"),
    ("java", JAVA[: JAVA.index("    int b")].replace("class A {", ""), JAVA, "whole"), ("txt", "a {\n", None, "whole"), ("py", "def a():\n    return 1\n", "def a():\n    return 1\n\n\ndef b():\n    return 2\n", "whole"),
])
def test_code_that_ends_at_a_line(ext, text, original, want):
    assert truncation.code_end(ext, text, original) == want


def test_prefixes(spark):
    rows = ["abc", "abcd", "abc d", "x", "xy", "same", "same", None, "", "zebra", "zebra stripes", *[f"k{i}" for i in range(200)]]
    df = spark.createDataFrame([(r,) for r in rows], "text string").repartition(5)
    from pyspark.sql import functions as F

    texts = {r["h"]: r["text"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = {texts[r["hash"]]: r["in_word"] for r in truncation.prefixes(df).collect()}
    values = sorted({r for r in rows if r})
    want = {a for a in values if any(b != a and b.startswith(a) for b in values)}
    assert set(got) == want and got["zebra"] is False and got["x"] is True


def table(spark, answers):
    df = spark.createDataFrame([("proposals", i, "r", PROMPT, t) for i, t in answers], "source_table string, row_id bigint, relay string, prompt string, text string")
    return df.selectExpr("*", "1 as hash", "2 as verdict", "3 as line")


def test_corpus_settles_what_is_open(spark):
    answers = [(i, f"The file {i} is small.\n\n1. Add Alpha.run\n2. Drop Beta.load\n\nKind regards") for i in range(12)]
    answers += [(50, "The file is small.\n\n1. Add Alpha.run\n2. Drop Gamma.load"), (51, "The file is small.\n\n1. Add Alpha.run\n2. Drop"), (52, "The file is small.\n\nKind reg"), (53, "The old one was")]
    answers += [(60 + i, f"Use {n}Service") for i, n in enumerate("Ledger Quota Menu Cargo Loom Batch".split())] + [(70, "Us"), (71, None), (51, "The file is small.\n\n1. Add Alpha.run\n2. Drop")]
    t = table(spark, answers).where("text is not null")
    got = {r["row_id"]: r["defect"] for r in pairs.defects(t).collect()}
    assert got == {51: "truncated", 52: "truncated", 53: "truncated", 70: "truncated"}
    assert pairs.defects(t.where("false")).count() == 0


def test_values_of_patches(spark):
    patches = spark.createDataFrame([(1, "r", "a.ts", ORIGINAL, ORIGINAL[:70]), (2, None, "a.ts", ORIGINAL, ORIGINAL), (3, "r", None, None, "x"), (4, "r", "a.ts", None, None), (5, "r", "a.ts", ORIGINAL, "")], "patch_id bigint, relay string, path string, original string, patched string")
    got = {(r["source_table"], r["row_id"]): r["cut"] for r in pairs.cut_values(table(spark, [(1, "Fine.")]), patches).collect()}
    assert got == {("proposals", 1): False, ("patch_results", 1): True, ("patch_results", 2): False, ("patch_results", 3): False}


def test_longer_copies_of_all_fields(spark):
    whole = "class A {\n  x = 1;\n}\nlet total = 5\nrun(total)\ntotal"
    rows = [(1, "r", "a.ts", None, whole), (2, "r", "b.ts", whole + "Of.call()\n", "class B {}"), (3, "r", "a", "one two threefold", "one two three"), (4, "r", "a.ts", "let a = 1\nb()\nlet c = 2", "let a = 1\nb()\n"), (5, "r", "a.ts", "let d\nd", "let d\nd")]
    patches = spark.createDataFrame(rows, "patch_id bigint, relay string, path string, original string, patched string")
    thai = "ไม่จำเป็นอีกต่อไป"
    answers = [(1, thai), (2, thai + "แล้ว"), (3, "It is done."), (4, "It is done.So it is"), *[(10 + i, f"File {i} is small.\n\nKind regards") for i in range(12)], (30, "File 3 is small.\n\nKind regardsless")]
    got = {(r["source_table"], r["row_id"]) for r in pairs.cut_values(table(spark, answers), patches).where("cut").collect()}
    assert got == {("patch_results", 1), ("patch_results", 3), ("proposals", 1), ("proposals", 4), ("proposals", 13), ("proposals", 30)}


def test_any_longer_copy_counts(spark):
    df = spark.createDataFrame([(x,) for x in ["abc", "abc d", "abcd", "abc\n"]], "text string")
    assert [r["in_word"] for r in truncation.prefixes(df).collect()] == [True]


def test_long_empty_shell():
    shell = '{"patches": [' + ", ".join(['{"path": "", "src": null, "search": " "}'] * 200) + "]}"
    assert len(shell) > 4000 and pairs.defect(PROMPT, shell) == "empty" and pairs.defect(PROMPT, shell.replace("null", '"a.ts"', 1)) == ""


def test_very_long_answer():
    assert pairs.defect(PROMPT, "The file is loaded when it is called. " * 20_000) == ""
    assert truncation.answer_end('{"patches": [' + '{"a": 1},' * 100_000)[0] == "cut"
