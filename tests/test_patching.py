import pytest

from loopweave.operators import patching as p

LINES = "import a\n\nclass A:\n    def run(self, limit):\n        total = self.owner.load(limit)\n        return total\n\n    def stop(self):\n        return None\n\n    def halt(self):\n        return None\n".split("\n")
SRC = "\n".join(LINES)


@pytest.mark.parametrize(("search", "hint", "want"), [
    ("class A:", None, (2, 3, "exact", 1.0)), ("class A:   ", None, (2, 3, "exact", 1.0)), ("        return None", 10, (11, 12, "exact_with_hint", 0.95)), ("        return None", 8, (8, 9, "exact_with_hint", 0.95)), ("        return None", None, (8, 9, "exact_first", 0.7)),
    ("nothing like it at all, really", None, (-1, -1, "none", 0.0)), ("", None, (1, 2, "exact_first", 0.7)),
])
def test_places_of_equal_lines(search, hint, want):
    assert p.locate(search, LINES, hint) == want


def test_anchored_and_similar_places():
    a, b, how, sure = p.locate("def run(self, limit):\n    total = self.owner.get(limit)\nreturn total", LINES)
    assert (a, b, how) == (3, 6, "anchor") and 0.7 <= sure <= 0.8
    a, b, how, sure = p.locate("    def run(self, limits):\n        total = self.owner.load(limits)", LINES)
    assert (a, b, how) == (3, 5, "fuzzy_high_sim") and 0.75 <= sure <= 0.85
    a, b, how, sure = p.locate("        total = self.owner.reload(limit, 3)", LINES)
    assert (a, b, how) == (4, 5, "fuzzy") and 0.4 <= sure <= 0.65
    assert p.locate("        total = nobody(here)", LINES)[2] == "none"


def test_a_bound_loses_no_window():
    import difflib
    import random

    rng = random.Random(5)
    for _ in range(200):
        lines = ["".join(rng.choices("abc ", k=rng.randint(0, 9))).rstrip() for _ in range(12)]
        want = [x.replace("a", "b", 1) for x in lines[3 : 3 + rng.randint(1, 3)]]
        best = None
        for i in range(len(lines) - len(want) + 1):
            r = [1.0 if g.strip() == x.strip() else difflib.SequenceMatcher(None, g.strip(), x.strip()).ratio() for g, x in zip(want, lines[i:], strict=False)]
            s = sum(r) / len(r) * 0.7 + min(r) * 0.3
            if best is None or s > best[0]:
                best = (s, i)
        got = p._by_lines(want, lines, None)
        assert (got is None) == (best[0] < 0.75) and (got is None or got[0] == best[1])


@pytest.mark.parametrize(("text", "want"), [("// Line 42", 41), ("# near line 7", 6), ("x (line 25)", 24), ("line 3:", 2), ("at line 9", 8), ("line 9 and so on", None), ("", None)])
def test_hints(text, want):
    assert p.line_hint(text) == want


def test_all_or_nothing():
    done = p.apply_replacements(SRC, [("import a", "import b"), ("        return total", "return total + 1")])
    assert done[0].split("\n")[0] == "import b" and "\n        return total + 1\n" in done[0] and done[1:] == (1.0, 2, "")
    assert p.apply_replacements(SRC, [("import a", "import b"), ("zzz yyy xxx", "q")]) == (SRC, 0.0, 0, "2 not found")
    assert p.apply_replacements(SRC, [("class A:", "class B:"), ("class A:\n    def run(self, limit):", "x")])[3] == "overlap"
    assert p.apply_replacements(SRC, [("        return None", "        return 0")])[1:] == (0.7, 1, "1 marginal")
    low = [("        total = self.owner.reload(limit, 3)", "        total = 3")]
    assert p.apply_replacements(SRC, low) == (SRC, 0.0, 0, "1 unsure")
    assert p.apply_replacements(SRC, low, allow_low=True)[2] == 1 and p.apply_replacements(SRC, low, least=0.4)[2] == 1
    assert p.apply_replacements(SRC, [("import a", "import b, c, // ...")])[3] == "1 looks cut"
    assert p.apply_replacements("a\r\nb\r\n", [("b", "c")]) == ("a\nc\n", 1.0, 1, "") and p.apply_replacements("a", []) == ("a", 0.0, 0, "no blocks")
    assert p.apply_replacements("\tone()\n", [("\tone()", "two()")])[0] == "\ttwo()\n"


def test_rollback():
    src = "f(a)\ng(b)\nh(c)\n"
    good, bad, worse = ("f(a)", "f(x)"), ("g(b)", "g(b"), ("h(c)", "h(c")
    assert p.apply_with_rollback(src, [good])[0] == "f(x)\ng(b)\nh(c)\n"
    assert p.apply_with_rollback(src, [bad])[3] == "not sound"
    assert p.apply_with_rollback(src, [good, bad]) == ("f(x)\ng(b)\nh(c)\n", 1.0, 1, "left out 2")
    assert p.apply_with_rollback(src, [good, bad, worse]) == ("f(x)\ng(b)\nh(c)\n", 1.0, 1, "left out 2, 3")
    assert p.apply_with_rollback(src, [bad, worse])[2:] == (2, "not sound")


def test_plain_formats():
    first = "STRATEGY: lazy\nFILE: src/a.ts\nCHANGE: lines 2–3\n---\nx\ny\n---\nDESCRIPTION: d\n\nNEW_FILE: src/b.ts\n---\nexport {}\n---\n"
    assert p.read_changes(first) == [("src/a.ts", "lines", None, "x\ny", 2, 3), ("src/b.ts", "new", None, "export {}", None, None)]
    assert p.read_changes("FILE: a.ts (lines 4-5)\n---\nz\n---\n") == [("a.ts", "lines", None, "z", 4, 5)]
    assert p.read_changes("```ts\n// FILE: a.ts\nexport class A {}\n```") == [("a.ts", "new", None, "export class A {}", None, None)]
    second = "STRATEGY: inversion\nNEW_FILE: i.cs\n---BEGIN---\ninterface I {}\n---END---\n\nMODIFY: a.cs\nADD_USING: using X;\nADD_USING: using Y;\nSEARCH:\nA a;\nREPLACE:\nI a;\nSEARCH:\nB\nREPLACE:\nC\n\nCYCLE_BROKEN: Yes\n"
    assert p.read_changes(second) == [("i.cs", "new", None, "interface I {}", None, None), ("a.cs", "prepend", None, "using X;\nusing Y;", None, None), ("a.cs", "replace", "A a;", "I a;", None, None), ("a.cs", "replace", "B", "C", None, None)]
    assert p.per_file(p.read_changes(first)) == {"src/a.ts": {"lines": [(2, 3, "x\ny")], "replace": []}, "src/b.ts": {"is_new": True, "content": "export {}"}}
    assert p.from_lines("a", [(2, 3, "x"), (3, 9, "y")], "1\n2\n3\n") == [("2\n3", "x"), ("3", "y")] and p.from_lines("a", [(1, 1, "x")], None) == []


def test_broken_json():
    cut = '{"patches": [{"path": "a.cs", "patched": "class A {\\n  \\"q\\" \\\\ }"}, {"path": "b.cs", "patched": "class B {\\n'
    assert p.read_changes(cut) == [("a.cs", "whole", None, 'class A {\n  "q" \\ }', None, None), ("b.cs", "whole", None, "class B {\n", None, None)]
    assert p.read_changes('"path": "a.py", see\n```python\nx = 1\n```\n') == [("a.py", "whole", None, "x = 1", None, None)]
    assert p.read_changes('{"changes": [{"path": "a", "append": "class B", "prepend": "import x"}]}') == [("a", "prepend", None, "import x", None, None), ("a", "append", None, "class B", None, None)]
    assert p.with_ends("a", "append", ["class B"]) == "a\n\nclass B" and p.with_ends("a", "append", ["b"]) == "a\nb" and p.with_ends("", "prepend", ["x"]) == "x" and p.with_ends("a", "prepend", ["x"]) == "x\na"


def test_applied_rows(spark):
    answers = spark.createDataFrame([
        ("c1", 1, '{"patches": [{"path": "a.py", "search_replace": [{"search": "class A:", "replace": "class B:"}]}]}'), ("c1", 2, "--- FILE: a.py ---\n<<<<<<< SEARCH\nno such line\n=======\nx\n>>>>>>> REPLACE\n"),
        ("c1", 3, "FILE: a.py\nCHANGE: lines 1-1\n---\nimport z\n---\n"), ("c2", 4, '{"patches": [{"path": "b.py", "patched": "x = 1"}]}'), ("c2", 5, None), ("c2", 6, "nothing to see"),
    ], "cycle_id string, proposal_id bigint, llm_response string")
    files = spark.createDataFrame([("c1", "a.py", SRC)], "cycle_id string, path string, content string")
    ch = p.changes(answers, ["cycle_id", "proposal_id"], "llm_response")
    assert {(r["proposal_id"], r["path"], r["kind"]) for r in ch.collect()} == {(1, "a.py", "replace"), (2, "a.py", "replace"), (3, "a.py", "lines"), (4, "b.py", "whole")}
    got = {r["proposal_id"]: (r["applied"], r["confidence"], r["note"], r["patched"]) for r in p.applied(ch, files, ["cycle_id", "proposal_id"]).collect()}
    assert got == {1: (1, 1.0, "", SRC.replace("class A:", "class B:")), 2: (0, 0.0, "1 not found", None), 3: (1, 1.0, "", SRC.replace("import a", "import z")), 4: (1, 1.0, "no file", "x = 1")}
