import random

import pytest
from pyspark.sql import functions as F

from loopweave.llm import handwritten as h

CODE = "".join(f"export function f{w}(a) {{\n  const {w}Value = this.compute{w}(a);\n  return {w}Value.map((x) => x.{w});\n}}\n" for w in "alpha beta gamma delta epsilon zeta eta theta".split())
ACCESS = "class R:\n" + "".join(f"    def get_x{i:03d}(self):\n        return self._x{i:03d}\n" for i in range(20))


@pytest.mark.parametrize(("path", "text", "kind"), [
    ("src/a.ts", CODE, ""), ("src/codegen/a.ts", CODE, ""), ("src/build/a.ts", CODE, ""), ("src/external_orders/a.ts", CODE, ""), ("src/vendor_portal/a.js", CODE, ""), ("src/minmax/a.js", CODE, ""), (None, None, ""), ("a.ts", "", ""), ("a.ts", None, ""), ("a.min.js", None, "minified"),
    ("src/a.generated.ts", CODE, "generated"), ("x_pb2.py", CODE, "generated"), ("a/__generated__/b.ts", CODE, "generated"), ("Form.Designer.cs", CODE, "generated"), ("package-lock.json", "{}", "generated"), ("x/y.lock.json", "{}", "generated"), ("src/a.json", '{"lockfileVersion": 3}', "generated"),
    ("node_modules/lib/a.js", CODE, "vendored"), ("third_party/x/a.py", CODE, "vendored"), ("dist/a.js", CODE, "generated"), ("static/a.0123abcd.js", "", "minified"),
    ("a.ts", "// @generated by x from y\n" + CODE, "generated"), ("a.ts", "// Copyright x.\n//\n// Code generated by protoc v1.2. DO NOT EDIT.\n" + CODE, "generated"), ("a.ts", "// Automatisch erzeugt aus a.xml, bitte nicht von Hand bearbeiten.\n" + CODE, "generated"),
    ("a.ts", "// Do not edit the order of the calls below.\n" + CODE, ""), ("a.ts", "// The report generated by this class is sent once a day.\n" + CODE, ""), ("a.ts", "// Minified output is written elsewhere.\n" + CODE, ""), ("a.ts", "// Values are generated lazily; see the notes.\n" + CODE, ""),
    ("a.ts", CODE + "function head(l) { l.push('// <auto-generated> x </auto-generated>'); }\n", ""), ("a.ts", "// Third-party: quillkit 4.6.3, imported unchanged from upstream of quillkit\n" + CODE, "vendored"), ("a.ts", "// fernbox v1.2 | (c) the fernbox authors | bundled copy, released under the Oak licence\n" + CODE, "vendored"),
    ("a.js", "!function(){" + "var a=[1,2].map(function(x){return x<<1});" * 40 + "}();", "minified"), ("a.py", "DATA = [\n" + "    (1, 2.5, 0x1f),\n" * 40 + "]\n", "data"), ("a.cs", "static class B\n{\n    static readonly byte[] All = {\n" + "        0xf5, 0xfc, 0x27,\n" * 30 + "    };\n}\n", "data"),
    ("a.ts", 'export const X = "' + "aB3//" * 400 + '";\n', "data"), ("a.py", "X = (\n" + "    'aB3x9+/Kq0aB3x9+/Kq0aB3x9+/Kq0aB3x9+/Kq0'\n" * 20 + ")\n", "data"), ("a.ts", "id;name;v\n" + "".join(f"{i};q-{i};{i}.5\n" for i in range(60)), "data"), ("a.py", ACCESS, "generated"),
    ("a.json", '{"name": "x", "version": "1.2.3", "list": ["a", "b"]}', ""), ("a.json", "[" + "1, 2.5, " * 100 + "3]", "data"), ("a.ts", "<<<<<<< HEAD\n" + CODE, ""), ("a.ts", CODE[:300], ""),
])
def test_judge(path, text, kind):
    assert h.judge(path, text)[0] == kind


def test_containment_and_edges(spark):
    vendored = "// vendored dependency alib@1\n" + CODE
    edited = CODE.replace("gammaValue", "changed")
    own = CODE.replace("Value", "Own").replace("compute", "derive").replace("export function", "export async function")
    rows = [(1, "deps/alib/a.js", CODE), (2, "src/copy.js", edited), (3, "src/own.js", own), (4, "src/x.js", None), (5, None, CODE), (6, "src/copy.js", edited), (6, "src/copy.js", edited), (None, "dist/a.js", "x"), (7, "src/a.js", vendored), (8, "src/s.js", CODE[:200])]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string").withColumn("project", F.lit("p")).withColumn("kind", F.lit("x")).withColumn("_lines", F.lit(1)).withColumn("library", F.lit("q"))
    got = {r["file_id"]: (r["kind"], r["evidence"]) for r in h.not_handwritten(df).collect()}
    assert got == {1: ("vendored", "path"), 2: ("vendored", "containment"), 5: ("vendored", "containment"), 6: ("vendored", "containment"), 7: ("vendored", "head")}
    assert h.not_handwritten(df.where("false")).count() == 0


def test_unmarked_copies_across_projects(spark):
    lib = "".join(f"export function step{i}Of(harbour) {{ return harbour.move({i}, 'k{i}'); }}\n" for i in range(30))
    own = "".join(f"export const tide{i} = this.crane.lift({i}, 'w{i}');\n" for i in range(20))
    edits = [lib, lib.replace("step3Of", "stepThree").replace("step9Of", "s9"), "// mine\n" + lib[200:], lib]
    rows = [(i, f"src/u{i}.js", t, f"p{i}") for i, t in enumerate(edits)]
    rows += [(10, "src/own.js", own, "p1"), (11, "src/own.js", own.replace("crane", "wharf", 3), "p1"), (12, "src/own.js", own, "p2"), (13, "src/b.js", own[:500] + lib[:300], None), (14, "src/c.js", own, None), (0, "src/u0.js", lib, "p0")]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    got = {r["file_id"]: (r["kind"], r["evidence"]) for r in h.not_handwritten(df).collect()}
    assert got == {i: ("vendored", "projects") for i in range(4)}


def test_scopes_and_long_heads(spark):
    rows = [(1, "node_modules/@tide/alib/a.js", CODE, "p"), (2, "vendor/alib.min.js/a.js", CODE, "q"), (3, "src/copy.js", CODE.replace("gammaValue", "changed"), "p")]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    assert {r["file_id"]: r["library"] for r in h.not_handwritten(df).collect()} == {1: "alib", 2: "alib", 3: "alib"}
    licence = "".join(f"// Line {i} of the licence.\n" for i in range(60))
    assert h.judge("a.ts", licence + "// Code generated by protoc v1.2. DO NOT EDIT.\n" + CODE)[0] == "generated" and h.judge("a.ts", licence + CODE)[0] == ""


def _numbered(i: int, a: int, b: int) -> list[str]:
    return [f"export const harbour{i}x{j} = this.crane.lift({j}, 'w');" for j in range(a, b)]


@pytest.fixture(params=[h.LOOKUPS, -1], ids=["all pairs", "open pairs"])
def lookups(request, monkeypatch):
    monkeypatch.setattr(h, "LOOKUPS", request.param)


@pytest.mark.usefixtures("lookups")
def test_lines_that_many_texts_have(spark):
    # more edited copies than RARE_TEXTS, so each of their common lines is frequent
    lib = _numbered(0, 0, 30)
    many = h.RARE_TEXTS + 20
    rows = [(i, f"src/u{i}.js", "\n".join(lib[:i % 30] + [f"export const mine{i} = this.quay.own({i});"] + lib[i % 30 + 1:]), f"p{i % 5}") for i in range(many)]
    # as many edited copies in two projects only, and files that share less than CONTAINED of their lines with the first
    two = _numbered(1, 0, 30)
    rows += [(1000 + i, f"src/t{i}.js", "\n".join([*two[:25], *_numbered(2000 + i, 0, 4)]), f"p{i % 2}") for i in range(many)]
    rows += [(3000 + i, f"src/s{i}.js", "\n".join([*lib[:15], *_numbered(3000 + i, 0, 15)]), f"p{i % 5}") for i in range(10)]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    got = {r["file_id"]: r["evidence"] for r in h.not_handwritten(df).collect()}
    assert got == {i: "projects" for i in range(many)}


@pytest.mark.usefixtures("lookups")
def test_every_partner_is_met(spark):
    # each line of the whole text is also in eight others, none of which holds CONTAINED of an edit
    whole = _numbered(0, 0, 60)
    parts = [whole[i % 5 * 12 : i % 5 * 12 + 12] + _numbered(i + 1, 0, 20) for i in range(40)]
    edits = [[*whole[:20], *whole[20 + i : 60], *_numbered(50 + i, 0, 3)] for i in range(1, 4)]
    rows = [(i, "src/a.js", "\n".join(t), "own") for i, t in enumerate(parts)] + [(50 + i, "src/b.js", "\n".join(t), f"p{i}") for i, t in enumerate([whole, *edits])]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    assert {r["file_id"] for r in h.not_handwritten(df).collect()} == {50, 51, 52, 53}


@pytest.mark.usefixtures("lookups")
def test_a_text_in_two_libraries(spark):
    lib = _numbered(0, 0, 30)
    text = "\n".join(lib)
    rows = [(1, "vendor/alib/a.js", text, "p"), (2, "vendor/blib/a.js", text, "p"), (3, "src/copy.js", "\n".join([*lib[4:], *_numbered(1, 0, 4)]), "p"), (4, "src/same.js", text, "q"), (5, "src/own.js", "\n".join([*lib[:10], *_numbered(2, 0, 20)]), "q")]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    got = {r["file_id"]: (r["evidence"], r["library"]) for r in h.not_handwritten(df).collect()}
    assert got == {1: ("path", "alib"), 2: ("path", "blib"), 3: ("containment", "alib"), 4: ("containment", "alib")}


@pytest.mark.usefixtures("lookups")
def test_a_text_without_a_project(spark):
    lib = _numbered(0, 0, 60)
    rows = [(0, "src/all.js", "\n".join(lib), None)] + [(i, f"src/p{i}.js", "\n".join(lib[15 * i : 15 * i + 15]), f"p{i}") for i in (1, 2)] + [(3, "src/p3.js", "\n".join(lib[:15]), "p3"), (4, "src/p4.js", "\n".join(lib[45:] + _numbered(1, 0, 30)), "p4")]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    assert {r["file_id"] for r in h.not_handwritten(df).collect()} == {0, 1, 2, 3}


@pytest.mark.usefixtures("lookups")
@pytest.mark.parametrize("seed", [5, 6])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base, homes = [_numbered(k, 0, 25) for k in range(24)], [rng.sample("pqrst", rng.randrange(1, 5)) for _ in range(24)]
    common = [f"return this.margin.limit({j} + offset);" for j in range(12)]
    rows = []
    for i in range(400):
        k = rng.randrange(24)
        lines = rng.sample(base[k], rng.randrange(4, 25)) + rng.sample(common, rng.randrange(0, 12)) + _numbered(100 + i, 0, rng.randrange(0, 12))
        rows.append((i, f"vendor/l{i % 3}/a.js" if i % 40 == 0 else "src/a.js", "\n".join(lines), rng.choice([*homes[k], None])))
    sets = {i: frozenset(x for x in t.split("\n") if len(x) >= h.LINE_CHARS) for i, _, t, _ in rows}
    assert not any(h.judge(p, t)[0] for i, p, t, _ in rows if i % 40)
    rest = {i for i, p, *_ in rows if i % 40 and len(sets[i]) >= h.LEAST_LINES}
    libs = {f"l{k}": [sets[i] for i in range(0, 400, 40) if i % 3 == k] for k in range(3)}
    alone = {l: frozenset().union(*v) - frozenset().union(*[x for m, w in libs.items() if m != l for x in w]) for l, v in libs.items()}
    holds = lambda s, t: len(s & t) >= max(h.LEAST_LINES, h.CONTAINED * len(t))
    expected = {i: min(n) for i in rest if (n := [l for l, v in libs.items() if any(holds(s, sets[i]) for s in [*v, alone[l]])])}
    project = {i: p for i, _, _, p in rows}
    wide = {j for j in rest if len({project[i] for i in rest if sets[i] == sets[j] or holds(sets[j], sets[i])} - {None}) >= h.LEAST_PROJECTS}
    expected |= {i: "" for i in rest - set(expected) if any(sets[i] == sets[j] or holds(sets[j], sets[i]) for j in wide)}
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, project string")
    got = {r["file_id"]: r["library"] for r in h.not_handwritten(df).collect() if r["file_id"] % 40}
    assert got == expected and 50 < len(expected) < len(rest) and "" in expected.values() and len(set(expected.values())) > 2
