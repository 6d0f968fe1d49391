import ast
import json
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loopweave.llm import syntax
from loopweave.llm.grammars import language

GOOD = {
    "ts": [
        "", "// only a comment", "import a, { b as c, type D } from './x';\nimport type { E } from 'y';\nimport * as z from 'z';\nimport 'side';\nexport * from './w';\nexport { a, c as default };\nexport default class {}\n",
        "export abstract class A<T extends B = C> extends D<T> implements E, F {\n  private readonly x: Map<string, number[]> = new Map();\n  static #p?: string;\n  constructor(private a: A, b = 1, ...c: string[]) { super(a); }\n  get v(): number { return 1 }\n  set v(n) {}\n  async *gen<U>(u: U): AsyncGenerator<U> { yield* u; }\n  abstract f(): void;\n  [key: string]: any;\n  @dec() m() {}\n}",
        "interface I { a: string; b?(x: number): void; readonly [k: string]: unknown\n c: () => void, new (x: any): I }\ntype T = { [K in keyof I]?: I[K] } & (A | B)[] | `a${string}` | typeof x | (new () => X);\nenum E { A = 1, B, 'c' = 2 }\ndeclare module 'm' { export const x: number; }\nnamespace N.M { export type Q = 1 }",
        "const f = async <T,>(x: T): Promise<T> => ({ x, ...y, [z]: 1, get q() { return 1 }, async m() {} });\nlet { a, b: { c = 1 }, ...rest } = obj, [d, , e = 2] = arr;",
        "for (const [k, v] of Object.entries(m)) if (k in m) continue; else break;\nfor (let i = 0, n = 5; i < n; i++) {}\nfor await (const x of y) ;\nouter: while (true) { do { x-- } while (x > 0) switch (x) { case 1: case 2: y(); break; default: z() } }",
        "const r = a ? b : c ? d : e;\nconst s = `x ${a + `y ${b}`} z`;\nconst re = /[/({]\\/+/gi, q = a / b / c;\nx ??= y?.z?.[0]?.(1) ?? !w as unknown as string;\nif (a) b\nelse c\nreturn\n", "try { f() } catch { g() } finally { h() }\nthrow new Error('a')\nlet x = <any>y\nfoo<Bar>(1)\na < b && c > d\nvar f = function* () { const x = yield; }",
        "let a = 1\nlet b = 2\n;[1].forEach(x => x)\nexport const z = { a: 1 }\nfunction g(this: X, a?: number): asserts a is number {}\n", "\ufeffconst x = 1;\r\nconst y = 2;\r\n",
    ],
    "js": ["const { a } = require('b');\nmodule.exports = { a, b: [1, , 2] };\n", "export function f(a, b = 1) { return a ** b; }\nclass A { static x = 1; #y; static { init(); } ['z']() {} }", "label: for (;;) { break label }\nvoid 0, delete a.b, typeof c;\nasync () => { for await (const x of y) await x; };", "if (a) { } else if (b) { } else { }\nx = function () {}\ny = () => {}\n"],
    "java": [
        "package a.b;\nimport static c.D.*;\n@Ann(x = {1, 2}, y = \"z\")\npublic final class A<T extends B & C<?>> extends D<T[]> implements E, F {\n  private static final int[] X = {1, 2};\n  static { x(); }\n  public A(final int... a) throws E1, E2 { this(); }\n  <U> List<? super U> m(Map<String, List<U>> a) { return null; }\n  enum Q { A(1) { void f() {} }, B; Q(int i) {} }\n  record R(int a, String b) implements S { R { } }\n  @interface Z { int v() default 1; }\n  interface I { default void f() {} }\n}",
        "class A { void f() { for (var x : xs) g(x -> x + 1, (a, b) -> { return a; }, String::new, int[]::new); int[] a = new int[3], b = new int[]{1}; Object o = (Runnable & S) () -> {}; long l = (long) x; if (o instanceof String s && !s.isEmpty()) { } switch (x) { case 1, 2 -> y(); default -> throw new E(); } try (var r = f(); s) { } catch (A | B e) { } finally { } do { } while (x > 0); synchronized (this) { } a: for (;;) break a; assert x : \"y\"; String t = \"\"\"\n  hi \"there\"\n  \"\"\"; char c = '\\u0041'; x >>>= 2; } }",
        "void main() { int y = switch (x) { case A a when a.b() > 1 -> { yield 1; } default -> 2; }; List<String>[] z = null; new Outer().new Inner(); A.<B>c(); }" .join(["class X { ", " }"]),
    ],
    "cs": [
        "using System;\nusing X = A.B<int>;\n#region r\nnamespace A.B\n{\n  [Attr(1, Name = \"x\")]\n  public partial class C<T> : D, IE<T> where T : class, new()\n  {\n    private readonly Dictionary<string, List<int[]>> _x = new();\n    public int P { get; private set; } = 3;\n    public string this[int i] => _x[i];\n    public event EventHandler E;\n    static C() { }\n    public C(int a) : base(a) { }\n    ~C() { }\n    public static C operator +(C a, C b) => a;\n    public async Task<T> F<U>(ref int a, out int b, params U[] c) where U : struct { await foreach (var x in y) { } return default; }\n    enum Q : byte { A = 1, B }\n    delegate void H(int x);\n  }\n}\n#endregion\n",
        "namespace N;\npublic record R(int A, string? B) : S;\nclass A { void F() { var x = a is { Length: > 3 } s ? s : null; var y = z switch { 1 or 2 => \"a\", Foo f when f.X > 1 => $\"b {c:N2} {{d}}\", _ => throw new E() }; foreach (var (k, v) in d) { } using var q = w; lock (this) { } if (!int.TryParse(s, out var n)) return; var l = from i in xs where i > 0 orderby i descending select new { i, J = i + 1 }; var t = (a: 1, 2); int? m = null; m ??= 3; char c = '{'; string p = @\"a\"\"b\\\"; Action<int> g = (int i) => { }; x?.y?[0]?.Z(); object o = (string)x; var arr = new[] { 1, 2 }; var ini = new P { A = 1, B = { 2, 3 }, [4] = 5 }; } }",
        "Console.WriteLine(1);\nvar x = args.Where(a => a.B > 1).ToList();\n",
    ],
    "py": ["def f(a, /, b: int = 1, *c, d, **e) -> int:\n    return a if b else [x async for x in y if x]\n", "match x:\n    case {'a': 1, **rest} | [1, *_] if y:\n        pass\n    case Point(x=0) as p: pass\n", "class A(B, metaclass=C):\n\t@dec\n\tdef f(self): ...\n", "x = (1,\n  2)\nif x: pass\nelif y:\n    z\nelse: w = lambda *a, b=1: a\ntry:\n    f()\nexcept* (A, B) as e:\n    pass\nfinally:\n    g()\n", "with (a as b, c): pass\nasync def f():\n    await x\n    return {**a, 'b': 1, **c}, {*d}\n", "a: int = 1; b, *c = d = 1, 2\nprint(f'{x!r:>{w}} \"q\"', end='')\n# end", "type X[T] = list[T]\nx[1:2, ::3, ...] = y if z else w\ndel a, (b)\nglobal q\n", "if x:\n    y\n  # odd comment\n    z\n\n\n"],
    "json": ["{}", "[1, -2.5e3, \"a\\u00e9\\n\", null, true, {\"x\": []}]", "\ufeff{\"a\": 1}\r\n", "3", "\"s\""],
}
BAD = {
    "ts": ["class A {", "const x = ;", "f(a b)", "if (a { }", "x = 'abc", "x = `abc", "<<<<<<< HEAD\nconst a = 1;\n=======\n>>>>>>> x\n", "```ts\nconst a = 1;\n```", "from a import b", "let x: = 1;", "class A { f() { } } }", "/* open", "const v\ufffd = 1;", "Here is the code:\nconst a = 1;", "... existing code ...", "function (", "return 1 2"],
    "js": ["const x: string = 1;", "interface A {}", "class A { private x; y: int }", "let a = 1 let b", "import { a from 'b';", "{ a: 1, b }}"],
    "java": ["class A { int x = 1 }", "class A { void f( { } }", "public class", "class A { String s = \"abc; }", "const x = 1;", "package a\nimport b;", "class A { void f() { g() h(); } }", "class A { char c = 'ab'; }", "class A { void f() { null; } }", "class A { void f() { this.x; } }"],
    "cs": ["class A { int x = 1 }", "namespace A { class B { }", "class A { void F() { foreach (var x in y { } } }", "using System\nclass A {}", "import x from 'y';", "class A { public int P { get; set } }", "class A { string s = $\"a{b\"; }"],
    "py": ["def f(:\n  pass", "if x\n  pass", "x = 'abc", "  x = 1", "def f():\npass", "else:\n  pass", "try:\n  x\ny", "a b", "x = (1", "for x y: pass", "@dec\nx = 1", "const a = 1;", "class A:\n", "return = 3", "if x:\n    a\n  b\n"],
    "json": ["", " ", "{'a': 1}", "{\"a\": 1,}", "[1 2]", "[01]", "\"a\nb\"", "NaN", "{\"a\"}", "[1]]", "// c\n{}", "tru"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert language(ext).valid(text), text


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts if t.strip()])
def test_invalid(ext, text):
    assert not language(ext).valid(text), text
    place, cause = syntax.fault(ext, text)
    assert 0 <= place <= len(text) and cause


def exact(ext, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text) if ext == "py" else json.loads(text, parse_constant=lambda c: 1 / 0)
    except (SyntaxError, ValueError, ZeroDivisionError):
        return False
    return True


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e in ("py", "json") for t in GOOD[e] + BAD[e]])
def test_agrees_with_the_exact_parsers(ext, text):
    assert language(ext).valid(text.removeprefix("\ufeff")) == exact(ext, text.removeprefix("\ufeff"))


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12), st.integers(0, 200))
def test_json_against_the_exact_parser(value, cut):
    text = json.dumps(value)
    assert language("json").valid(text)
    part = text[: cut % (len(text) + 1)]
    if part.strip():
        assert language("json").valid(part) == exact("json", part)


def test_deep_nesting_and_long_texts():
    assert language("json").valid("[" * 5000 + "]" * 5000)
    assert not language("json").valid("[" * 5000 + "]" * 4999)
    assert language("ts").valid("const x = [" + "1," * 200_000 + "];")
    assert language("py").valid("x = 1\n" * 50_000)
    assert syntax.valid("ts", "a;" + "if (a) b; else " * 3000 + "c;")


def test_cause_and_place():
    assert syntax.fault("ts", "const a = 1;\nconst b = ;\n")[0] == 23
    assert syntax.fault("ts", "class A {\n  f() {\n    retu")[1] == "cut off"
    assert syntax.fault("py", "import { a } from 'b';\n")[1] == "other language"
    assert syntax.fault("cs", "<<<<<<< HEAD\nclass A {}\n=======\n>>>>>>> b\n")[1] == "conflict markers"


def test_operator(spark):
    rows = [("f", 1, "ts", "class A {"), ("f", 1, "ts", "class A {"), ("f", 2, "ts", "class A {}"), ("f", 3, "ts", None), ("f", 4, "ts", ""), ("f", 5, None, "}{"), ("f", 6, "zz", "}{"), ("p", 1, "json", "{")]
    df = spark.createDataFrame(rows, "source_table string, row_id bigint, ext string, text string").selectExpr("*", "'a' as project", "1 as position", "2 as cause")
    assert sorted(map(tuple, syntax.unparsed(df).collect())) == [("f", 1), ("p", 1)]
    assert {(r["source_table"], r["row_id"], r["cause"]) for r in syntax.faults(syntax.verdicts(df)).collect()} == {("f", 1, "cut off"), ("p", 1, "cut off")}
    assert {(r["ext"], r["texts"], r["unparsed"]) for r in syntax.rates(syntax.verdicts(df)).collect()} == {("ts", 2, 1), ("json", 1, 1), ("zz", 1, 0)}
    assert syntax.unparsed(df.where("false")).count() == 0


def test_deep_nesting_is_followed():
    deep = "!" * 30_000
    assert syntax.valid("js", f"x = {deep}a;\n") and not syntax.valid("js", f"x = {deep};\n")
    chain = "if (a) { b(); } else " * 5_000
    assert syntax.valid("ts", chain + "c();\n") and not syntax.valid("ts", chain + "\n")
