import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopweave.llm import split

LIMITS = [("ts", 60, 10), ("py", 40, 0), ("cs", 30, 40), ("js", None, 5), ("java", 25, None)]


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, path string, content string").withColumn("_n", F.lit("clash")).withColumn("max_chars", F.lit(1)).withColumn("_ext", F.lit("zz"))


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame(LIMITS, "ext string, max_chars int, overlap_chars int")


def cut(spark, limits, rows):
    got = {}
    for r in split.explode_pieces(split.split_files(files(spark, rows), limits)).collect():
        got.setdefault(r["file_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in got.items()}


def check(content, pieces, most):
    assert "".join(p["piece"][p["shared"] :] for p in pieces) == content
    at = 0
    for p in pieces:
        assert p["start_char"] == at and len(p["piece"]) <= most
        assert content[p["start_char"] - p["shared"] : p["start_char"]] == p["piece"][: p["shared"]]
        at += len(p["piece"]) - p["shared"]
    assert not any(a["piece"].endswith("\r") and b["piece"][b["shared"] :].startswith("\n") for a, b in zip(pieces, pieces[1:], strict=False))


def test_round_trip_of_many_kinds(spark, limits):
    texts = [
        "class A {\n  x = 1;\n\n  foo() {\n    return 1;\n  }\n\n  bar() {}\n}\n\nclass B {\n  y = 2;\n}\n" * 3, "x" * 500, "a\r\nb\r\n" * 40, "日本語のテキスト" * 20, "😀" * 100, "word " * 50, "\n" * 200, "a\n\n\n" * 60, "ab\rcd\r" * 30,
    ]
    got = cut(spark, limits, [(i, "p/a.TS", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        check(t, got[i], 60)
        assert len(got[i]) > 1


def test_cuts_stand_between_declarations_and_lines(spark, limits):
    code = "export class A {\n  one() { return 1; }\n}\n\nexport class B {\n  two() { return 2; }\n}\n\nexport class C {}\n"
    got = cut(spark, limits, [(1, "a.ts", code)])[1]
    assert [p["piece"][p["shared"] :].startswith("export class") for p in got] == [True] * len(got)
    lines = "".join(f"line number {i}\n" for i in range(20))
    assert all(p["piece"].endswith("\n") for p in cut(spark, limits, [(1, "a.ts", lines)])[1])


def test_defined_results(spark, limits):
    rows = [(1, "a.ts", None), (2, "a.ts", ""), (3, "a.unknown", "x" * 999), (4, None, "x" * 999), (5, "a.js", "x" * 999), (6, "a.cs", "y" * 100), (7, "a.java", "z" * 60), (8, "noext", "x" * 99), (9, "a.ts", "short")]
    got = cut(spark, limits, rows)
    assert {k: len(v) for k, v in got.items()} == {2: 1, 3: 1, 4: 1, 5: 1, 6: 4, 7: 3, 8: 1, 9: 1}
    assert all(p["shared"] == 0 for k in (6, 7) for p in got[k])


def test_oversized(spark, limits):
    rows = [(1, "a.ts", "x" * 61), (1, "a.ts", "x" * 61), (2, "a.ts", ("y" * 59 + "\r\n") * 3), (3, "a.ts", "z" * 60), (4, "a.ts", "😀" * 61)]
    got = {r["file_id"]: r["long_line"] for r in split.oversized(split.split_files(files(spark, rows), limits)).collect()}
    assert got == {1: 1, 2: 0, 4: 1}
    empty = spark.createDataFrame([], "file_id bigint, path string, content string")
    assert split.oversized(split.split_files(empty, limits)).count() == 0
    assert split.oversized(split.split_files(files(spark, rows), limits.where("false"))).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\r{};é漢😀"), max_size=200), min_size=1, max_size=20))
def test_round_trip_property(spark, limits, texts):
    got = cut(spark, limits, [(i, "a.ts", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        check(t, got[i], 60)


def test_very_long_text(spark, limits):
    t = "some words in a line\n" * 60_000
    got = cut(spark, limits, [(1, "a.ts", t)])[1]
    check(t, got, 60)


def test_running_sums(spark):
    rows = [(i, ["x" * (k % 7) for k in range(n)]) for i, n in enumerate([0, 1, 2, 63, 64, 65, 128, 1000])]
    df = spark.createDataFrame(rows, "i int, xs array<string>")
    for r in split.running_sums(df, "xs", "s").collect():
        assert r["s"] == [sum(map(len, r["xs"][:k])) for k in range(len(r["xs"]))]


def test_only_the_number(spark, limits):
    rows = [(1, "a.ts", "x" * 500), (2, "a.ts", "short"), (3, "a.ts", None)]
    some = split.split_files(files(spark, rows), limits, with_pieces=False)
    assert "pieces" not in some.columns
    assert {(r["file_id"], r["n_pieces"]) for r in some.collect()} == {(r["file_id"], r["n_pieces"]) for r in split.split_files(files(spark, rows), limits).collect()}
