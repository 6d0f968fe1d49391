import random

from loopweave.llm import pairs, truncation

PROMPT = "Break the cycle with the smallest change you can find."
CODE = "class Harbour {\n  open() {\n    return this.lantern;\n  }\n}\nrunHarbour(total)\nfinish"


def cuts(spark, answers, patches=()):
    a = spark.createDataFrame([("proposals", i, r, PROMPT, t) for i, r, t in answers], "source_table string, row_id bigint, relay string, prompt string, text string")
    p = spark.createDataFrame(list(patches), "patch_id bigint, relay string, path string, original string, patched string")
    return {(r["source_table"], r["row_id"]): r["evidence"] for r in pairs.cut_values(a, p).where("cut").collect()}


PLANTED = [
    *[(i, "r", f"File {i} is small.\n\nKind regards") for i in range(12)], (20, "r", "File 3 is small.\n\nKind regardsless"),  # a frequent closing, gone on with elsewhere
    (30, None, "ไม่จำเป็นอีกต่อไป"), (31, "r", "ไม่จำเป็นอีกต่อไปแล้ว"),  # a script without stops
    (40, "r", '{"a": "b"'), (41, "r", "The old one was"),
]
PATCHES = [
    (1, "r", "a.ts", None, CODE), (2, "r", "b.ts", CODE + "Of.call()\n", "class B {}\n"),  # a longer copy in another field
    (3, "r", "a", "one two threefold", "one two three"), (4, "r", "c.ts", CODE, CODE[:40].replace("open", "shut")), (5, "r", "d.ts", None, "class D {\n  run() {\n"),
]


def test_evidence_of_planted_cuts(spark):
    assert cuts(spark, PLANTED, PATCHES) == {
        ("proposals", 3): "prefix", ("proposals", 20): "open end", ("proposals", 30): "prefix", ("proposals", 40): "structure", ("proposals", 41): "open end",
        ("patch_results", 1): "prefix", ("patch_results", 3): "prefix", ("patch_results", 4): "prefix", ("patch_results", 5): "structure",
    }


def test_rows_that_only_the_join_gives(spark, monkeypatch):
    monkeypatch.setattr(truncation, "prefixes", lambda values: spark.createDataFrame([], "hash bigint, in_word boolean"))
    without = cuts(spark, PLANTED, PATCHES)
    assert set(without) == {("proposals", 20), ("proposals", 40), ("proposals", 41), ("patch_results", 4), ("patch_results", 5)}


def test_length_spikes(spark):
    rng = random.Random(3)
    words = "harbour lantern gate keeper bell dusk ring tide wharf crane".split()

    def text(n):
        t = ""
        while len(t) < n:
            t += rng.choice(words) + str(rng.randrange(1000)) + " "
        return t[: n - 1] + "x"

    answers = [(i, "bridge", text(300)) for i in range(40)] + [(100 + i, "bridge", text(rng.randrange(200, 400))) for i in range(80)]
    answers += [(300 + i, "relay", text(300)) for i in range(2)] + [(400, "bridge", text(299)[:-1] + "."), (401, "bridge", text(299) + ".")]
    got = cuts(spark, answers)
    assert all(got["proposals", i] == "spike" for i in range(40))
    assert got["proposals", 300] == "open end" and ("proposals", 401) not in got  # whole by its stop, whatever its length
    assert sum(v == "spike" for v in got.values()) <= 43


def test_hot_opening_is_split(spark, monkeypatch):
    monkeypatch.setattr(truncation, "RANGE_CHARS", 4)
    monkeypatch.setattr(truncation, "HOT", 10)
    monkeypatch.setattr(truncation, "LEAST_HOT", 100)
    texts = ["same opening of all " + "".join(random.Random(i).choices("abc", k=9)) for i in range(3000)] + ["z", "zy"]
    texts += [t[:-3] for t in texts[:50]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    values = set(texts)
    want = {a for a in values if any(a[:n] == a and b != a and b.startswith(a) for n in [len(a)] for b in values if len(b) > len(a))}
    assert truncation.prefixes(df).count() == len(want)


def test_empty_tables(spark):
    assert cuts(spark, [], []) == {}
    assert cuts(spark, [(1, None, ""), (2, None, " ")], [(1, None, None, None, None)]) == {}
