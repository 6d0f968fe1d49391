import numpy as np
import pytest

from loopweave.llm import mixing as m

WORDS = "one two three four five six seven eight nine ten".split()


@pytest.fixture(scope="module")
def size(spark):
    rows = [(i, ["A-b", "a_B ", "c", None, "", "d"][i % 6], " ".join(WORDS[: i % 9 + 1]) * (i % 5 + 1)) for i in range(1200)]
    rows += [(5000, "c", None), (5001, "c", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as tokens", "2 as _id")
    return m.sizes(df).cache()


def targets(spark, rows):
    return spark.createDataFrame(rows, "mix string, source string, target_share double, max_repeats int")


T = [("x", "a_b", 0.3, 4), ("x", "C", 0.5, 4), ("x", "zzz", 0.2, 4), ("y", "d", 0.02, 1), ("y", "c", 0.98, 2)]


def test_token_counts():
    assert len(m.encoding().encode_ordinary("hello world")) == 2


@pytest.mark.parametrize("bucket", [100_000, 40])
def test_shares_are_met_to_a_document(spark, size, bucket, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", bucket)
    used, plan = m.mix(size, targets(spark, T))
    got = {(r["mix"], r["source"]): r for r in m.shares(used, plan).collect()}
    assert set(got) == {("x", "a_b"), ("x", "c"), ("x", "zzz"), ("y", "d"), ("y", "c")}
    most = size.agg({"tokens": "max"}).first()[0]
    for r in got.values():
        if r["shortfall_tokens"] == 0:
            assert abs(r["reached_tokens"] - r["target_tokens"]) <= most
    assert got["x", "zzz"]["reached_tokens"] == 0 and got["x", "zzz"]["shortfall_tokens"] > 0
    c = got["y", "c"]
    assert c["max_copies"] == 2 and c["reached_tokens"] == 2 * c["available_tokens"] and c["shortfall_tokens"] == pytest.approx(c["target_tokens"] - c["reached_tokens"])
    assert got["x", "a_b"]["max_copies"] <= 4


def test_same_whatever_the_partitions(spark, size):
    a = m.mix(size, targets(spark, T))[0]
    b = m.mix(size.repartition(7), targets(spark, T).repartition(3))[0]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_pivotal_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(3)
    w = rng.integers(1, 50, 60).astype(float)
    x = np.full(60, 0.3)
    runs = []
    for k in range(3000):
        y, left = m.pivotal(w, x, np.random.default_rng(k))
        assert sum(1 for v in y if 1e-9 < v < 1 - 1e-9) <= 1
        assert (w * y).sum() == pytest.approx((w * x).sum())
        if left >= 0:
            y[left] = float(rng.random() < y[left])
        runs.append(y)
    assert np.abs(np.mean(runs, axis=0) - 0.3).max() < 0.06


def test_nulls_and_empty(spark, size):
    used, plan = m.mix(size, targets(spark, [("x", "c", None, None), (None, "c", 0.5, 1), ("x", None, 0.5, 1)]))
    assert used.count() == 0 and m.shares(used, plan).count() == 1
    used, plan = m.mix(size.where("false"), targets(spark, T))
    assert used.count() == 0 and {r["reached_tokens"] for r in m.shares(used, plan).collect()} == {0}
    used, plan = m.mix(size, targets(spark, []))
    assert used.count() == 0
