"""Shares, caps and totals of mixtures."""

import pytest

from tideline.llm.mixing import Mixture, ratios, tidy_source

DOCS = "doc_id long, text string, source string, copy_no int, weight string"
TARGETS = "source string, weight double, max_repeat int, n_tokens int"


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, 0, "?") for i, (t, s) in enumerate(data)], DOCS)


def targets(spark, data):
    return spark.createDataFrame([(*r, 1) for r in data], TARGETS)


def test_ratios():
    rows = [{"source": s, "weight": w, "max_repeat": m, "tokens": t} for s, w, m, t in (("a", 1, 1, 1000), ("b", 1, 3, 100), ("c", 2, 1, 5000), ("none", 1, 1, 0))]
    total, r = ratios(rows, None, 0)
    assert total == pytest.approx(1200) and r == pytest.approx({"a": 0.3, "b": 3, "c": 0.12})
    total, r = ratios(rows, 3000, 0)
    assert total == pytest.approx(3000) and r["b"] == 3 and r["a"] == pytest.approx(0.9) and r["c"] == pytest.approx(0.36)
    total, r = ratios(rows, 1e9, 0)
    assert total == pytest.approx(1000 + 300 + 5000) and r == {"a": 1, "b": 3, "c": 1}
    exact, some = ratios(rows, None, 0)[0], ratios(rows, None, 0.1)[0]
    assert some > exact
    assert ratios([], None, 0.1) == (0.0, {})


def test_shares_and_caps(spark):
    data = [("word " * (5 + i % 20), "Hot Paper") for i in range(3000)] + [("word " * 10, "small")] * 20 + [("word " * 9, "mid") for _ in range(500)] + [("x", "untargeted"), ("x", None), (None, "mid"), ("", "mid")]
    m = Mixture(docs(spark, data), targets(spark, [("hot_paper", 5.0, 1), ("SMALL", 1.0, 4), ("mid", 2.0, 2), ("mid", 1.0, 9), ("absent", 1.0, 1), ("off", 0.0, 1), ("null", None, 1), (None, 1.0, 1)]))
    copies = m.copies.collect()
    per = {}
    for r in copies:
        per.setdefault((r.doc_id, r.source), []).append(r.copy_no)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    most = {s: max((len(c) for (_, x), c in per.items() if x == s), default=0) for s in ("hot_paper", "small", "mid")}
    assert most["hot_paper"] == 1 and most["small"] <= 4 and most["mid"] <= 2
    share = {r.source: r for r in m.shares.collect()}
    assert share["absent"].reached_tokens == 0 and share["off"].reached_share == 0
    assert sum(r.reached_share for r in share.values()) == pytest.approx(1)
    missed = sum(max(0, r.weight / 8 - r.reached_share) for r in share.values() if r.source in most)
    assert missed < 0.12
    exact = Mixture(docs(spark, data), targets(spark, [("hot_paper", 5.0, 1), ("small", 1.0, 4), ("mid", 2.0, 2)]), shortfall=0)
    for r in exact.shares.collect():
        assert r.reached_share == pytest.approx(r.target_share, abs=0.01)


def test_same_every_time_and_empty(spark):
    data = [(f"word {i}", "a") for i in range(200)]
    d, t = docs(spark, data), targets(spark, [("a", 1.0, 1)])
    get = lambda seed: sorted(r.doc_id for r in Mixture(d, t, total=100, seed=seed).copies.collect())
    assert get(1) == get(1) and 0 < len(get(1)) < 200
    assert Mixture(d.limit(0), t).copies.count() == 0 and Mixture(d.limit(0), t).shares.count() == 1
    assert Mixture(d, t.limit(0)).copies.count() == 0


def test_spelling(spark):
    df = spark.createDataFrame([(" Quillon  Mercury ",), ("QUILLON_MERCURY",), ("quillon-mercury",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(tidy_source(df.s)).collect()] == ["quillon_mercury"] * 3 + [None, None]


def test_copies_of_the_exact_mix_are_registered(spark, tmp_path):
    from tideline.llm.catalogue import queries

    data = [("word " * (5 + i % 20), "hot") for i in range(2000)] + [("word " * 10, "small")] * 40
    docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    targets(spark, [("hot", 3.0, 1), ("small", 1.0, 2)]).write.parquet(f"{tmp_path}/mix_target.parquet")
    got = {r.source: r.n for r in queries()["p7_exact_mix"](spark, str(tmp_path)).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert got["small"] / sum(got.values()) == pytest.approx(0.25, abs=0.01)
    assert got["hot"] / sum(got.values()) == pytest.approx(0.75, abs=0.01)
