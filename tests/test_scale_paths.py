"""Paths taken by hot groups must give the results of the plain ones."""
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwarden.operators import exposure, numbering as N, presence, robust, zeropoint as Z
from bandwarden.operators.quantiles import grouped_quantiles
from bandwarden.sources import views as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one key, with ties and a heavy tail."""
    r = np.random.default_rng(3)
    n = 6000
    key = np.where(r.random(n) < 0.34, 0, r.integers(1, 40, n))
    x = np.where(r.random(n) < 0.2, 1.0, np.round(1 + r.standard_normal(n) ** 3, 4))
    x[:5] = [1e9, -1e9, 1e-9, 0.0, 5e8]
    pdf = pd.DataFrame({"k": key, "x": x, "i": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_hot_quantiles_match_numpy(skewed):
    pdf, df = skewed
    specs = {f"q{i}": ("x", q) for i, q in enumerate((0.0, 0.003, 0.5, 0.9, 0.999, 1.0))}
    got = grouped_quantiles(df, ["k"], specs, [F.count("x").alias("n")], limit=200, bins=16, gather=10).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        want = np.quantile(g["x"], [0.0, 0.003, 0.5, 0.9, 0.999, 1.0])
        np.testing.assert_allclose(got.loc[k, list(specs)].to_numpy(float), want, rtol=1e-12, atol=1e-12)
        assert got.loc[k, "n"] == len(g)


def test_hot_quantiles_without_keys_and_with_nulls(skewed):
    pdf, df = skewed
    got = grouped_quantiles(df, [], {"m": (F.when(F.col("x") > 1, F.col("x")), 0.25)}, limit=100, gather=10).first()["m"]
    assert got == pytest.approx(np.quantile(pdf["x"][pdf["x"] > 1], 0.25), rel=1e-12)


def test_hot_numbering(skewed):
    pdf, df = skewed
    got = N.number_within(df, ["k"], ["x", "i"], "r", limit=200).toPandas().sort_values("i")
    want = pdf.sort_values(["k", "x", "i"]).groupby("k").cumcount().sort_index()
    assert (got["r"].to_numpy() == want.to_numpy()).all()


def test_global_numbers(skewed):
    pdf, df = skewed
    got = N.global_number(df, ["x", "i"], "r").toPandas().sort_values(["x", "i"])["r"].to_numpy()
    assert (got == np.arange(len(pdf))).all()


@pytest.mark.parametrize("down", [False, True])
def test_hot_running_sums(skewed, down):
    pdf, df = skewed
    v = df.groupBy("k", "x").agg(F.count("*").alias("n"))
    a = N.running_sums(v, ["k"], "x", ["n"], descending=down, limit=50).toPandas().sort_values(["k", "x"]).reset_index(drop=True)
    b = N.running_sums(v, ["k"], "x", ["n"], descending=down, max_rows=1).toPandas().sort_values(["k", "x"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def _mode(x):
    """Direct search over all windows of every half, with exact fractions."""
    v = sorted(map(Fraction, x.tolist()))
    while len(v) > 3:
        h = -(-len(v) // 2)
        v = min((v[i:i + h] for i in range(len(v) - h + 1)), key=lambda w: w[-1] - w[0])
    pairs = [v[i:i + 2] for i in range(len(v) - 1)]
    widths = [b - a for a, b in pairs]
    closest = [p for p, w in zip(pairs, widths) if w == min(widths)] or [v]
    return float(v[1] if len(closest) == 2 else sum(closest[0]) / len(closest[0]))


@pytest.mark.parametrize("limit", [10**6, 200])
def test_half_sample_mode(spark, limit):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": r.choice([1, 2, 3], 3000, p=[.7, .2, .1])})
    pdf["x"] = r.standard_normal(3000) * pdf["k"] + pdf["k"]
    got = dict(Z.half_sample_mode(spark.createDataFrame(pdf), ["k"], "x", limit=limit).collect())
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(_mode(g["x"].to_numpy()), abs=1e-12)


def test_core_zero_point_paths_agree(spark):
    df = V.detector_frames(spark, SF)
    a = Z.core_zero_point(df, max_rows=1).toPandas().set_index("physical_channel").sort_index()
    b = Z.core_zero_point(df).toPandas().set_index("physical_channel").sort_index()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, check_dtype=False)


def test_superset_counts_match_brute_force(spark):
    r = np.random.default_rng(8)
    sig = pd.Series(r.integers(1, 64, 500)).value_counts()
    df = spark.createDataFrame([(int(s), int(n)) for s, n in sig.items()], "signature long, n_events long")
    got = {x["signature"]: (x["total"], x["closed"]) for x in presence.superset_counts(df, 6).collect()}
    for s in sig.index:
        over = [t for t in sig.index if t & s == s]
        closed = 63
        for t in over:
            closed &= int(t)
        assert got[s] == (int(sig[over].sum()), closed)


def test_skewed_unit_gives_the_same_frames(spark, tmp_path):
    """One order holding a third of the line items is numbered in parts."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    li = li.withColumn("l_orderkey", F.when(F.rand(1) < 0.34, F.lit(7)).otherwise(F.col("l_orderkey")).cast("long"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    keys, order = ["c", "l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    df = spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumn("c", F.col("l_suppkey") % 4)
    a = N.number_within(df, keys, order, "r", limit=100)
    b = N.number_within(df, keys, order, "r", max_rows=1)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_sketch_option(skewed):
    pdf, df = skewed
    got = grouped_quantiles(df.where("k = 0"), ["k"], {"m": ("x", 0.5)}, accuracy=10000).first()["m"]
    assert abs(got - pdf[pdf["k"] == 0]["x"].median()) < 0.05


def test_tails_flags_are_exclusive(spark):
    t = exposure.with_tails(V.detector_frames(spark, SF), F.col("mu0"))
    assert t.where("(hi AND lo) OR (hi AND core) OR (lo AND core)").count() == 0


def test_split_quantiles_keep_groups_and_take_infinities(spark):
    r = np.random.default_rng(12)
    rows = [(0, float(x)) for x in r.standard_normal(400)] + [(0, float("inf"))] * 3 + [(0, float("-inf"))] * 2 + [(0, float("nan"))]
    rows += [(1, None)] * 80 + [(2, float("inf"))] * 70 + [(3, 1e-323 * (i % 3)) for i in range(90)] + [(4, s * 1.7e308) for s in (-1, 1)] * 40
    df = spark.createDataFrame(rows, "k int, x double")
    specs = {"lo": ("x", 0.0), "a": ("x", 0.3), "b": ("x", 0.777), "c": ("x", 0.995), "hi": ("x", 1.0)}
    for keys, aggs in ((["k"], []), (["k"], [F.count("x").alias("n")]), ([], [])):
        plain = grouped_quantiles(df, keys, specs, aggs)
        split = grouped_quantiles(df, keys, specs, aggs, limit=50, gather=20, bins=16)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, split.select(*plain.columns).collect()))
    nothing = grouped_quantiles(df.where("k = 1"), [], {"a": ("x", .5)}, limit=50, gather=20).collect()
    assert [tuple(x) for x in nothing] == [(None,)]


def test_hot_groups_are_counted_by_cell_first(skewed):
    pdf, df = skewed
    want = {k: n for k, n in pdf["k"].value_counts().items() if n > 200}
    assert {r["k"]: r["_n"] for r in N.hot_groups(df, ["k"], 200).collect()} == want
    assert N.hot_groups(df, ["k"], 6000).isEmpty()


def test_equal_values_need_no_rounds(spark, monkeypatch):
    """A hot group of few distinct values is answered from their counts."""
    from bandwarden.operators import quantiles
    monkeypatch.setattr(quantiles, "_round", None)
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * F.col("id") % 97 / 7).alias("x"))
    qs = (0.0, 0.01, 0.31, 0.5, 0.977, 1.0)
    got = grouped_quantiles(df, ["k"], {f"q{i}": ("x", q) for i, q in enumerate(qs)}, limit=200, bins=8, gather=100).first()
    np.testing.assert_allclose(list(got)[1:], np.quantile(df.toPandas()["x"], qs), rtol=1e-12)


def test_large_frame_tables_take_one_exchange_by_event(spark, monkeypatch):
    from bandwarden import constants as C
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    small = V.frames(spark, SF)
    monkeypatch.setattr(C, "HOT_GROUP_ROWS", 100)
    large = V.frames(spark, SF)
    assert large.columns == small.columns and sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    assert "REPARTITION_BY_NUM" in plan(large) and plan(large).count("hashpartitioning(physical_channel") == 0


def test_unit_medians_match_quantiles(spark):
    """Picked middle rows are the quantiles of the value maps, also for units without a core frame, ties and nulls."""
    r = np.random.default_rng(9)
    rows = [(14, int(r.integers(0, 60)), bool(r.random() < 0.6), None if r.random() < 0.1 else int(r.integers(0, 30)), float(r.integers(0, 9)) / 7) for _ in range(300)]
    df = spark.createDataFrame(rows, "physical_channel int, event_id long, core boolean, p long, x double")
    got = robust.unit_medians(df, ["p", "x"])
    assert "percentile" not in got._jdf.queryExecution().toString()
    key = lambda d: sorted(tuple(row) for row in d.select("event_id", "n_core", "base_p", "base_x").fillna(-1.0).collect())
    assert key(got) == key(robust.unit_medians(df, ["p", "x"], limit=10))


def test_settled_centres_read_distinct_values_only(spark, monkeypatch):
    """Rounds over running counts give the centres of rounds over frames; no quantile is searched in a round."""
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"physical_channel": np.repeat([14, 15], 900), "f": np.round(1 + 0.004 * r.standard_normal(1800), 4)})
    df = spark.createDataFrame(pdf).withColumn("physical_channel", F.col("physical_channel").cast("int")).withColumn("mu0", F.lit(1.0))
    start = spark.createDataFrame([(14, 1.001, 1.0), (15, 0.9985, 1.0)], "physical_channel int, centre double, mu0 double")
    monkeypatch.setattr(Z, "grouped_quantiles", None)
    got = {x["physical_channel"]: x["centre"] for x in Z._settle_rounds(df, start, 20, None).collect()}
    for ch, m in ((14, 1.001), (15, 0.9985)):
        f = pdf["f"][pdf["physical_channel"] == ch].to_numpy()
        for _ in range(20):
            last, m = m, float(np.median(f[np.abs(f - m) <= 6e-3]))
            if abs(m - last) < 1e-7:
                break
        assert got[ch] == m


def test_a_large_frame_view_sorts_its_frames_once(spark, monkeypatch):
    """The order of the numbering serves the join with the orders, whose side is the only other sort."""
    want = sorted(map(tuple, V.frames(spark, SF).select(*sorted(V.frames(spark, SF).columns)).collect()))
    monkeypatch.setattr(V.C, "HOT_GROUP_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = V.frames(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("- Sort [") == 2
        assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_audit_reads_its_tables_once(spark):
    """The report is made from the violations that one pass has written, not from the tables again."""
    from bandwarden.operators.catalogue import Rule, audit
    df = spark.range(50).selectExpr("id AS v", "lpad(CAST(id AS STRING), 3, '0') AS k")
    out = audit({"t": (df, "k")}, [Rule("t", "all", "true"), Rule("t", "odd", "v % 2 = 1"), Rule("t", "none", "v < 0")])
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["rule"], r["n"], r["first_keys"]) for r in out.collect()) == [
        ("all", 50, "000 001 002"), ("none", 0, ""), ("odd", 25, "001 003 005")]


def test_catalogue_query_joins_frames_once(spark, monkeypatch):
    from bandwarden.plans import product_queries as Q
    made, plain = [], V.frames
    monkeypatch.setattr(V, "frames", lambda *a: made.append(a) or plain(*a))
    out = Q.audit_catalogue(spark, SF)
    assert len(made) == 1 and "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
