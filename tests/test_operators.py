"""Hand values, identities, restatements and refusals."""
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwarden import constants as C, schema
from bandwarden.functions import clock, exact, geometry as G, keys, stats, units as U
from bandwarden.operators import (align, assignment, blocks as B, bootstrap, census, eras, evidence, fine as N, gate, policy,
                                  quality as K, reduce, spectra as P, thresholds, trials)
from bandwarden.sources import inventory, products, views as V

c = F.col
SF = "/root/testdata/sf0.001"


def one(df):
    return df.first()


# ------------------------------------------------------------------ exactness
def test_exact_compare_at_the_64_bit_edge(spark):
    big = 2**64 - 1
    rows = [(str(big), 10**9, str(big), 10**9), (str(big), 10**9 + 1, str(big), 10**9), (str(big - 1), 10**9, str(big), 10**9), ("0", 5, "0", 7)]
    df = spark.createDataFrame(rows, "a string, b long, c string, d long").select(
        c("a").cast("decimal(20,0)").alias("a"), "b", c("c").cast("decimal(20,0)").alias("c"), "d")
    got = [tuple(r) for r in df.select(exact.exact_greater(c("a"), c("b"), c("c"), c("d")), exact.exact_equal(c("a"), c("b"), c("c"), c("d"))).collect()]
    want = [(int(a) * b > int(e) * f, int(a) * b == int(e) * f) for a, b, e, f in rows]
    assert got == want


def test_mask_tie_keeps_and_zero_reference_is_invalid(spark):
    df = spark.createDataFrame([(6, 12, 6000, 12000), (7, 12, 6000, 12000), (7, 0, 6000, 12000)], "p long, r long, t long, n long")
    got = [r[0] for r in df.select(exact.reject_mask(c("p"), c("r"), c("t"), c("n"))).collect()]
    assert got == [False, True, False]
    assert df.select(exact.coarse_ratio(c("p"), c("r"))).collect()[2][0] is None


def test_half_rational_is_the_best_approximation(spark):
    values = [0.5000001, 0.333333, 1.25, float(np.pi) / 6]
    df = U.with_half_rational(spark.createDataFrame([(v,) for v in values], "v double"), "v", 1000)
    for r in df.collect():
        best = Fraction(r["v"]).limit_denominator(1000)
        assert (int(r["half_num"]), int(r["half_den"])) == (best.numerator, best.denominator)


def test_shelf_round_trip_and_composite(spark):
    df = spark.createDataFrame([(-3.0,), (12.5,)], "x double")
    for r in df.select("x", U.shelf_to_excess_db(U.excess_to_shelf_db(c("x"))).alias("y")).collect():
        assert r["y"] == pytest.approx(r["x"], abs=1e-12)
    assert U.composite_to_shelf_db() == pytest.approx(-10 * np.log10(1 + 10**-1.13))
    with pytest.raises(ValueError):
        U.capture_db(0.0)


# ------------------------------------------------------------------- geometry
def test_channels(spark):
    assert G.parse_channels("14,18:20,36") == [14, 18, 19, 20, 36]
    assert G.parse_channels("20:18") == [20, 19, 18]
    for bad in ("", "13", "70:72"):
        with pytest.raises(ValueError):
            G.parse_channels(bad)
    t = {r["physical_channel"]: r for r in G.channel_table(spark).collect()}
    assert len(t) == 56 and t[14]["pilot_hz"] == 470309441.0 and t[14]["freq_id"] == 844
    df = spark.createDataFrame([(470309441.0,), (470309441.0 + 195000,), (470309441.0 + 196000,), (900e6,)], "f double")
    assert [r[0] for r in df.select(G.nearest_channel(c("f"))).collect()] == [14, 14, None, None]


def test_circular_axes(spark):
    df = spark.createDataFrame([(0, 255), (255, 0), (128, 0), (3, 1)], "a int, b int")
    assert [r[0] for r in df.select(G.circular_delta(c("a"), c("b"), 256)).collect()] == [1, -1, -128, 2]
    assert one(spark.range(1).select(G.circular_window(F.lit(1), 2, 256)))[0] == [255, 0, 1, 2, 3]
    assert [r[0] for r in df.select(G.marginal_bin(F.lit(1.0e6), F.lit(0.0), F.lit(1))).collect()] == [None] * 4


def test_lmst_and_calendar(spark):
    df = spark.createDataFrame([(1577836800.0,), (1593561600.5,)], "t double")
    jd = np.array([1577836800.0, 1593561600.5]) / 86400 + 2440587.5
    days = jd - 2451545.0
    cent = days / 36525
    deg = 280.46061837 + 360.98564736629 * days + 0.000387933 * cent**2 - cent**3 / 38710000
    np.testing.assert_allclose([r[0] for r in df.select(clock.lmst_hours(c("t"))).collect()], np.mod(deg - 119.6175, 360) / 15, rtol=1e-12)
    got = [tuple(r) for r in df.select(F.hour(clock.civil_ntz(c("t"))), clock.quarter_label(c("t")), clock.month_index(c("t"))).collect()]
    assert got == [(16, "2020Q1", 13), (17, "2020Q3", 19)]


def test_event_keys_and_versions(spark):
    df = spark.createDataFrame([("a\\b\\baseband_5_829.h5", 829), ("x/baseband_829_844.h5", 844), ("plain.h5", 1)], "u string, f long")
    assert [r[0] for r in df.select(keys.source_event_key(c("u"), c("f"))).collect()] == ["a/b/baseband_5.h5", "x/baseband_829.h5", "plain.h5"]
    v = spark.createDataFrame([("det-x/1.2 kernel=2.1.0 source=abc K=128",), ("det-x/9.9 kernel=2.1.0 source=zzz K=128",)], "v string")
    assert v.select(keys.version_geometry(c("v"))).distinct().count() == 1


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 10)], "k long, n long")
    lo, hi = stats.wilson(c("k"), c("n"))
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got[0] == (None, None) and got[1][0] == 0.0 and got[2][1] == 1.0
    assert got[3] == (pytest.approx(0.107789, abs=1e-5), pytest.approx(0.603222, abs=1e-5))


def test_edge_bins_match_numpy(spark):
    from bandwarden.operators.histograms import RATIO_EDGES
    r = np.random.default_rng(2)
    x = np.concatenate([10 ** r.uniform(-2, 4, 2000), RATIO_EDGES, [0.0, -1.0]])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    for edges in (RATIO_EDGES, RATIO_EDGES[::4], [0.5, 1.0, 2.0]):
        got = stats.with_edge_bin(df, "b", c("x"), edges).orderBy("i").toPandas()["b"].to_numpy()
        assert (got == np.searchsorted(edges, x, side="right") - 1).all()


# ------------------------------------------------------------- gate and align
def test_gate_reasons_in_order(spark):
    rows = [(0, 0, 1.0, None), (5, 10, float("nan"), 1.0), (5, 10, 129.0, 1.0), (5, 10, 128.0, 1.0), (5, 10, 1.0, float("inf")), (5, 10, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "p_target long, p_ref_sum long, baseband_power double, f double").withColumn("valid", c("p_ref_sum") > 0)
    got = [r["reasons"] for r in gate.with_reasons(df).collect()]
    assert got == [[C.REASONS[0], C.REASONS[1]], [C.REASONS[2]], [C.REASONS[3]], [C.REASONS[4]], [C.REASONS[5]], []]


def test_refusals(spark):
    df = spark.createDataFrame([(14, 1, 0), (14, 1, 0)], "physical_channel int, event_id long, frame_in_unit int")
    with pytest.raises(gate.SurveyRefused):
        gate.drop_channels(df, [14])
    with pytest.raises(gate.SurveyRefused):
        align.align_frames(df, strict=True)
    assert one(gate.identity_violations(df, ["physical_channel", "event_id", "frame_in_unit"]))["duplicate_identity"] == 1
    with pytest.raises(gate.SurveyRefused):
        K.require_clean(K.count_rules(df, {"never": F.lit(True)}))


def test_empty_intersection_is_refused(spark):
    df = spark.createDataFrame([(14, 1, 0), (15, 2, 0)], "physical_channel int, event_id long, frame_in_unit int")
    with pytest.raises(ValueError):
        align.align_frames(df, strict=True)


def test_event_metadata_rules(spark):
    rows = [("a", 14, 1, 10, 2.56e-6, 100.0), ("a", 15, 1, 10, 2.56e-6, 100.0),
            ("b", 14, 2, 11, 2.56e-6, 100.0), ("b", 15, 2, 12, 2.56e-6, 100.0),
            ("c", 14, 3, 11, 2.56e-6, 100.0), ("c", 15, None, 11, 2.56e-6, 100.0),
            ("d", 14, 4, 11, 2.56e-6, 100.0), ("d", 15, 4, 11, 2.56e-6, 100.0 + 1.2e-6),
            ("e", 14, 5, 11, 2.56e-6, 100.0), ("e", 15, 5, 11, 2.56e-6, 100.0 + 1.3e-6)]
    df = spark.createDataFrame(rows, "event_key string, physical_channel int, event_id long, time0_fpga long, period double, unit_time0 double")
    got = {r["event_key"]: r["disagrees"] for r in align.event_metadata_violations(df, 2).collect()}
    assert got == {"b": ["time0_fpga"], "c": ["event_id"], "e": ["unit_time0"]}


def test_chunks_hand_values(spark):
    rows = [(i, 14, i < 5, i == 2, float(i), 1.0 * i, None) for i in range(6)]
    df = spark.createDataFrame(rows, "frame_index long, physical_channel int, valid boolean, reject boolean, baseband_power double, q_db double, shelf_db double")
    got = reduce.chunk_reductions(df, seconds=3.0, nfft=1, sample_rate=1.0, max_rows=6).orderBy("chunk_index").collect()
    assert [(r["chunk_start_frame"], r["chunk_stop_frame"], r["valid_count"], r["masked_count_valid"]) for r in got] == [(0, 3, 3, 1), (3, 6, 2, 0)]
    assert got[0]["input_power_mean"] == 1.0 and got[0]["cleaned_power_mean"] == 0.5 and got[1]["q_db_max"] == 4.0


def test_pending_and_stale(spark):
    enum = spark.createDataFrame([("a", "na"), ("b", "nb"), ("c", "nc"), ("d", "nd")], "stable_key string, name string")
    saved = spark.createDataFrame([("a",)], "stable_key string")
    quar = spark.createDataFrame([("b", "x"), (None, "nc")], "stable_key string, name string")
    assert [r[0] for r in evidence.pending_units(enum, saved, quar).select("stable_key").collect()] == ["d"]
    assert evidence.stale_units(saved.withColumnRenamed("stable_key", "unit_key"), enum.withColumnRenamed("stable_key", "unit_key")).count() == 0


# ----------------------------------------------------------------- blocks
@pytest.fixture(scope="module")
def packed(spark):
    r = np.random.default_rng(5)
    raw = r.integers(0, 256, (4, 64, 3), dtype=np.uint8)
    df = spark.createDataFrame([(i, bytearray(raw[i].tobytes())) for i in range(4)], "frame int, payload binary")
    w = [(t, k, int(a), int(b)) for t in range(3) for k, (a, b) in enumerate(r.integers(-7, 8, (8, 2)))]
    return raw, df, w, spark.createDataFrame(w, "term int, k int, wr int, wi int")


@pytest.mark.parametrize("inverted", [False, True])
def test_block_job_matches_loops(packed, inverted):
    raw, df, w, weights = packed
    got = {r["frame"]: r for r in B.detect_frames(df, weights, ["frame"], 3, inverted).collect()}
    wt = np.array([[complex(a, b) for t, k, a, b in w if t == term] for term in range(3)])
    for i in range(4):
        x = ((raw[i] >> 4).astype(int) - 8) + 1j * ((raw[i] & 15).astype(int) - 8)
        z = np.zeros((3, 3, 8), complex)
        for s in range(3):
            for win in range(8):
                seg = x[win * 8:win * 8 + 8, s]
                z[:, s, win] = wt.conj() @ (seg[::-1] if inverted else seg)
        p = (np.abs(z) ** 2).sum(axis=(1, 2))
        assert [got[i][k] for k in ("p_target", "p_lower", "p_upper")] == [round(v) for v in p]
        assert got[i]["baseband_power"] == pytest.approx((np.abs(x) ** 2).mean())
        spec = (np.abs(np.fft.fft(z, 16, axis=2)) ** 2).sum(axis=1)
        np.testing.assert_allclose(got[i]["fine_ratio"], 2 * spec[0] / (spec[1] + spec[2]), rtol=1e-5)


def test_tone_lands_in_its_bin(spark):
    n = np.arange(128)
    x = 7 * np.exp(2j * np.pi * 0.25 * n)
    byte = ((np.rint(x.real).astype(int) + 8) << 4) | (np.rint(x.imag).astype(int) + 8)
    df = spark.createDataFrame([(0, 14, True, False, bytearray(byte.astype(np.uint8).tobytes()))], "frame int, physical_channel int, valid boolean, reject boolean, payload binary")
    m = one(B.coarse_marginal(df, ["frame"], 1, 8))
    assert int(np.argmax(m["marginal"])) == 2 and sum(m["marginal"]) == pytest.approx(64 * m["band_power"])
    s = B.integrated_spectra(df, ["physical_channel"], 1).toPandas().sort_values("bin")
    assert int(s["before"].to_numpy().argmax()) == 32
    assert s["before"].sum() == pytest.approx(128**2 * m["band_power"])
    P.require_empty(s_df := K.audit_spectra(spark.createDataFrame(s[["before", "after"]])).where("n > 0"), "spectra")


def test_detector_function_can_be_replaced(packed):
    raw, df, w, weights = packed
    def doubled(re, im, wr, wi, inverted):
        zr, zi = B.project(re, im, wr, wi, inverted)
        return 2 * zr, 2 * zi
    a = B.detect_frames(df, weights, ["frame"], 3).select("frame", "p_target")
    b = B.analyze("detector", df, weights, ["frame"], 3, detector=doubled).select("frame", c("p_target").alias("p4"))
    assert a.join(b, "frame").where("p4 <> 4*p_target").count() == 0
    with pytest.raises(KeyError):
        B.analyze("unknown", df)


def test_injection_recovers_power(spark):
    r = np.random.default_rng(0)
    raw = [bytearray(r.integers(0x66, 0x9a, 256, dtype=np.uint8).tobytes()) for _ in range(3)]
    df = spark.createDataFrame([(i, i * 256, raw[i]) for i in range(3)], "frame int, first_sample long, payload binary")
    out = B.inject_tone(df, ["frame"], 1, 0.1, 4.0, 9)
    again = B.inject_tone(df.where("frame = 2"), ["frame"], 1, 0.1, 4.0, 9)
    assert out.where("frame = 2").first()["payload"] == again.first()["payload"]
    assert one(B.injection_manifest(out, [], 4.0))["clip_count"] >= 0


def test_rank_violations(spark):
    df = spark.createDataFrame([(bytearray(b"1234"), 2), (bytearray(b"12345"), 2)], "payload binary, n_streams int")
    assert B.rank_violations(df, 2).count() == 1


# ------------------------------------------------------------------- fine
@pytest.mark.parametrize("raised", [0, 1, 9])
def test_cfar_reads_its_levels_off_an_even_ladder(spark, raised):
    """Null bins on an even ladder put every quantile at its own share of the ladder; ``raised`` of them are moved far up."""
    empty = spark.range(1).select(N.null_bulk_bins(F.lit(5), 3, 64).alias("bulk"))
    bulk = one(empty)["bulk"]
    steps = len(bulk) - 1
    ladder = np.random.default_rng(raised).permutation(steps + 1) / steps      # 0 to 1 in even steps
    x = np.full(64, 0.5)
    x[bulk] = np.where(ladder * steps > steps - raised, 90.0 + ladder, ladder)
    x[3], x[5] = 1.9, 1.1
    row = one(N.with_cfar(empty.withColumn("fine_ratio", F.array(*[F.lit(float(v)) for v in x])), "bulk"))
    crowded = raised > C.CFAR_FALLBACK_FRACTION * (steps + 1)
    level, foot, part = (0.25, 0.02275, 2) if crowded else (0.5, 0.1587, 1)
    assert row["fallback"] == crowded
    assert row["location"] == pytest.approx(level) and row["scale"] == pytest.approx((level - foot) / part)
    above = [b for b in range(64) if (x[b] - level) * part / (level - foot) > N.false_alarm_factor(1e-3)]
    count = sum(b in bulk for b in above)
    assert row["detected"] == above and (count > raised if crowded else count == raised)
    assert row["null_fraction"] == pytest.approx(count / (steps + 1))


def test_fine_decision_big_integers(spark):
    t = [2**63 - 1 - i for i in range(64)]
    df = spark.createDataFrame([(t, [2**62] * 64, [2**62] * 64, 5, list(range(0, 64, 2)))], "t array<long>, lo array<long>, up array<long>, a int, bulk array<int>")
    r = one(N.with_fine_decision(df, "t", "lo", "up", "a", "bulk", 3, 65536, 1))
    ranked = sorted(range(0, 64, 2), key=lambda b: t[b])
    assert (r["rank_bin"], r["usable"], r["mask"]) == (ranked[3], True, 1) and r["fired_bin"] == 4
    assert not one(N.with_fine_decision(df, "t", "lo", "up", "a", "bulk", 40, 65536, 1))["usable"]
    with pytest.raises(ValueError):
        N.with_fine_decision(df, "t", "lo", "up", "a", "bulk", 3, 0, 1)


def test_fine_decisions_order_near_ties_exactly():
    rng = np.random.default_rng(9)
    n, hw, mult, rank = 16, 2, 66000, 4

    def plain(t, lo, up, a, null):
        value = [Fraction(2 * int(x), int(p) + int(q)) if p + q else None for x, p, q in zip(t, lo, up)]
        usable = sorted((value[b], b) for b in null if value[b] is not None)
        if rank >= len(usable):
            return 0, 0, len(usable), -1, -1
        level = usable[rank][0]
        fired = next((b for b in ((a + s) % n for s in range(-hw, hw + 1)) if value[b] is not None and value[b] * 65536 > level * mult), -1)
        return int(fired >= 0), 1, len(usable), min(b for v, b in usable if v == level), fired

    t, lo, up, null, anchor = [], [], [], [], []
    for k in range(400):
        big = [2**61 + int(x) for x in rng.integers(0, 3, n)] if k % 2 else [int(x) for x in rng.integers(0, 4, n)]
        side = [2**61 - int(x) for x in rng.integers(0, 3, n)] if k % 2 else [int(x) for x in rng.integers(0, 3, n)]
        if k % 4 == 3:   # on the limit itself, or one beside it
            big = [65536 * 10**12] * n
            side = [65536 * 10**12] * n
            big[k % n] = 66000 * 10**12 + (k // 4) % 3 - 1
        t.append(np.array(big))
        lo.append(np.array(side))
        up.append(np.array(side))
        null.append(np.flatnonzero(rng.random(n) < 0.6))
        anchor.append(int(rng.integers(0, n)))
    got = N.rational_decisions(t, lo, up, np.array(anchor), null, rank, mult, hw)
    assert [tuple(r) for r in got.tolist()] == [plain(*x) for x in zip(t, lo, up, anchor, null)]


def test_peaks_keep_the_taller_of_close_pair():
    y = np.array([0, 1, 0, 3, 2.5, 2.8, 0, 0, 5, 0.0])
    assert N.peaks(y, 0.5, 0.5, 1) == [1, 3, 8]
    assert N.peaks(y, 0.5, 0.5, 3) == [3, 8] or N.peaks(y, 0.5, 0.5, 3) == [1, 5, 8]
    assert N.rise(y, 5) == pytest.approx(0.3)


def test_lines_need_prominence(spark):
    r = np.random.default_rng(6)
    p = 1 + 0.02 * r.random(256)
    p[40], p[42], p[200] = 100.0, 60.0, 50.0
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(p)], "s int, bin int, power double")
    ax = P.with_axis(df, 256, 50.0, 1, 0.0)
    got = P.extract_lines(ax, "s", 50.0, 30e3, 6.0, 6.0, 150.0).orderBy("offset_hz").collect()
    assert [round(x["offset_hz"]) for x in got] == [(200 - 256) * 50, 2000]


def test_notch_replaces_the_tone_only(spark):
    p = np.ones(64)
    p[30:33] = [3.0, 50.0, 3.0]
    df = spark.createDataFrame([(0, i, float(v), 1.0, float(i)) for i, v in enumerate(p)], "s int, pos int, power double, background double, rf_hz double")
    g = P.tone_groups(df, "s")
    out = P.notch(df, g, "s", pad=1).orderBy("pos").toPandas()
    assert (out["notched"] == 1.0).all() and (out["power"] != out["notched"]).sum() == 3


# ------------------------------------------------------ calibration and eras
def test_era_step_is_found(spark):
    r = np.random.default_rng(7)
    rows = [(ch, m, float(0.1 * r.standard_normal() + (6.0 if ch == 15 and m >= 20 else 0.0))) for ch in (14, 15) for m in range(40)]
    df = spark.createDataFrame(rows, "physical_channel int, month int, level_db double")
    got = [(r["physical_channel"], r["era"], r["month_start"], r["month_end"], r["n_units"]) for r in eras.segment(df, max_rows=80).orderBy("physical_channel", "era").collect()]
    assert got == [(14, 0, 0, 39, 40), (15, 0, 0, 19, 20), (15, 1, 20, 39, 20)]
    verdict = {r[0]: r[2] for r in eras.era_agreement(eras.segment(df, max_rows=80), spark.createDataFrame([(15,)], "physical_channel int")).collect()}
    assert verdict == {14: "single", 15: "agrees"}


def test_rank_sum_ties():
    months = np.arange(24)
    assert not eras.split_scores(months, np.ones(24)).any()
    score = eras.split_scores(months, np.r_[np.arange(12.0) / 100, 50 + np.arange(12.0) / 100])
    assert score.argmax() == 12 and abs(score[12] - 50 * 72 / np.sqrt(300)) < 1e-9


def test_sweep_keeps_equal_to_direct_count(spark):
    df = V.detector_frames(spark, SF)
    got = {(r["physical_channel"], r["excess_db"]): r["kept_fraction"] for r in thresholds.threshold_sweep(df, [0.02, 1.0]).collect()}
    pdf = df.where("valid").select("physical_channel", "f", "mu0").toPandas()
    for (ch, x), kept in got.items():
        g = pdf[pdf["physical_channel"] == ch]
        assert kept == pytest.approx((g["f"] <= g["mu0"] * 10 ** (x / 10)).mean(), abs=1e-12)
    assert thresholds.sweep_anchor_mismatches(df).count() == 0


def test_rational_thresholds_agree_with_floats(spark):
    df = V.detector_frames(spark, SF)
    mu = df.where("valid").groupBy("physical_channel").agg(F.lit(1.000123).alias("mu_hat"), F.min("mu0").alias("mu0"))
    for r in thresholds.rational_thresholds(df, mu).collect():
        best = Fraction(1.000123 / 2).limit_denominator(2**16)
        assert (int(r["p"]), int(r["q"])) == (best.numerator, best.denominator)
        assert r["mismatch_ceiling"] <= r["n"] * 0.001


def test_bootstrap_error_matches_theory(spark):
    r = np.random.default_rng(12)
    pdf = pd.DataFrame({"k": 1, "u": np.arange(400), "h": r.binomial(20, 0.3, 400).astype(float), "n": 20.0})
    got = one(bootstrap.ratio_band(spark.createDataFrame(pdf), ["k"], "u", "h", "n", 200, 3, max_rows=400))
    want = pdf["h"].std() / 20 / np.sqrt(400)
    assert got["error"] == pytest.approx(want, rel=0.2) and got["low"] < pdf["h"].sum() / 8000 < got["high"]


def test_resampling_is_repeatable(spark):
    pdf = pd.DataFrame({"k": 1, "u": np.arange(50), "h": np.arange(50.0), "n": 1.0})
    run = lambda parts: sorted(map(tuple, bootstrap.resampled_sums(spark.createDataFrame(pdf).repartition(parts), ["k"], "u", ["h", "n"], 5, 1, 50).collect()))
    assert run(2) == run(7) and all(x[-1] == 50.0 for x in run(3))


def test_draws_leave_a_task_as_counts_only(spark):
    """One row per (group, replicate, block) instead of one per draw, and the picks of ``draw``."""
    seed, n = 31, 3000
    units = spark.range(n).select((F.col("id") % 2).alias("k"), F.col("id").alias("u"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("h"), F.lit(0.5).alias("x"))
    ranked = bootstrap.ranked_units(units, ["k"], "u", n)
    rows = bootstrap.draw_counts(ranked, ["k"], 40, seed).collect()
    assert len(rows) == 2 * 40 and all(bootstrap._unpack(bytes(r["_w"]), r["_n"]).sum() == n // 2 for r in rows)
    drawn = spark.range(n // 2).crossJoin(spark.range(40).withColumnRenamed("id", "r")).select(
        "r", bootstrap.draw(seed, "r", "id", F.lit(n // 2)).alias("p")).toPandas()
    got = {(r["k"], r["replicate"]): (r["h"], r["x"]) for r in bootstrap.resampled_sums(units, ["k"], "u", ["h", "x"], 40, seed, n).collect()}
    for k in (0, 1):
        drawn["v"] = (2 * drawn["p"] + k).where((2 * drawn["p"] + k) % 7 > 0, 0)
        want = drawn.groupby("r")["v"].sum()
        assert all(got[k, r] == (want[r], n / 4) for r in range(40))


def test_draws_over_several_spans_of_ranks(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(bootstrap, "SPAN_RANKS", 400)
    rows = pa.RecordBatch.from_pydict({"k": [5] * 3, "_u": [1000] * 3, "replicate": [2] * 3, "_from": [0, 400, 800]})
    out = pa.Table.from_batches(list(bootstrap._counter(7, ["k"], 200, ["k", "replicate", "_block", "_n", "_w"])(iter([rows]))))
    got = np.concatenate([bootstrap._unpack(w, n) for n, w in zip(out["_n"].to_pylist(), out["_w"].to_pylist())])
    assert out["_block"].to_pylist() == [0, 1, 2, 3, 4]
    np.testing.assert_array_equal(got, np.bincount(bootstrap._picks(7, 2, 0, 1000, 1000), minlength=1000))
    many = np.array([0, 300, 70000])
    np.testing.assert_array_equal(bootstrap._unpack(bootstrap._pack(many), 3), many)


def test_weighted_high_quantile_against_brute_force(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": 1, "u": r.integers(0, 30, 2000), "x": r.standard_normal(2000)})
    got = one(bootstrap.weighted_high_quantile(spark.createDataFrame(pdf), ["k"], "u", "x", 0.95, 60, max_rows=2000))
    assert got["replicates"] == 60 and got["low"] <= np.quantile(pdf["x"], 0.95) + 0.1 and got["high"] >= np.quantile(pdf["x"], 0.95) - 0.1


def test_crossing_outside_is_undefined(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.8)], "x int, rate double")
    r = one(trials.crossing(df, [], "x", "rate", 0.5))
    assert r["bracketed"] and r["estimate"] == pytest.approx(3 + (0.5 - 0.3) / 0.5) and r["adjustment"] == pytest.approx(0.1)
    assert not one(trials.crossing(df, [], "x", "rate", 0.9))["bracketed"]


def test_recovery_fit_finds_the_gain(spark):
    df = spark.createDataFrame([(float(a), 0.01 + 0.2 * a * a, 0.001 + 0.001 * a, a * a) for a in range(6)], "amplitude double, rho_hat double, rho_sem double, injected_power int")
    r = one(trials.recovery_fit(df))
    assert r["gain"] == pytest.approx(0.2) and r["floor"] == pytest.approx(0.01) and r["log_slope"] == pytest.approx(1.0)


def test_paired_trials_refuse_duplicates(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 5)], "trial int, snr int")
    with pytest.raises(ValueError):
        trials.paired_trials(df, "trial", "snr", strict=True)


def test_crossing_bootstrap_ships_no_draws(spark):
    """Draws are counted in the task that makes them; the plan explodes replicates, never trials by replicates."""
    r = np.random.default_rng(4)
    rows = [(t, s, float(r.random() + s / 10)) for t in range(200) for s in range(8)]
    df = spark.createDataFrame(rows, "trial long, snr int, v double")
    out = trials.paired_crossing_bootstrap(df, "trial", "snr", "v", 0.9, 0.4, 50, 7)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    x1 = (np.arange(50)[:, None] * 1000003 + np.arange(200) * 7919 + 7 * 104729 + 12345) % 2147483647
    x2 = (x1 * x1 + x1 * 48271 + 1) % 2147483647
    pick = ((x2 * x2 + x2 * 69621 + 3) % 2147483647) % 200
    hit = np.array([v > 0.9 for _, _, v in rows]).reshape(200, 8)
    y = np.maximum.accumulate(hit[pick].mean(axis=1), axis=1)
    found = []
    for own in y:
        at = next((i for i in range(1, 8) if own[i - 1] < 0.4 <= own[i]), None)
        if at is not None:
            found.append(at - 1 + (0.4 - own[at - 1]) / (own[at] - own[at - 1]))
    got = out.first()
    assert got["valid_replicates"] == len(found) and got["median"] == pytest.approx(np.quantile(found, 0.5))


def test_census_rules(spark):
    df = spark.createDataFrame([(14, -1.0), (None, 5.0), (15, 5.0)], "rf_channel int, distance_km double")
    assert census.census_violations(df).count() == 2
    with pytest.raises(ValueError):
        census.associate_lines(V.lines(spark, SF), V.census(spark, SF), "best")


def test_ranges_cross_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in [*range(4090, 4100), 5000, 5001]], "k string, freq_id long")
    assert sorted(tuple(r) for r in policy.contiguous_ranges(df, ["k"]).collect()) == [("a", 4090, 4099), ("a", 5000, 5001)]


def test_assignment_prefers_equal_frames_and_uses_events_once(spark):
    day = lambda n: pd.Timestamp("2020-01-01") + pd.Timedelta(days=n)
    ev = pd.DataFrame([(14, 1, 1, day(0), 5, "A"), (14, 2, 2, day(0), 7, "B"), (14, 3, 3, day(1), 5, "A"), (14, 4, 4, day(10), 1, "A"), (14, 5, 5, day(10), 2, "B")],
                      columns=["physical_channel", "id", "order", "day", "n_frames", "event_class"])
    un = pd.DataFrame([(14, 10, 1, day(0), 7), (14, 11, 2, day(0), 9), (14, 12, 3, day(0), 9), (14, 13, 4, day(0), 9), (14, 14, 5, day(10), 9), (14, 15, 6, day(20), 9)],
                      columns=["physical_channel", "id", "order", "day", "n_frames"])
    mk = lambda p: spark.createDataFrame(p).withColumn("day", c("day").cast("date")).withColumn("physical_channel", c("physical_channel").cast("int"))
    got = {r["unit_id"]: (r["event_id"], r["event_class"], r["outcome"]) for r in assignment.assign_units(mk(un), mk(ev)).collect()}
    assert got == {10: (2, "B", "exact"), 11: (1, "A", "daypure"), 12: (3, "A", "daypure"), 13: (None, None, "orphan"), 14: (4, None, "mixed"), 15: (None, None, "orphan")}


def _assigned_one_by_one(units, events):
    free, out = sorted(events, key=lambda e: (e[2], e[1])), {}
    for ch, uid, _, day, n in sorted(units, key=lambda u: (u[2], u[1])):
        pool = next((p for p in ([e for e in free if e[0] == ch and e[3] == day + pd.Timedelta(days=k)] for k in (0, -1, 1)) if p), None)
        if pool is None:
            out[ch, uid] = (None, None, "orphan")
            continue
        alike = [e for e in pool if e[4] == n]
        some = alike or pool
        pure = len({e[5] for e in some}) == 1
        kind = "exact" if len(alike) == 1 else "mixed" if not pure else "classok" if alike else "daypure"
        out[ch, uid] = (some[0][1], some[0][5] if kind != "mixed" else None, kind)
        free.remove(some[0])
    return out


def test_free_events_are_summed_backwards(spark):
    """A frame that ends with the group is summed anew for each of its rows, which is quadratic in the units of a day."""
    units = spark.createDataFrame([], "physical_channel int, id long, order long, day date, n_frames long")
    plan = assignment._by_rank(units, units.withColumn("event_class", c("n_frames").cast("string")))._jdf.queryExecution().toString()
    assert "unboundedpreceding" in plan.lower() and "currentrow$(), unboundedfollowing" not in plan.lower()


def test_contested_runs_are_spread_by_rows(spark, monkeypatch):
    """Short rows are not packed into few tasks by their bytes."""
    monkeypatch.setattr(assignment, "TASK_ROWS", 10)
    schema = "physical_channel int, id long, order long, day date, n_frames long"
    row = lambda i: (14, i, i, (pd.Timestamp("2020-01-01") + pd.Timedelta(days=3 * (i % 40))).date(), 1 + i % 2)
    units = spark.createDataFrame([row(i) for i in range(160)], schema)
    events = spark.createDataFrame([(*row(i), "A") for i in range(100)], schema + ", event_class string")
    out = assignment.assign_units(units, events)
    assert out.count() == 160 and "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("surplus", [-20, 0, 60, 600])
def test_assignment_equals_one_by_one(spark, surplus):
    r = np.random.default_rng(surplus + 50)
    start = pd.Timestamp("2020-01-01")
    row = lambda i: (int(r.integers(14, 16)), i, int(r.integers(0, 50)), start + pd.Timedelta(days=int(r.integers(0, 30))), int(r.integers(1, 4)))
    units = [row(i) for i in range(160)]
    events = [(*row(i), r.choice(["A", "B", None], p=[.7, .2, .1])) for i in range(160 + surplus)]
    schema = "physical_channel int, id long, order long, day date, n_frames long"
    mk = lambda rows, s: spark.createDataFrame([(*x[:3], x[3].date(), *x[4:]) for x in rows], s)
    got = assignment.assign_units(mk(units, schema), mk(events, schema + ", event_class string")).collect()
    assert len(got) == len(units)
    assert {(x[0], x[1]): tuple(x[2:]) for x in got} == _assigned_one_by_one(units, events)


def test_assignment_query_answers_every_unit(spark):
    from bandwarden.plans.product_queries import unit_assignment
    want = V.units(spark, SF).select("physical_channel", c("event_id").alias("unit_id"))
    got = unit_assignment(spark, SF).select("physical_channel", "unit_id")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


# ------------------------------------------------------ products and sources
def test_products_publish_and_detect_mixing(spark, tmp_path):
    from bandwarden.plans.product_queries import frame_product
    root = str(tmp_path / "p")
    df = frame_product(V.detector_frames(spark, SF))
    gen = products.new_generation()
    products.write_products(root, gen, {"frames": df})
    assert products.newest_generation(spark, root) == gen
    assert products.read_product(spark, root, "frames").count() == df.count()
    assert products.mixed_generations(root, spark, gen).count() == 0
    part = schema.conform(products.stamp(df.limit(3), gen), schema.FRAMES)
    part.write.mode("append").partitionBy("generation_id", "freq_id").parquet(f"{root}/frames")
    assert products.mixed_generations(root, spark, gen).count() == 1


def test_schema_refuses_other_layouts(spark):
    df = spark.createDataFrame([("x", 1)], "unit_key string, freq_id int")
    with pytest.raises(schema.SchemaRefused):
        schema.conform(df, schema.QUARANTINE)
    ok = spark.createDataFrame([("old", "g", 1, 0, 1.0, 1.0)], schema.SPECTRA)
    with pytest.raises(schema.SchemaRefused):
        schema.conform(ok, schema.SPECTRA)


def test_inventory_tolerates_bad_lines(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"unit_key": "a", "freq_id": 5}\nnot json\n{"unit_key": "b"}\n{"unit_key": "c", "freq_id": 4, "extra": 1}\n')
    inv = inventory.read_inventory(spark, str(tmp_path / "i.jsonl"))
    assert [r[0] for r in inventory.frequency_ids(inv).collect()] == [4, 5]


def test_datasets_refuse_mixed_geometry(spark):
    rows = [(14, 844, 1.0, 2, "ts", 4, "u8", "off"), (14, 843, 1.0, 2, "ts", 4, "u8", "off"), (15, 829, 1.0, 2, "ts", 4, "u8", "off")]
    df = spark.createDataFrame(rows, "physical_channel int, freq_id long, center_hz double, rank int, axes string, n_streams int, dtype string, encoding string")
    assert [tuple(r) for r in inventory.dataset_violations(df).collect()] == [(14, ["freq_id"])]


def test_ledger_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), 2), (1.5, 3)], "b double, a long")
    products.write_ledger(df, str(tmp_path / "l"))
    text = sorted(line for f in (tmp_path / "l").glob("*.json") for line in f.read_text().splitlines())
    assert text == ['{"a":2}', '{"a":3,"b":1.5}']
    products.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert one(products.document(df.where("a = 3")))[0] == '{"a":3,"b":1.5}'


def test_reason_map(spark):
    got = gate.reason_map(gate.with_reasons(V.detector_frames(spark, SF))).collect()
    assert all(C.REASONS[4] in r["reasons"] for r in got)


def test_wide_products_compare_exactly(spark):
    from bandwarden.functions import exact
    rng = np.random.default_rng(3)
    top = 2**63 - 1
    draw = lambda: int(rng.integers(0, 2**63 - 1, dtype=np.int64))
    rows = [(draw(), draw(), draw(), draw()) for _ in range(200)]
    rows += [(a, b, a, b) for a, b, _, _ in rows[:20]] + [(a, b, b, a) for a, b, _, _ in rows[:20]] + [(a, b, a, b - 1) for a, b, _, _ in rows[:20]]
    rows += [(top, top, top, top - 1), (top, top - 1, top, top), (top, top, top, top), (0, top, 0, 1), (1, 10**9, 10**9, 1), (top - 1, top - 1, top, top - 2), (top, 0, 0, top)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select("*", exact.wide_greater(*[F.col(x) for x in "abcd"]).alias("g"), exact.rational_mask(F.col("a"), F.col("c"), F.col("d"), F.col("b")).alias("m")).collect()
    for r in got:
        want = r["a"] * r["b"] > r["c"] * r["d"]
        assert r["g"] == want and r["m"] == (want and r["c"] > 0), r
    edge = df.limit(1).select(exact.rational_overflow(F.lit(top), F.lit(1)).alias("a"), exact.rational_overflow(F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(1)).alias("b")).first()
    assert (edge["a"], edge["b"]) == (False, True)


def test_powers_beyond_64_bits_compare_exactly(spark):
    from bandwarden.functions import exact
    rng = np.random.default_rng(4)
    top, scale = 2**63 - 1, 1 << 35
    pairs = [(int(rng.integers(2**28, 2**44)), int(rng.integers(1, 2**44))) for _ in range(60)]
    rows = [(a * scale, b * scale, a * (2**62 // max(a, b)) + step, b * (2**62 // max(a, b))) for a, b in pairs for step in (-1, 0, 1)]
    rows += [(10**24 - 1, 10**24 - 1, top, top - 1), (10**24 - 1, 10**24 - 2, top, top), (10**24 - 1, 10**24 - 1, top, top), (0, 10**24 - 1, 0, top)]
    df = spark.createDataFrame([(str(a), str(b), n, d) for a, b, n, d in rows], "a string, b string, n long, d long")
    p, r = F.col("a").cast("decimal(24,0)"), F.col("b").cast("decimal(24,0)")
    got = df.select(exact.rational_mask(p, r, F.col("n"), F.col("d")).alias("m"), exact.wide_greater(p, F.col("d"), r, F.col("n")).alias("g")).collect()
    assert [(x["m"], x["g"]) for x in got] == [(a * d > n * b,) * 2 for a, b, n, d in rows]


def test_wide_mask_query_takes_large_part_keys(spark, tmp_path):
    from bandwarden.plans.frame_queries import rational_mask_wide
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    li.withColumn("l_partkey", F.col("l_partkey") + 7_000_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    assert rational_mask_wide(spark, str(tmp_path)).count() == li.count()
    assert rational_mask_wide(spark, str(tmp_path)).agg(F.sum("mask")).first()[0] > 0


def test_altered_generations_are_refused(spark, tmp_path):
    root, g = str(tmp_path), "g1"
    layout = "freq_id long, unit_index long, frame_in_unit int, bin int"
    rows = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 5)], layout)
    products.write_products(root, g, {"exceedances": rows}, {"counts": rows.groupBy("bin").count()})
    assert {t: df.count() for t, df in products.read_generation(spark, root).items()} == {"exceedances": 2, "counts.csv": 2}
    with pytest.raises(products.GenerationRefused, match="not published"):
        products.read_generation(spark, root, "g0")
    extra = schema.conform(products.stamp(spark.createDataFrame([(1, 2, 3, 4)], layout), g), schema.EXCEEDANCES)
    extra.write.mode("append").partitionBy("generation_id", "freq_id").parquet(f"{root}/exceedances")
    with pytest.raises(products.GenerationRefused, match="exceedances"):
        products.read_generation(spark, root)


def test_population_sums_see_a_lost_count(spark):
    q = "physical_channel int, quarter string"
    frames = spark.createDataFrame([(14, "a")] * 3 + [(14, "b")] * 2, q)
    tiles = spark.createDataFrame([(14, 0, 2), (14, 5, 7)], "physical_channel int, first int, last int")
    off = spark.createDataFrame([(14, "b")], q)
    df = frames.withColumn("fine_ratio", F.array(*[F.lit(float(i)) for i in range(8)])).withColumn("stat", F.lit(0.5))
    values = N.null_populations(df, tiles, off)
    assert sorted(map(tuple, values.groupBy("quarter", "population", "value").count().collect())) == [
        ("a", "off_pilot", 2.0, 3), ("a", "off_pilot", 7.0, 3), ("a", "on_sky", 0.5, 3),
        ("b", "off_epoch", 0.5, 2), ("b", "off_pilot", 2.0, 2), ("b", "off_pilot", 7.0, 2), ("b", "on_sky", 0.5, 2)]
    counts = values.groupBy("physical_channel", "quarter", "population").agg(F.count("value").alias("n"))
    assert N.population_sums(counts, frames, tiles, off).where("NOT agrees").count() == 0
    short = counts.withColumn("n", F.col("n") - F.when(F.col("population") == "off_epoch", 1).otherwise(0))
    assert [r["population"] for r in N.population_sums(short, frames, tiles, off).where("NOT agrees").collect()] == ["off_epoch"]


def test_layouts_are_compared_down_to_nested_fields(spark):
    from bandwarden.operators import catalogue
    from pyspark.sql.types import StructType
    want = StructType.fromDDL("a long, b array<struct<x: int, y: array<float>>>, c string, d double")
    df = spark.createDataFrame([(1, None, None), (None, None, None)], "a int, b array<struct<x: int, y: array<double>, z: int>>, d double")
    got = sorted(map(tuple, catalogue.layout_problems(df, want, required=("a", "d", "c")).collect()))
    assert got == [("a", "int is not bigint"), ("a", "null in 1 rows"), ("b[].y[]", "double is not float"), ("b[].z", "unknown"),
                   ("c", "missing"), ("d", "null in 2 rows")]
    assert catalogue.layout_problems(spark.createDataFrame([], want), want).count() == 0


def test_catalogue_counts_all_and_lists_the_first(spark):
    from bandwarden.operators.catalogue import Rule, audit
    rules = [Rule("t", "positive", "v <= 0"), Rule("t", "known", "w NOT IN ('a', 'b')"), Rule("t", "small", "v > 1000")]
    df = spark.createDataFrame([(f"k{i:03d}", -i, None if i == 7 else "a") for i in range(50)], "k string, v int, w string")
    got = {r["rule"]: (r["n"], r["first_keys"]) for r in audit({"t": (df, "k")}, rules).collect()}
    assert got == {"positive": (50, "k000 k001 k002"), "known": (1, "k007"), "small": (0, "")}


def test_bytes_by_class_counts_units_without_frames_and_sizes(spark):
    inventory_ = spark.createDataFrame([("a", "s", 10), ("b", "s", None), ("c", "s", 5), ("d", "t", 7)], "unit_key string, scope string, size_bytes long")
    units = spark.createDataFrame([("a", 1, 3), ("b", 1, 2)], "unit_key string, event_id long, n_frames long")
    bad = spark.createDataFrame([("c",), ("c",)], "unit_key string")
    got = {r["scope"]: r for r in evidence.bytes_by_class(inventory_, units, bad, 2.0).collect()}
    assert tuple(got["s"])[1:] == (3, 2, 1, 5, 1, 10.0, 15, 10, 5) and tuple(got["t"])[1:] == (1, 0, 0, 0, 0, 0.0, 7, 0, 0)


def test_eras_are_written_once(spark):
    """Levels, months and eras are read back by later passes; the frames are not joined and numbered anew in each."""
    from bandwarden.plans import calibration_queries as Q
    for run in (Q.era_segmentation, Q.quiet_floor):
        assert "lineitem" not in run(spark, SF)._jdf.queryExecution().toString()
