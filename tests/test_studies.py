"""Studies against plain loops, and properties."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import correlation, fib, intraday, patterns, quality, relational, smoothing, studies

SCHEMA = "symbol long, date date, fOpen double, fHigh double, fLow double, fClose double, fVolume double"


def series(spark, n, symbols=(1,), seed=1):
    r = random.Random(seed)
    rows = []
    for s in symbols:
        c = 100.0
        for i in range(n):
            o, c = c, max(1.0, c + r.gauss(0, 2))
            rows.append((s, datetime.date(2020, 1, 1) + datetime.timedelta(i), o, max(o, c) + r.random(), min(o, c) - r.random(), c, float(r.randint(1, 1000))))
    return spark.createDataFrame(rows, SCHEMA)


def test_ema_matches_recursion_and_long_series(spark):
    df = series(spark, 1500)  # longer than one block of the window sums for span 10
    got = studies.ema(df, (10, 50)).orderBy("date").toPandas()
    for span in (10, 50):
        want = got["fClose"].ewm(span=span, adjust=False, min_periods=span).mean()
        pd.testing.assert_series_equal(got[f"ema_{span}"], want, check_names=False, rtol=1e-9)


def test_ema_is_stable_under_prefix(spark):
    whole = studies.ema(series(spark, 60), (10,)).where("date <= '2020-02-09'").orderBy("date").toPandas()
    part = studies.ema(series(spark, 60).where("date <= '2020-02-09'"), (10,)).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(whole, part)


def test_rsi_matches_loop(spark):
    got = studies.rsi(series(spark, 200)).orderBy("date").toPandas()
    change = got["fClose"].diff().to_numpy()
    gain, loss = change[1:15].clip(min=0).mean(), (-change[1:15]).clip(min=0).mean()
    want = [100 * gain / (gain + loss)]
    for c in change[15:]:
        gain, loss = (gain * 13 + max(c, 0)) / 14, (loss * 13 + max(-c, 0)) / 14
        want.append(100 * gain / (gain + loss))
    assert got["rsi"][:14].isna().all()
    assert abs(got["rsi"][14:].to_numpy() - want).max() < 1e-9


def test_rsi_of_rises_and_falls_only(spark):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(20)]
    up = spark.createDataFrame([(1, d, 1.0, 1.0, 1.0, 10.0 + i, 1.0) for i, d in enumerate(days)], SCHEMA)
    down = spark.createDataFrame([(2, d, 1.0, 1.0, 1.0, 90.0 - i, 1.0) for i, d in enumerate(days)], SCHEMA)
    got = studies.rsi(up.union(down)).groupBy("symbol").agg({"rsi": "max"}).toPandas().set_index("symbol").iloc[:, 0]
    assert got[1] == 100 and got[2] == 0


def test_symbols_do_not_mix(spark):
    both = series(spark, 80, (1, 2))
    alone = both.where("symbol = 2")
    for f in (studies.sma, studies.running_high, studies.obv, studies.rsi, studies.change_pct, studies.gap):
        a = f(both).where("symbol = 2").orderBy("date").toPandas()
        b = f(alone).orderBy("date").toPandas()
        pd.testing.assert_frame_equal(a, b)


def test_peaks_take_plateau_middles(spark):
    values = [1, 3, 3, 3, 2, 5, 4, 4, 6, 1]
    rows = [(1, datetime.date(2020, 1, 1) + datetime.timedelta(i), 1.0, 1.0, 1.0, float(v), 1.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    at = [r["date"].day - 1 for r in studies.peaks(df).where("peak = 1").collect()]
    assert sorted(at) == [2, 5, 8]
    heights = {r["date"].day - 1: r["prominence"] for r in smoothing.prominences(df, "fClose").collect()}
    assert heights == {2: 1.0, 5: 1.0, 8: 5.0}
    assert sorted(r["date"].day - 1 for r in smoothing.distant_peaks(df, "fClose", 4).collect()) == [2, 8]


def brute_prominences(x):
    """By the definition, for each strict local maximum (of a plateau its lower middle)."""
    out, i = {}, 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if 0 < i and j + 1 < len(x) and x[i - 1] < x[i] > x[j + 1]:
            p = (i + j) // 2
            left = max((k for k in range(p) if x[k] > x[p]), default=0)
            right = min((k for k in range(p + 1, len(x)) if x[k] > x[p]), default=len(x) - 1)
            out[p] = x[p] - max(min(x[left : p + 1]), min(x[p : right + 1]))
        i = j + 1
    return out


@pytest.mark.parametrize(("block", "searches"), [(4, 3), (16, 1000), (4096, 1000)])
def test_prominences_by_blocks(spark, monkeypatch, block, searches):
    """Random walks, plateaus longer than a block, zigzags that rise or fall all along (whose searches all go to one block, so it is copied), nulls."""
    import random

    r = random.Random(block)
    walk = [0]
    for _ in range(400):
        walk.append(walk[-1] + r.choice([-2, -1, 0, 0, 1, 2]))
    series = {1: walk, 2: [1000] + [k + 3 * (k % 2) for k in range(120)], 3: [-k + 3 * (k % 2) for k in range(120)] + [1000], 4: [0] * 9 + [5] * 13 + [0] * 7 + [5] * 6 + [1], 5: [3], 6: [r.randrange(3) for _ in range(100)]}
    monkeypatch.setattr(smoothing, "BLOCK", block)
    monkeypatch.setattr(smoothing, "ROOTS", 0)
    monkeypatch.setattr(smoothing, "SEARCHES", searches)
    day = datetime.date(2000, 1, 1)
    rows = [(s, day + datetime.timedelta(i), float(v)) for s, x in series.items() for i, v in enumerate(x)]
    got = {}
    for q in smoothing.prominences(spark.createDataFrame([*rows, (1, day - datetime.timedelta(1), None)], "symbol long, date date, v double"), "v").collect():
        got.setdefault(q["symbol"], {})[(q["date"] - day).days] = q["prominence"]
    assert got == {s: p for s, x in series.items() if (p := brute_prominences(x))}


def test_wavelet_taps_are_the_known_ones():
    # fixed values: the published taps of the filter with six vanishing moments
    known = [0.11154, 0.49462, 0.75113, 0.31525, -0.22626, -0.12977, 0.0975, 0.02752, -0.03158, 0.00055, 0.00478, -0.00108]
    assert [round(x, 5) for x in smoothing.daubechies(6)] == known


def plain_denoise(x, scale, p):
    """Level by level with sums over taps, and the transpose of it."""
    low, high = smoothing._bank(p)
    t, steps, now = scale * max(x), [], list(x)
    for _ in range(smoothing.wavelet_levels(len(x), p)):
        e = now + now[-1:] * (len(now) % 2)
        n = len(e)
        c = [[sum(f[j] * e[(2 * o + p - j) % n] for j in range(2 * p)) for o in range(n // 2)] for f in (low, high)]
        steps.append((len(now), [math.copysign(max(abs(v) - t, 0), v) for v in c[1]]))
        now = c[0]
    for size, d in reversed(steps):
        n = 2 * len(d)
        out = [0.0] * n
        for o in range(n // 2):
            for j in range(2 * p):
                out[(2 * o + p - j) % n] += low[j] * now[o] + high[j] * d[o]
        now = out[:size]
    return now


def test_wavelet_denoising_by_definition_and_whole_at_no_threshold(spark):
    """Series of several lengths in one table, odd and even, long enough for 0 to 4 levels."""
    r = random.Random(5)
    series = {n: [math.sin(i / 7) * 10 + r.gauss(5, 3) for i in range(n)] for n in (1, 10, 11, 23, 48, 91, 200)}
    day = datetime.date(2000, 1, 1)
    df = spark.createDataFrame([(n, day + datetime.timedelta(i), v) for n, x in series.items() for i, v in enumerate(x)], "symbol long, date date, v double")
    for scale in (0.0, 0.15):
        got = {(q["symbol"], (q["date"] - day).days): q["smooth"] for q in smoothing.wavelet_denoised(df, "v", scale).collect()}
        assert len(got) == sum(series)
        for n, x in series.items():
            want = plain_denoise(x, scale, 6)
            assert all(abs(got[n, i] - want[i]) < 1e-9 and (scale or abs(got[n, i] - x[i]) < 1e-9) for i in range(n))
    assert smoothing.wavelet_denoised(df.where("symbol < 0"), "v", 0.1).count() == 0


def test_wavelet_of_short_and_long_series_in_one_table(spark, monkeypatch):
    """Series up to BLOCK rows are done whole, others level by level; batches of few rows cut the short ones."""
    monkeypatch.setattr(smoothing, "BLOCK", 60)
    r = random.Random(6)
    series = {n: [r.gauss(5, 3) for _ in range(n)] for n in (1, 11, 22, 45, 60, 61, 100)}
    day = datetime.date(2000, 1, 1)
    df = spark.createDataFrame([(n, day + datetime.timedelta(i), v) for n, x in series.items() for i, v in enumerate(x)], "symbol long, date date, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(q["symbol"], (q["date"] - day).days): q["smooth"] for q in smoothing.wavelet_denoised(df, "v", 0.15).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(series)
    for n, x in series.items():
        assert all(abs(got[n, i] - v) < 1e-9 for i, v in enumerate(plain_denoise(x, 0.15, 6)))


def test_prominences_of_two_columns_beside_the_rows(spark, monkeypatch):
    monkeypatch.setattr(smoothing, "BLOCK", 20)
    r = random.Random(7)
    day = datetime.date(2000, 1, 1)
    values = {n: [[None if r.random() < 0.1 else float(r.randrange(6)) for _ in range(n)] for _ in "ab"] for n in (1, 2, 19, 20, 21, 70)}
    df = spark.createDataFrame([(n, day + datetime.timedelta(i), a, b) for n, (x, y) in values.items() for i, (a, b) in enumerate(zip(x, y, strict=True))], "symbol long, date date, a double, b double")
    got = {(q["symbol"], (q["date"] - day).days): q for q in smoothing.with_prominences(df, {"pa": "a", "pb": "b"}).collect()}
    assert len(got) == sum(values)
    for n, both in values.items():
        for name, x in zip("ab", both, strict=True):
            at = [i for i, v in enumerate(x) if v is not None]
            want = {at[k]: p for k, p in brute_prominences([x[i] for i in at]).items()}
            assert {i: got[n, i]["p" + name] for i in range(n) if got[n, i]["p" + name] is not None} == want


def test_work_on_short_series_has_no_windows_of_taps_and_no_groups(spark):
    df = series(spark, 80, (1, 2))
    for q in (smoothing.wavelet_denoised(df, "fClose", 0.1), smoothing.prominences(df, "fClose")):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "lag(" not in plan and "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = quality.upsert(old, new, ["k"], [relational.F.col("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, quality.upsert(once, new, ["k"], [relational.F.col("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_resample_keeps_volume(spark):
    start = datetime.datetime(2024, 1, 1, 9, 30)
    ticks = spark.createDataFrame([(1, start + datetime.timedelta(minutes=i), i, float(i % 7)) for i in range(100)], "symbol int, ts timestamp, n int, price double")
    bars = intraday.resample(ticks, ["symbol"], "3 minutes", "price", "n")
    assert bars.agg({"trades": "sum", "total": "sum"}).first().asDict() == {"sum(trades)": 100, "sum(total)": float(sum(i % 7 for i in range(100)))}
    first = bars.orderBy("bucket").first()
    assert (first["o"], first["h"], first["l"], first["c"]) == (0.0, 2.0, 0.0, 2.0)


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 2.0, 4.0, None)], "g int, v double")
    got = sorted((r["v"], r["pct"]) for r in relational.pct_rank(df, ["g"], "v").where("v IS NOT NULL").collect())
    assert [p for _, p in got] == [0.25, 0.625, 0.625, 1.0]
    assert relational.nlargest_members(df, ["g"], "v", 2).count() == 3  # the tie stays
    assert relational.chained_isin(df, "v", nlargest=2).count() == 3


def test_fib_run_contains_its_row_and_levels_are_ordered(spark):
    df = fib.numbered(studies.running_high(studies.gap(studies.change_pct(series(spark, 120, range(1, 9))))))
    chosen = fib.max_rows(df)
    run = fib.runs(df, chosen).toPandas()
    assert (run["begin"] <= run["m"]).all() and (run["end"] >= run["m"]).all() and len(run) == 8
    lv = fib.levels(df, fib.runs(df, chosen)).toPandas()
    assert (lv["ret_0_236"] >= lv["ret_0_618"]).all() and (lv["ext_1_618"] <= lv["ext_2_618"]).all()


def test_short_symbols_have_no_run(spark):
    df = fib.numbered(studies.running_high(studies.gap(studies.change_pct(series(spark, 10)))))
    assert fib.max_rows(df).count() == 0


def test_beta_of_the_market_is_one(spark):
    df = studies.change_pct(series(spark, 60))
    got = correlation.beta(df).first()
    assert abs(got["beta"] - 1) < 1e-9 and abs(got["beta_returns"] - 1) < 1e-9


def test_merge_near_runs(spark):
    d = datetime.date
    runs = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 5), 5), (1, d(2024, 1, 10), d(2024, 1, 12), 3), (1, d(2024, 3, 1), d(2024, 3, 5), 3)], "symbol long, first_date date, last_date date, n long")
    assert sorted((r["n"], r["runs"]) for r in patterns.merge_near(runs, 10).collect()) == [(3, 1), (8, 2)]


def test_empty_bars(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (studies.stock_eod, studies.ema, studies.local_extrema, studies.change_pct_grid):
        assert f(empty).count() == 0


def test_kalman_level_by_recursion(spark):
    """Past the row at which the gain has settled, and for gains that settle at once."""
    rng = random.Random(2)
    start = datetime.date(2020, 1, 1)
    values_of = {s: [rng.uniform(1, 100) for _ in range(n)] for s, n in ((1, 420), (2, 1), (3, 40))}
    data = [(s, start + datetime.timedelta(i), v) for s, values in values_of.items() for i, v in enumerate(values)] + [(1, start + datetime.timedelta(5000), None)]
    df = spark.createDataFrame(data, "symbol long, date date, v double")
    for q, r in ((0.01, 1.0), (50.0, 1.0)):
        got = {(x["symbol"], x["date"]): x["level"] for x in smoothing.kalman(df, "v", q, r).collect()}
        assert len(got) == sum(map(len, values_of.values()))
        for s, values in values_of.items():
            level, spread = values[0], 1.0
            for i, v in enumerate(values):
                spread += q
                gain = spread / (spread + r)
                level += gain * (v - level)
                spread *= 1 - gain
                assert abs(got[s, start + datetime.timedelta(i)] - level) < 1e-8
    try:
        smoothing.gains(1e-9, 1.0)
        raise AssertionError
    except ValueError:
        pass


def test_rsi_parts_by_recursion(spark):
    rng = random.Random(3)
    start = datetime.date(2020, 1, 1)
    values = [50.0]
    for _ in range(60):
        values.append(values[-1] + rng.choice([-2, -1, 0, 1, 2]))
    flat = [7.0] * 20
    rows = [(s, start + datetime.timedelta(i), v) for s, x in ((1, values), (2, flat)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol long, date date, fClose double")
    got = {(r["symbol"], r["date"]): r for r in studies.rsi_parts(df).collect()}
    gain = loss = 0.0
    for i in range(1, len(values)):
        up, down = max(values[i] - values[i - 1], 0), max(values[i - 1] - values[i], 0)
        gain, loss = (gain + up / 14, loss + down / 14) if i <= 14 else (13 * gain / 14 + up / 14, 13 * loss / 14 + down / 14)
        r = got[1, start + datetime.timedelta(i)]
        if i < 14:
            assert r["rsi_14"] is None and r["avg_gain"] is None
        else:
            assert abs(r["avg_gain"] - gain) < 1e-9 and abs(r["rsi_14"] - (100 - 100 / (1 + gain / loss))) < 1e-7
    assert all(got[2, start + datetime.timedelta(i)]["rsi_14"] is None for i in range(20))


@pytest.mark.parametrize("part_rows", [7, 100_000])
def test_numbers_of_a_whole_table_in_parts(spark, part_rows):
    """Nulls, a value that half of all rows have, descending and ascending columns."""
    r = random.Random(3)
    rows = [(i, None if i % 11 == 0 else 5.0 if i % 2 else float(r.randrange(50)), r.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v double, s string").repartition(5)
    got = {q["id"]: q["rn"] for q in relational.numbered(df, [("v", True), ("s", False), ("id", False)], part_rows=part_rows).collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2], x[0]))
    assert got == {x[0]: i for i, x in enumerate(order, 1)}
    gaps = {q["id"]: q["idx_diff"] for q in relational.gaps_to_next(df.select("id"), "id", part_rows=part_rows).collect()}
    assert gaps == {i: -1 for i in range(299)} | {299: 1}
    assert relational.numbered(df.where("id < 0"), [("id", False)]).count() == 0


def test_factorize_and_frequencies_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(relational, "PART_ROWS", 20)
    df = spark.createDataFrame([(i, f"v{i % 90:02d}" if i % 7 else None) for i in range(400)], "id long, c string")
    coded, dictionary = relational.factorize(df, "c")
    values = sorted({f"v{i % 90:02d}" for i in range(400) if i % 7})
    assert {r["c"]: r["code"] for r in dictionary.collect()} == {v: i for i, v in enumerate(values)}
    assert all(r["code"] == (values.index(r["c"]) if r["c"] else -1) for r in coded.collect())
    counts = [(r["n"], r["c"]) for r in relational.frequency_codes(df, "c").orderBy("code").collect()]
    assert counts == sorted(counts, key=lambda x: (-x[0], x[1] is not None, x[1] or ""))


def test_linear_model_by_normal_equations(spark):
    from barwright.operators import models

    r = random.Random(8)
    rows = [(x := r.gauss(1000, 1), y := r.gauss(0, 5), 3 * x - 2 * y + 7, 1.0) for _ in range(60)]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0, 1.0)], "x double, y double, z double, same double")
    m = models.linear(df, ["x", "y", "same"], "z")
    assert abs(m.coefficients["x"] - 3) < 1e-9 and abs(m.coefficients["y"] + 2) < 1e-9 and m.coefficients["same"] == 0 and abs(m.intercept - 7) < 1e-6
    double = models.linear(df.withColumn("x2", F.col("x")), ["x", "x2"], "z")
    assert abs(double.coefficients["x"] - double.coefficients["x2"]) < 1e-9
    assert abs(models.linear(df, ["x", "y"], "z", ridge=1e9).coefficients["x"]) < 1e-6
    with pytest.raises(ValueError):
        models.linear(df.where("x < 0"), ["x"], "z")


def brute_tree(rows, depth, bins, ends=None):
    """A tree as nested (feature, edge, yes, no) or a mean, by trying every cut on the rows themselves."""
    k = len(rows[0]) - 1
    ends = ends or [(min(x[f] for x in rows), max(x[f] for x in rows)) for f in range(k)]
    mean = lambda part: sum(x[-1] for x in part) / len(part)
    loss = lambda part: sum((x[-1] - mean(part)) ** 2 for x in part)
    best = None
    for f in range(k):
        for b in range(bins):
            edge = ends[f][0] + (ends[f][1] - ends[f][0]) * (b + 1) / bins
            yes, no = [x for x in rows if x[f] <= edge], [x for x in rows if x[f] > edge]
            if depth and yes and no and (gain := loss(rows) - loss(yes) - loss(no)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, edge, yes, no)
    return mean(rows) if best is None else (best[1], best[2], brute_tree(best[3], depth - 1, bins, ends), brute_tree(best[4], depth - 1, bins, ends))


def test_tree_by_histograms(spark):
    from barwright.operators import models

    r = random.Random(4)
    rows = [(x := r.uniform(0, 10), y := r.uniform(-5, 5), r.uniform(0, 1), (x > 6) * 10.0 + (y > 0) * (x < 3) * 4 + r.gauss(0, 0.3)) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0, 1.0)], "a double, b double, c double, z double")
    found = models.tree(df, ["a", "b", "c"], "z", depth=3, bins=8)

    def same(node, want):
        if node.feature is None:
            return abs(node.value - want) < 1e-9
        return ("abc".index(node.feature), node.edge) == want[:2] and same(node.yes, want[2]) and same(node.no, want[3])

    assert same(found, brute_tree(rows, 3, 8))
    values = {q["p"] for q in df.dropna().select(found.predicted().alias("p")).collect()}
    assert len(values) == 8
    assert models.tree(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, z double"), ["a"], "z").value == 3.0


def test_k_means_from_given_centres(spark):
    from barwright.operators import models

    r = random.Random(6)
    rows = [(i, [r.gauss(c, 0.1), r.gauss(-c, 0.1)]) for i, c in enumerate([0, 3, 9] * 10)]
    df = spark.createDataFrame([*rows, (99, None)], "id long, v array<double>")
    got = {q["id"]: q["cluster"] for q in models.lloyd(df, "v", [[1.0, 1.0], [2.0, -2.0], [8.0, -8.0], [500.0, 500.0]], 3).collect()}
    assert got == {i: i % 3 for i in range(30)} | {99: None}
    assert models.lloyd(df, "v", [[0.0, 0.0], [0.0, 0.0]], 0).where("cluster = 1").count() == 0  # ties go to the first


def test_volatilities_of_a_batch_are_found_together(spark):
    from barwright.functions import options

    df = spark.range(1000).selectExpr("100D AS s", "80 + id % 50 AS k", "0.5D AS t", "0.1 + id % 30 / 100 AS v").union(spark.sql("SELECT 100D, 90D, 0.5D, NULL"))
    s, k, t, v = (F.col(c) for c in "sktv")
    found = df.select("v", options.implied_vol(options.bs_call(s, k, t, F.lit(0.03), v), s, k, t, F.lit(0.03)).alias("found"), options.implied_vol(s + 1, s, k, t, F.lit(0.03)).alias("none"))
    assert "lambda" not in found._jdf.queryExecution().toString()
    got = found.collect()
    assert all(r["none"] is None and (r["found"] is None if r["v"] is None else abs(r["found"] - r["v"]) < 1e-5) for r in got)


def test_correlations_in_slices_of_small_blocks(spark, monkeypatch):
    df = studies.change_pct(series(spark, 30, range(40)))
    key = lambda rows: {(r["key"], r["symbol"]): (round(r["corr"], 9), r["n"]) for r in rows}
    whole = key(correlation.peers(df, blocks=1).collect())
    monkeypatch.setattr(correlation, "BLOCK", 2)
    monkeypatch.setattr(correlation, "PAIRS_AT_ONCE", 3)
    cut = correlation.peers(df)
    assert key(cut.collect()) == whole and len(whole) == 40 * 39
    assert cut.select("key").count() == 40 * 39


def test_the_plan_of_a_numbered_table_does_not_grow_with_its_parts(spark):
    df = spark.range(3000).selectExpr("pmod(xxhash64(id), 1000) AS v", "id")
    plans = [len(relational.numbered(df, [("v", True), ("id", False)], part_rows=n)._jdf.queryExecution().optimizedPlan().toString()) for n in (3000, 10)]
    assert plans[1] < 1.5 * plans[0]
    got = relational.numbered(df, [("v", True), ("id", False)], part_rows=10).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 3001)) and [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))


def test_missing_dates_are_counted_without_shuffling_them(spark):
    day = lambda d: datetime.date(2024, 1, d)
    df = spark.createDataFrame([(1, day(1)), (1, day(3)), (2, day(1)), (2, day(5)), (3, day(2)), (None, day(1)), (None, day(3))], "symbol long, date date")
    calendar = spark.createDataFrame([(day(d),) for d in range(1, 6)], "date date")
    got = quality.missing_counted(df, calendar)
    assert sorted(((r["symbol"], r["date"].day, r["n"]) for r in got.collect()), key=str) == [(1, 2, 1), (2, 2, 3), (2, 3, 3), (2, 4, 3), (None, 2, 1)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    known = spark.createDataFrame([(2, day(3)), (2, day(4)), (9, day(1))], "symbol long, date date")
    one, more = quality.singles_and_multiples(quality.missing_counted(df.where("symbol IS NOT NULL"), calendar, known=known))
    assert sorted((r["symbol"], r["date"].day) for r in one.collect()) == [(1, 2), (2, 2)] and more.count() == 0


def test_means_and_extremes_are_put_together_from_shorter_ones(spark):
    df = series(spark, 260).withColumn("fClose", F.when(F.dayofmonth("date") != 7, F.round("fClose", 0)))  # ties and nulls
    got = studies.local_extrema(studies.sma(df, (20, 10, 50, 7, 200)), (1, 2, 5, 200))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -199," not in plan and "specifiedwindowframe(RowFrame, -200," not in plan
    assert got.columns == [*df.columns, *[f"sma_{n}" for n in (20, 10, 50, 7, 200)], *[f"{f}_{k}" for k in (1, 2, 5, 200) for f in ("min", "max")]]
    got = got.orderBy("date").toPandas()
    x = got["fClose"]
    for n in (20, 10, 50, 7, 200):
        pd.testing.assert_series_equal(got[f"sma_{n}"].astype(float), x.rolling(n, min_periods=n).mean(), check_names=False, rtol=1e-12)
    for k in (1, 2, 5, 200):
        for f in ("min", "max"):
            near = getattr(x.rolling(2 * k + 1, center=True, min_periods=1), f)()
            pd.testing.assert_series_equal(got[f"{f}_{k}"].astype(float), x.where(x == near), check_names=False)


def test_correlations_keep_each_symbol_on_disk_once(spark):
    found = correlation.peers(studies.change_pct(series(spark, 30, range(40))), blocks=16)
    assert len(found.collect()) == 40 * 39
    leaves = found._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()  # exchanges
    assert sum(leaves.apply(k).getRuntimeStatistics().rowCount().get() for k in range(leaves.size())) <= 2 * 40  # two sides of one exchange; 16 rows of each symbol before


def test_correlations_of_symbols_with_few_dates_in_common(spark):
    r = random.Random(4)
    rows = [(s, datetime.date(2020, 1, 1) + datetime.timedelta(r.randrange(90) + 3 * (s or 0)), r.gauss(0, 1) if r.random() < 0.9 else None) for s in [*range(30), None] for _ in range(1 + (s or 0) % 7 * 5)]
    df = spark.createDataFrame(rows, "symbol long, date date, fChangeP double").dropDuplicates(["symbol", "date"]).cache()
    a, b = (df.where("fChangeP IS NOT NULL AND symbol IS NOT NULL").select(F.col("symbol").alias(k), "date", F.col("fChangeP").alias(f"x_{k}")) for k in ("key", "symbol"))
    want = a.join(b, "date").where("key <> symbol").groupBy("key", "symbol").agg(F.when(F.count("*") > 1, F.corr("x_key", "x_symbol")).alias("corr"), F.count("*").alias("n"))
    table = lambda rows: {(r["key"], r["symbol"]): (None if r["corr"] is None else round(r["corr"], 9), r["n"]) for r in rows}
    got = correlation.peers(df, blocks=5).collect()
    assert table(got) == table(want.collect()) and len(got) == want.count()
    df.unpersist()
