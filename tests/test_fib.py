"""The choice of a symbol's strongest row: a case for each rule."""

import datetime

import pytest

from barwright.operators import fib

#: rn, hit, fRange, fChangeP, gap
CASES = {
    "1": ([(1, False, 9.0, 0.9, 0.9), (2, True, 1.0, 0.1, 0.0), (3, None, 8.0, 0.8, 0.8)], 2),
    "sort1": ([(1, True, 5.0, 0.1, 0.0), (2, True, 9.0, 0.9, 0.0), (3, True, 1.0, 0.8, 0.0), (4, True, 2.0, 0.2, 0.5)], 2),
    "sort2": ([(1, True, 1.0, 0.9, 0.0), (2, False, 1.5, 0.1, 0.0), (3, True, 2.0, 0.2, 0.0), (4, True, 9.0, 0.8, 0.5), (5, True, 8.0, 0.1, 0.5)], 1),
    "sort3": ([(1, True, 1.0, 0.10, 0.0), (2, True, 1.1, 0.11, 0.0), (3, True, 1.2, 0.12, 0.0), (4, True, 9.0, 0.90, 0.1), (5, True, 9.1, 0.91, 0.0), (6, True, 2.0, 0.13, 0.2), (7, True, 2.0, 0.01, 0.3)] + [(8, True, 2.0, 0.5, 0.0), (9, True, 2.0, 0.6, 0.0), (10, True, 2.0, 0.7, 0.05)], 4),
    # rows 2 and 3 pass the first rule; the earliest of all is row 1, which doesn't
    "sort4": ([(1, True, 1.0, 0.1, 0.0), (2, True, 9.0, 0.9, 0.0), (3, True, 8.0, 0.8, 0.0), (4, True, 2.0, 0.2, 0.0)], 1),
    # no row passes any rule: changes are largest late, gaps where changes are small
    "sort5": ([(1, True, 1.0, 0.01, 0.7), (2, True, 7.0, 0.02, 0.8), (3, True, 2.0, 0.03, 0.9)] + [(k, True, 3.0, 0.1 * k, 0.0) for k in range(4, 10)], 2),
    "else": ([(1, False, 1.0, 0.2, 0.0), (2, None, 9.0, 0.5, 0.0), (3, False, 9.0, 0.5, 0.0)], 2),
}


@pytest.mark.parametrize("how", sorted(CASES))
def test_max_row_by_rule(spark, monkeypatch, how):
    rows, m = CASES[how]
    df = spark.createDataFrame([("S", *r) for r in rows], "symbol string, rn int, hit boolean, fRange double, fChangeP double, gap double")
    monkeypatch.setattr(fib, "candidates", lambda x: x)
    assert [(r["m"], r["how"]) for r in fib.max_rows(df).collect()] == [(m, how)]


def test_rows_of_equal_value_share_a_place(spark, monkeypatch):
    """The second place of the changes is shared by rows 2 and 3, so two rows pass the first rule and the earliest of all is taken."""
    rows = [(1, True, 1.0, 0.1, 0.0), (2, True, 9.0, 0.8, 0.0), (3, True, 9.0, 0.8, 0.0), (4, True, 2.0, 0.9, 0.0)]
    df = spark.createDataFrame([("S", *r) for r in rows], "symbol string, rn int, hit boolean, fRange double, fChangeP double, gap double")
    monkeypatch.setattr(fib, "candidates", lambda x: x)
    assert [(r["m"], r["how"]) for r in fib.max_rows(df).collect()] == [(1, "sort4")]


def test_steps_after_the_numbered_bars_deal_out_nothing_again(spark, monkeypatch):
    from barwright.plans import bars as plans
    from barwright.plans.fib import _input

    monkeypatch.setattr(plans, "PART", 1000)
    d = "/root/testdata/sf0.001"
    n = _input(spark, d)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert n.rdd.getNumPartitions() == -(-lines // 1000) > 4  # parts grow in number with the table
    for q in (fib.max_rows(n), fib.pipeline(n)[0]):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_nearest_level_of_ties_and_missing_prices(spark):
    day = datetime.date(2020, 1, 1)
    names = sorted(fib.level_name(k, p) for k in ("ret", "ext") for p in fib.LEVELS)
    lv = spark.createDataFrame([(1, *[10.0 * (k // 2) for k in range(len(names))])], "symbol long, " + ", ".join(f"{n} double" for n in names))
    df = spark.createDataFrame([(1, day, 5.0, 21.0), (1, day + datetime.timedelta(1), None, 19.0), (2, day, 1.0, 1.0)], "symbol long, date date, fHigh double, fLow double")
    got = {r["date"]: r for r in fib.nearest(df, lv).collect()}
    assert len(got) == 2
    a, b = got[day], got[day + datetime.timedelta(1)]
    assert (a["h_level"], a["h_value"], a["h_pct"], a["l_level"], a["l_value"], a["l_pct"]) == (names[0], 0.0, None, names[4], 20.0, 0.05)
    assert (b["h_value"], b["h_pct"], b["l_level"], b["l_pct"]) == (0.0, None, names[4], 0.05)
