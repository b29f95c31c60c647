"""Hand-made bars that fire a pattern, and near misses."""

import datetime

import pytest

from barwright.operators import candles, studies

# (open, high, low, close) of each bar, oldest first; the pattern is looked for at `at`
FIRES = {
    "marubozu": ([(10, 11, 10, 11)], 0, [(10, 13, 10, 11)]),
    "doji": ([(10, 10.5, 9.5, 10)], 0, [(10, 10.5, 9.5, 10.2)]),
    "spinning_top": ([(10, 10.55, 9.5, 10.1)], 0, [(10, 10.55, 9.5, 9.9)]),
    "dragonfly_doji": ([(10, 10.05, 9, 10)], 0, [(10, 10.5, 9, 10)]),
    "inverted_hammer": ([(10, 11, 10, 10.1)], 0, [(10, 11, 9.5, 10.1)]),
    "hammer": ([(10, 10.06, 9, 10.03)], 0, [(10, 10.3, 9, 10.03)]),
    "bear_spinning_top": ([(10, 10.55, 9.5, 9.9)], 0, [(10, 10.55, 9.5, 10.1)]),
    "bear_dragonfly_doji": ([(10, 11, 9.98, 10)], 0, [(10, 11, 9, 10)]),
    "hanging_man": ([(10, 10.02, 9, 9.9)], 0, [(10, 10.2, 9, 9.9)]),
    "shooting_star": ([(10, 11, 9.98, 9.99)], 0, [(10, 11, 9, 9.99)]),
    "kicker": ([(11, 11.1, 10, 10.9), (10.8, 10.9, 9.9, 10.0), (10.5, 12, 10.4, 11.9)], 1, [(11, 11.1, 10, 10.9), (10.8, 10.9, 9.9, 10.0), (10.5, 12, 9, 9.5)]),
    "three_white_soldiers": ([(9, 9.2, 8.9, 9.1), (9.1, 10.2, 9.0, 10.1), (9.6, 11.2, 9.5, 11.1), (10.6, 12.2, 10.5, 12.1)], 1, [(9, 9.2, 8.9, 9.1), (9.1, 10.2, 9.0, 10.1), (9.6, 11.2, 9.5, 10.0), (10.6, 12.2, 10.5, 12.1)]),
    "three_black_crows": ([(12, 12.6, 11.9, 12.5), (12.4, 12.5, 11.2, 11.3), (11.9, 12.0, 10.2, 10.3), (11.0, 11.1, 9.2, 9.3)], 1, [(12, 12.6, 11.9, 12.5), (12.4, 12.5, 11.2, 11.3), (11.9, 12.0, 10.2, 12.0), (11.0, 11.1, 9.2, 9.3)]),
    "evening_star": ([(8, 9, 8, 9), (9, 10, 9, 10), (10.5, 10.3, 10.1, 9.97), (9.9, 9.95, 9.1, 9.2)], 1, [(8, 9, 8, 9), (9, 10, 9, 10), (10.5, 10.3, 9.9, 9.97), (9.9, 9.95, 9.1, 9.2)]),
}


# The same for the other patterns: six bars, looked for at the third; then the bar, the field and the value with which it misses.
# bear_abandoned_baby fires on bars only whose high lies below their close, as its definition asks for a close of the second bar
# below that of the first, yet above the first's high.
MORE = {
    "engulfing": ([(101.2, 101.2, 101.1, 101.2), (101, 101.1, 100.5, 100.8), (99.2, 99.2, 99.2, 99.2), (99.1, 105.8, 99, 105.8), (103.8, 104.9, 102.5, 103.8), (104.1, 104.2, 100.8, 101.2)], (2, 1, 99.3)),
    "harami": ([(100.1, 100.6, 96.8, 100), (100, 100, 99.7, 100), (100.4, 101.2, 98.4, 98.8), (98.9, 100.4, 97, 100.1), (100, 100.3, 99.7, 100), (100.2, 102.3, 100.2, 101.8)], (2, 0, 100.6)),
    "tweezer_bottom": ([(99.9, 101, 99.9, 100.3), (103.3, 103.5, 100.2, 102.9), (103.1, 105.7, 97.1, 97.9), (98.1, 99.3, 96.3, 98.6), (98.7, 99.8, 98.7, 98.9), (101.7, 107.8, 101.7, 107.6)], (2, 3, 98.1)),
    "morning_star": ([(100, 100.3, 99.4, 100.1), (95.4, 95.7, 95.4, 95.6), (95.7, 95.8, 94.4, 94.6), (93.4, 94.1, 93.1, 93.1), (97.5, 101.2, 97.5, 101.2), (99.7, 106.9, 99.6, 102.5)], (2, 2, 94.6)),
    "abandoned_baby": ([(98.3, 100.3, 94.2, 96), (96.2, 96.2, 95.9, 96.2), (96.2, 96.6, 95.6, 95.6), (94.5, 95.1, 94.4, 94.6), (96.1, 97.3, 96, 96.2), (98.9, 99.9, 94, 94)], (3, 3, 94.7)),
    "three_line_strike": ([(100, 100.5, 99.5, 99.6), (102.3, 102.4, 102.1, 102.4), (102.4, 102.4, 100.4, 100.9), (100.9, 101.9, 100.3, 100.4), (100.5, 100.9, 99.8, 99.8), (98.9, 112, 98.3, 111.1)], (3, 3, 100.9)),
    "morning_star_doji": ([(101.2, 103.1, 99.1, 99.2), (101, 101.7, 98.2, 101), (97.8, 98.8, 92.9, 93.6), (93.6, 93.7, 93.5, 93.5), (94.6, 96, 94.3, 96), (94.9, 95.2, 94.9, 95.2)], (3, 0, 93.7)),
    "three_outside_up": ([(100, 104.4, 89.9, 90.5), (91.9, 91.9, 91.9, 91.9), (92.5, 92.5, 90.3, 90.4), (90.2, 93.1, 90.1, 93.1), (91.8, 93.9, 91.8, 93.9), (94, 94, 90.9, 92.8)], (3, 0, 90.3)),
    "three_inside_up": ([(98.2, 98.8, 96, 98.2), (99, 101.9, 93.6, 96.5), (96.5, 96.5, 95.2, 95.3), (95.3, 96.3, 94.5, 96.3), (96.2, 97.7, 95.9, 97.7), (95.4, 95.8, 95.4, 95.8)], (3, 0, 95.4)),
    "gravestone": ([(100.8, 101, 94.7, 97.1), (97.1, 97.5, 97.1, 97.4), (97.3, 102.2, 97.1, 97.1), (97.7, 98, 90.1, 91.2), (91.2, 94.6, 86.5, 93.8), (94.1, 94.1, 93.9, 94)], (2, 0, 97.4)),
    "bear_kicker": ([(100, 100, 91.1, 93.7), (88.9, 89, 88.7, 88.9), (89.7, 89.7, 89.5, 89.5), (86.6, 86.6, 86.3, 86.3), (85.9, 85.9, 75.3, 75.7), (76.4, 76.4, 75.9, 76.4)], (3, 3, 86.4)),
    "bear_engulfing": ([(98.8, 99.7, 98.8, 99.7), (99.4, 99.5, 99.3, 99.4), (104.4, 104.4, 104.4, 104.4), (106.7, 106.8, 94.8, 94.9), (94.3, 98.2, 94.3, 98.2), (98.3, 101.5, 97.3, 97.7)], (2, 1, 104.5)),
    "bear_harami": ([(101.8, 106.5, 99.5, 102.3), (101.6, 101.7, 96.9, 101.1), (100.8, 106.1, 98.8, 103.9), (103.8, 103.9, 102.2, 102.2), (102.2, 104.5, 102.2, 104.4), (106.5, 106.6, 103.9, 104.7)], (3, 0, 103.9)),
    "dark_cloud_cover": ([(100.1, 101.4, 98.7, 99.4), (99.2, 99.4, 97.8, 98.8), (101.7, 106.2, 101.7, 105.4), (105.8, 105.8, 103.5, 103.5), (103.5, 103.6, 100, 103.4), (104, 104.3, 104, 104.2)], (2, 3, 105.6)),
    "tweezer_top": ([(101.5, 106, 101.5, 101.5), (102.7, 102.8, 98.1, 101.6), (101.7, 103.9, 101.2, 103.5), (103.6, 103.7, 101.8, 101.9), (101.9, 102.2, 101.1, 101.1), (97, 97, 96.7, 96.8)], (3, 0, 103.7)),
    "evening_doji_star": ([(98.6, 98.6, 98, 98.5), (98.5, 99.4, 96.1, 97.3), (96.4, 102.2, 92, 101.9), (101.9, 102, 101.4, 101.8), (101.5, 102, 96.1, 100.5), (103.1, 103.2, 102.9, 103.1)], (3, 3, 101.9)),
    "piercing_line": ([(3, 3.1, 2.9, 3), (3, 3.1, 2.9, 3), (2.4, 2.5, 1.9, 2.1), (1.5, 6.1, 1.4, 6), (6, 6.1, 5.9, 6), (6, 6.1, 5.9, 6)], (3, 3, 2.1)),
    "bear_abandoned_baby": ([(9, 9.1, 8.9, 9), (9, 9.1, 8.9, 9), (11.7, 9.9, 12, 10), (10, 10.1, 9.9, 9.99), (9.85, 9.9, 9.7, 9.8), (9.8, 9.9, 9.7, 9.8)], (4, 0, 10.1)),
}
FIRES |= {name: (rows, 2, [tuple(v if (i, j) == (at, field) else x for j, x in enumerate(r)) for i, r in enumerate(rows)]) for name, (rows, (at, field, v)) in MORE.items()}


def bars(spark, rows):
    day = datetime.date(2024, 1, 1)
    data = [(1, day + datetime.timedelta(i), float(o), float(h), float(low), float(c), 1e6) for i, (o, h, low, c) in enumerate(rows)]
    return studies.change_pct(spark.createDataFrame(data, "symbol long, date date, fOpen double, fHigh double, fLow double, fClose double, fVolume double"))


@pytest.mark.parametrize("name", sorted(FIRES))
def test_fires_and_misses(spark, name):
    rows, at, near = FIRES[name]
    sign = next(p.sign for p in candles.PATTERNS if p.name == name)
    hit = candles.patterns(bars(spark, rows), (name,)).orderBy("date").collect()
    assert hit[at][name] == sign
    miss = candles.patterns(bars(spark, near), (name,)).orderBy("date").collect()
    assert miss[at][name] == 0


def test_all_patterns_are_there():
    assert {p.name for p in candles.PATTERNS} == set(FIRES)
    assert len(candles.PATTERNS) == 32 and len({p.name for p in candles.PATTERNS}) == 32


def test_patterns_do_not_cross_symbols(spark):
    rows, at, _ = FIRES["kicker"]
    df = bars(spark, rows)
    split = df.selectExpr("CASE WHEN date < '2024-01-03' THEN 1 ELSE 2 END AS symbol", "date", "fOpen", "fHigh", "fLow", "fClose", "fVolume", "fChangeP")
    assert candles.patterns(split, ("kicker",)).agg({"kicker": "sum"}).first()[0] == 0
