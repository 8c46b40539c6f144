from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.boundaries import IdGrid, TimeGrid, check_name_length, initial_ids, initial_times, time_partition_info, trunc_mod, truncate
from tessera.functions.intervals import Interval, add, age

NOW = datetime(2024, 1, 15, 12)


@pytest.mark.parametrize(
    "text,out",
    [("1 week", "7 days"), ("1 day", "1 day"), ("3 months", "3 mons"), ("1 year 2 mons 3 days 04:05:06", "1 year 2 mons 3 days 04:05:06"), ("30 seconds", "00:00:30"), ("100 years", "100 years"), ("90 minutes", "01:30:00")],
)
def test_interval_text(text, out):
    assert str(Interval.parse(text)) == out
    assert Interval.parse(out) == Interval.parse(text)


@pytest.mark.parametrize("text", ["", "day", "1 fortnight", "monthly"])
def test_bad_interval(text):
    with pytest.raises(ValueError):
        Interval.parse(text)


def test_interval_order_and_epoch():
    assert not Interval.parse("30 days") < Interval.parse("1 month") and Interval.parse("29 days") < Interval.parse("1 month")
    assert Interval.parse("1 month").epoch() == 2_592_000 and Interval.parse("1 year").epoch() == 31_557_600


def test_age():
    assert age(datetime(2026, 3, 15), datetime(2026, 1, 10)) == Interval(2, 5, 0)
    assert age(datetime(2026, 1, 10), datetime(2026, 3, 15)) == Interval(-2, -5, 0)


@given(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)))
@settings(max_examples=200, deadline=None)
def test_age_adds_back(a, b):
    a, b = max(a, b), min(a, b)
    i = age(a, b)
    assert add(add(b, Interval(months=i.months)), Interval(0, i.days, i.micros)) == a and 0 <= i.days < 31


def test_truncation_levels():
    t = datetime(1987, 6, 5, 4, 3, 2)
    expected = {"30 seconds": datetime(1987, 6, 5, 4, 3), "15 minutes": datetime(1987, 6, 5, 4), "1 hour": datetime(1987, 6, 5, 4), "1 day": datetime(1987, 6, 5), "1 week": datetime(1987, 6, 5), "1 month": datetime(1987, 6, 1), "1 year": datetime(1987, 1, 1), "10 years": datetime(1980, 1, 1), "100 years": datetime(1901, 1, 1), "1000 years": datetime(1001, 1, 1)}
    for text, base in expected.items():
        assert time_partition_info(Interval.parse(text), t)[0] == base, text
    assert truncate(t, "week") == datetime(1987, 6, 1)


def test_suffix_pattern():
    assert time_partition_info(Interval.parse("1 hour"), NOW)[1] == "YYYYMMDD_HH24MISS"
    assert time_partition_info(Interval.parse("1 week"), NOW)[1] == "YYYYMMDD"


def test_daily_boundaries_are_strict():
    starts, _ = initial_times(Interval.parse("1 day"), NOW, 4, None, None)
    assert starts[0] == datetime(2024, 1, 11) and starts[-1] == datetime(2024, 1, 19)
    on_grid, _ = initial_times(Interval.parse("1 day"), datetime(2024, 1, 15), 4, None, None)
    assert on_grid[-1] == datetime(2024, 1, 18)


def test_overflow_is_skipped():
    starts, _ = initial_times(Interval.parse("1000 years"), datetime(9500, 1, 1), 4, datetime(9001, 1, 1), None)
    assert starts == [datetime(9001, 1, 1)]


def test_id_boundaries():
    assert initial_ids(10, None, 4, 3000000000) == [3000000000 + 10 * i for i in range(5)]
    assert initial_ids(1000, 2500, 4, None) == [1000, 2000, 3000, 4000, 5000, 6000]
    assert initial_ids(10, None, 2, None) == [0, 10, 20]


def test_names():
    assert check_name_length("t", "20240101", True) == "t_p20240101"
    long = check_name_length("é" * 40, "20240101_000000", True)
    assert len(long.encode()) <= 63 and long.endswith("_p20240101_000000")
    with pytest.raises(ValueError):
        check_name_length("t", None, True)


def test_trunc_mod():
    assert trunc_mod(-7, 10) == -7 and trunc_mod(17, 10) == 7


@given(st.integers(-(10**12), 10**12), st.integers(1, 10**6), st.integers(-1000, 1000))
def test_id_grid(v, step, anchor):
    lo, hi = IdGrid(step, anchor).cell(v)
    assert lo <= v < hi and hi - lo == step


@given(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), st.sampled_from(["30 seconds", "1 hour", "1 day", "1 week", "1 month", "3 months", "1 year", "100 years"]), st.integers(1, 28))
def test_time_grid(t, text, day):
    lo, hi = TimeGrid(Interval.parse(text), datetime(2001, 2, day, 3)).cell(t)
    assert lo <= t < hi


def test_month_end_anchor_is_refused():
    with pytest.raises(ValueError):
        TimeGrid(Interval.parse("1 month"), datetime(2024, 1, 31))


def test_fixed_length():
    assert Interval.parse("1 week").length() == timedelta(days=7)
