"""Calendar edge cases (CAL1, AGG4-6) on hand-made rows."""

from __future__ import annotations

import datetime as dt

from kerbside import schemas
from kerbside.operators import calendar as CAL
from tests import samples

TODAY = dt.date(2024, 7, 24)  # a Wednesday


def test_grid_without_jobs_spans_to_a_week_ahead(spark):
    p = samples.premises(spark).where("id = 8")
    j = spark.createDataFrame([], schemas.JOBS)
    days = [r.day for r in CAL.calendar_grid(p, j, TODAY).orderBy("day").collect()]
    assert days[0] == dt.date(2024, 7, 15)  # Monday of the week of today - 7
    assert days[-1] == TODAY + dt.timedelta(days=7)
    assert len(days) == (days[-1] - days[0]).days + 1


def test_grid_is_capped_and_keeps_duplicate_and_unknown_bins(spark):
    p = samples.premises(spark).where("id = 1001")
    d = dt.date
    j = spark.createDataFrame(
        [(1, 1001, "BROWN", d(2024, 7, 26)), (2, 1001, "BROWN", d(2024, 7, 26)), (3, 1001, "FOOD", d(2024, 7, 26)),
         (4, 1001, "BLACK", d(2024, 12, 25))],  # far future: the grid stops at the cap
        schemas.JOBS,
    )
    rows = CAL.calendar_grid(p, j, TODAY).orderBy("day", "bin").collect()
    assert rows[-1].day == dt.date(2024, 8, 25)  # Sunday of the week of today + 28
    busy = [(r.bin, r.n, r.dot_class) for r in rows if r.day == dt.date(2024, 7, 26)]
    assert busy == [("BROWN", 2, "bg-amber-900/90"), ("FOOD", 1, "")]
    assert [(r.is_today, r.bin, r.n) for r in rows if r.day == TODAY] == [(True, None, 0)]


def test_hot_day_stays_a_few_rows(spark):
    j = spark.range(200_000).selectExpr("id", "cast(1 as long) premises_id", "concat('B', id % 3) bin", "date'2024-07-26' date")
    assert sorted((r.bin, r.n) for r in CAL.bins_by_date(j).collect()) == [("B0", 66667), ("B1", 66667), ("B2", 66666)]


def test_upcoming_by_bin_order(spark):
    d = dt.date
    j = spark.createDataFrame(
        [(1, 1, "BROWN", d(2024, 7, 26)), (2, 1, "FOOD", d(2024, 8, 1)), (3, 1, "BLACK", d(2024, 7, 30)),
         (4, 1, "GARDEN", d(2024, 7, 27)), (5, 1, "GREEN", TODAY)],  # today itself is not upcoming
        schemas.JOBS,
    )
    got = sorted({(r.bin_rank, r.bin) for r in CAL.upcoming_by_bin(j, TODAY).collect()})
    # unknown bins first (by first date), then BLACK, GREEN, BROWN
    assert [b for _, b in got] == ["GARDEN", "FOOD", "BLACK", "BROWN"]
