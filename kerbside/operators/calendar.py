"""Upcoming dates and the calendar grid (FIL4, AGG4-6, CAL1).

Aggregations are pre-combined (partial aggregates) before any per-premises
step, and no step gathers all jobs of a premises: per-group lists are built
from per-(premises, bin) or per-(premises, day, bin) counts, which are
bounded by the bin vocabulary.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.address import bin_dot_class, bin_list_class, bin_order, capital_case
from kerbside.functions.dates import as_date, calendar_last_day, calendar_start, long_date

UPCOMING_MIN_DAYS = 7  # the grid always reaches at least a week past today


def upcoming(jobs: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """FIL4: jobs strictly after today (today itself excluded)."""
    return jobs.where(F.col("date") > as_date(as_of))


def upcoming_by_bin(jobs: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """AGG4: per premises and bin, the upcoming dates (duplicates kept), with
    ``bin_rank``: preferred order BLACK, GREEN, BROWN; unknown bins first, by
    their first upcoming date, then by name.

    One row per upcoming job: (premises_id, bin_rank, bin, title, style, date,
    long_date).  The rank is computed on one row per (premises, bin).
    """
    up = upcoming(jobs, as_of).select("premises_id", "bin", "date")
    firsts = up.groupBy("premises_id", "bin").agg(F.min("date").alias("_first"))
    w = Window.partitionBy("premises_id").orderBy(bin_order("bin"), F.col("_first"), F.col("bin"))
    ranks = firsts.select("premises_id", "bin", (F.row_number().over(w) - 1).cast("long").alias("bin_rank"))
    return up.join(ranks, ["premises_id", "bin"]).select(
        "premises_id",
        "bin_rank",
        "bin",
        capital_case(F.col("bin")).alias("title"),
        bin_list_class("bin").alias("style"),
        "date",
        long_date("date").alias("long_date"),
    )


def max_dates(premises: DataFrame, jobs: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """AGG6: latest job date per premises, seeded with today (premises without
    jobs get today)."""
    m = jobs.groupBy("premises_id").agg(F.max("date").alias("_max"))
    return premises.select("id").join(m, F.col("id") == F.col("premises_id"), "left").select(
        F.col("id").alias("premises_id"), F.greatest(F.coalesce(F.col("_max"), as_date(as_of)), as_date(as_of)).alias("max_date")
    )


def bins_by_date(jobs: DataFrame, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """AGG5: the bins of each (premises, date), one row a bin with the number
    of its jobs and its dot class (an unknown bin has an empty one).  Counts
    combine map-side, so a day with any number of jobs stays a few rows."""
    j = jobs
    if date_from is not None:
        j = j.where(F.col("date") >= date_from)
    if date_to is not None:
        j = j.where(F.col("date") <= date_to)
    return (
        j.groupBy("premises_id", "date", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("premises_id", "date", "bin", "n", bin_dot_class("bin").alias("dot_class"))
    )


def calendar_grid(premises: DataFrame, jobs: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """CAL1: per premises, every day from the Monday of (today − 7) to
    min(max(latest job, today + 7), Sunday of the week of today + 28), with
    that day's bins and an ``is_today`` flag.

    Output: (premises_id, day, is_today, bin, n, dot_class), one row for each
    bin of a day, in bin order for display; a day without jobs is one row with
    a null bin and n = 0.
    """
    today = as_date(as_of)
    start = calendar_start(as_of)
    last = calendar_last_day(as_of)
    ends = max_dates(premises, jobs, as_of).select(
        "premises_id", F.least(F.greatest(F.col("max_date"), F.date_add(today, UPCOMING_MIN_DAYS)), last).alias("_end")
    )
    days = ends.select("premises_id", F.explode(F.sequence(start, F.col("_end"))).alias("day"))
    bins = bins_by_date(jobs, start, last)
    return days.join(bins, (days["premises_id"] == bins["premises_id"]) & (F.col("day") == F.col("date")), "left").select(
        days["premises_id"],
        F.col("day"),
        (F.col("day") == today).alias("is_today"),
        "bin",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "dot_class",
    )
