"""What the nearby map shows (JOIN3-4, FIL7, AGG7-8, LIM2) from the nearest
postcodes (NEAR1, ``operators.nearest``)."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.address import bin_dot_class
from kerbside.functions.dates import as_date
from kerbside.operators.lookup import jobs_at_postcodes, postcode_job_set
from kerbside.operators.nearest import NEARBY_LIMIT, NEARBY_RADIUS_M, haversine_m, nearest_postcodes

WORD = 64  # days whose bits one long holds

__all__ = ["NEARBY_LIMIT", "NEARBY_RADIUS_M", "haversine_m", "nearest_postcodes"]


# --------------------------------------------------------------------------- JOIN3 / LIM2
def pending_geocodes(premises: DataFrame, postcodes: DataFrame) -> DataFrame:
    """JOIN3: postcodes of premises that have no geocode yet, with the number of
    premises carrying each (the weight of the reference's random row pick)."""
    return (
        premises.where(F.col("address_postcode").isNotNull())
        .join(postcodes.select(F.col("id").alias("_pc")), F.col("address_postcode") == F.col("_pc"), "left_anti")
        .groupBy(F.col("address_postcode").alias("postcode"))
        .agg(F.count(F.lit(1)).alias("premises_count"))
    )


def random_pending_geocodes(premises: DataFrame, postcodes: DataFrame, k: int = 1, seed: int | None = None, weighted: bool = True) -> DataFrame:
    """LIM2: k random postcodes from the backlog (weighted by premises count
    by default, as a random premises row is drawn)."""
    seed = random.getrandbits(62) if seed is None else seed
    # an even draw u in (0, 1) from a hash of (seed, postcode); the smallest
    # -ln(u) / weight is each postcode's with probability proportional to its weight
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("postcode"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    weight = F.col("premises_count") if weighted else F.lit(1)
    return pending_geocodes(premises, postcodes).orderBy(-F.log(u) / weight, "postcode").select("postcode").limit(k)


# --------------------------------------------------------------------------- JOIN4
def nearby_jobs(near: DataFrame, premises: DataFrame, jobs: DataFrame) -> DataFrame:
    """JOIN4: every nearby postcode with its distinct (date, bin) jobs; a
    neighbour without jobs keeps one row with NULL date and bin.

    The nearby set is itself the postcode request of each origin, so the job
    set (JOIN1) is joined to it once on postcode.
    """
    pj = postcode_job_set(premises, jobs, near.select("postcode")).withColumnRenamed("postcode", "_pjc")
    joined = near.join(pj, F.col("postcode") == F.col("_pjc"), "left")
    return joined.select("origin", "rank", "postcode", "latitude", "longitude", "distance", "date", "bin")


# --------------------------------------------------------------------------- AGG7 / AGG8 / FIL7
def _day_bits(keys: DataFrame, day: Column) -> DataFrame:
    """(the key columns, word, bits): days as sets of bits, one long for each
    ``WORD`` days that have any.  Bits need no distinct before them: or-ing a
    date twice changes nothing."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(WORD)))
    names = [c for c in keys.columns if c != "_day"]
    return keys.groupBy(*names, F.floor(day / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _days_of() -> Column:
    """The days of a word, as an array of days since 1970."""
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    return F.transform(held, lambda i: (F.col("word") * WORD + i).cast("int"))


def day_sets(premises: DataFrame, jobs: DataFrame, postcodes: DataFrame) -> DataFrame:
    """(postcode, days): the distinct job dates of each postcode, as days since
    1970: four bytes a day when the row is sent to the origins around it."""
    held = jobs_at_postcodes(premises, jobs, postcodes).select("postcode", F.unix_date("date").alias("_day"))
    words = _day_bits(held, F.col("_day"))
    return words.groupBy("postcode").agg(F.flatten(F.collect_list(_days_of())).alias("days"))


def date_facets(near: DataFrame, premises: DataFrame, jobs: DataFrame) -> DataFrame:
    """AGG7: the distinct job dates across each origin's nearby set.  A
    neighbour brings its dates as one row to its origin's task; only there are
    they taken apart and merged, so no (origin, date) pair is exchanged."""
    sets = day_sets(premises, jobs, near.select("postcode"))
    brought = near.select("origin", "postcode").join(sets, "postcode").select("origin", "days").repartition("origin")
    merged = _day_bits(brought.select("origin", F.explode("days").alias("_day")), F.col("_day"))
    return merged.select("origin", F.explode(_days_of()).alias("day")).select("origin", F.date_from_unix_date("day").alias("date"))


def default_dates(near: DataFrame, premises: DataFrame, jobs: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """AGG8: the nearest postcode's first date on or after today, else the
    first date of the whole set, else NULL.  Each postcode is cut down to its
    two candidate dates before it meets the origins."""
    today = as_date(as_of)
    first = postcode_job_set(premises, jobs, near.select("postcode")).groupBy("postcode").agg(
        F.min("date").alias("_first"), F.min(F.when(F.col("date") >= today, F.col("date"))).alias("_next")
    )
    return near.join(first, "postcode", "left").groupBy("origin").agg(
        F.coalesce(F.min(F.when(F.col("rank") == 0, F.col("_next"))), F.min("_first")).alias("default_date")
    )


def map_markers(near: DataFrame, premises: DataFrame, jobs: DataFrame, selected: DataFrame) -> DataFrame:
    """FIL7: for each origin's selected date, the nearby postcodes with jobs
    that day and their bins; postcodes with none that day are not shown;
    ``is_self`` marks distance 0.  ``selected``: (origin, selected_date).

    The chosen dates meet the neighbours first.  Jobs are cut to the
    (postcode, date) pairs that are asked for, and become one row for each
    before they meet the origins.
    """
    shown = near.join(selected.where(F.col("selected_date").isNotNull()), "origin")
    asked = shown.select(F.col("postcode").alias("_pc"), F.col("selected_date").alias("_day")).distinct()
    places = premises.select("id", "address_postcode").join(asked, F.col("address_postcode") == F.col("_pc"))
    that_day = (F.col("premises_id") == F.col("id")) & (F.col("date") == F.col("_day"))
    day = (
        places.join(jobs.select("premises_id", "date", "bin"), that_day)
        .groupBy("_pc", "_day")
        .agg(F.array_sort(F.collect_set("bin")).alias("bins"))  # at most the bins there are
    )
    return shown.join(day, (F.col("postcode") == F.col("_pc")) & (F.col("selected_date") == F.col("_day"))).select(
        "origin",
        "selected_date",
        "rank",
        "postcode",
        "latitude",
        "longitude",
        (F.col("distance") == 0).alias("is_self"),
        "bins",
        F.transform("bins", lambda b: bin_dot_class(b)).alias("classes"),
    )
