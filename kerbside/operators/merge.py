"""Snapshot diff, merges and upserts (SNK2-6, JOIN6).

All are keyed joins on unique keys (premises id, postcode, url, job triple),
so no key is hot; duplicated keys inside one upsert batch are an error, as a
conflicting row twice in one INSERT … ON CONFLICT is in the reference.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.dates import ts_lit
from kerbside.plans.stage import materialize
from kerbside.schemas import ADDRESS_COLUMNS

JOB_TRIPLE = ["premises_id", "bin", "date"]


def _ts(v: dt.datetime | Column) -> Column:
    return ts_lit(v)


def _any(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


# --------------------------------------------------------------------------- SNK2 / JOIN6
def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",), cols: Sequence[str] = tuple(ADDRESS_COLUMNS)) -> DataFrame:
    """Classify every key of old ∪ new: ``delete`` (old only), ``insert`` (new
    only), ``update`` (any of ``cols`` IS DISTINCT FROM), ``unchanged``.

    Output: keys, op, then ``cols`` from the new row (old row for deletes).
    """
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_in_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_in_new"))
    j = o.join(n, list(keys), "full_outer")
    changed = _any([~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")) for c in cols])
    op = (
        F.when(F.col("_in_new").isNull(), "delete")
        .when(F.col("_in_old").isNull(), "insert")
        .when(changed, "update")
        .otherwise("unchanged")
    )
    return j.select(
        *keys,
        op.alias("op"),
        *[F.when(F.col("_in_new").isNull(), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in cols],
    )


RANGE_ROWS = 10_000  # rows that a key range holds on average


def range_width(rows: DataFrame, key: str = "id", range_rows: int = RANGE_ROWS) -> int:
    """Width of key ranges that hold about ``range_rows`` rows each (a one-row
    decision).  Where keys lie unevenly so do the rows of the ranges."""
    seen = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    return max(1, (seen["high"] - seen["low"] + 1) * range_rows // seen["n"]) if seen["n"] else 1


def _range_start(key: str, width: int) -> Column:
    return (F.col(key) - F.pmod(F.col(key), F.lit(width))).alias("_range")


def range_digests(rows: DataFrame, width: int, key: str = "id", cols: Sequence[str] = tuple(ADDRESS_COLUMNS)) -> DataFrame:
    """One row per key range: its rows' number and four sums over the halves of
    two 64-bit hashes of key and ``cols``.  Independent of row order; a row that
    occurs twice counts twice.  Hashing skips NULLs, so every column's NULL
    mark is hashed beside it."""
    values = [F.col(key), *[v for c in cols for v in (F.col(c).isNull(), F.col(c))]]
    hashes = [F.xxhash64(F.lit(seed), *values) for seed in (0, 1)]
    halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return rows.groupBy(_range_start(key, width)).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_d{i}") for i, x in enumerate(halves)])


def changed_ranges(old_digests: DataFrame, new_digests: DataFrame) -> DataFrame:
    """Starts of the key ranges whose digests differ or that one side lacks."""
    digests = [c for c in new_digests.columns if c != "_range"]
    both = old_digests.alias("o").join(new_digests.alias("n"), "_range", "full_outer")
    return both.where(_any([~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in digests])).select("_range")


def in_ranges(rows: DataFrame, ranges: DataFrame, width: int, key: str = "id") -> DataFrame:
    """The rows whose key lies in one of the ranges; same columns."""
    return rows.join(ranges, _range_start(key, width) == F.col("_range"), "left_semi")


def snapshot_changes(
    old: DataFrame,
    new: DataFrame,
    key: str = "id",
    cols: Sequence[str] = tuple(ADDRESS_COLUMNS),
    width: int | None = None,
    old_digests: DataFrame | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``snapshot_diff`` without its unchanged rows, in two levels: digests of
    key ranges first, then the full outer join of the changed ranges only.

    ``old_digests`` are the stored digests (``range_digests`` of ``width``) of
    the old snapshot, which is then not scanned for them.  Keys are whole
    numbers, never NULL; two empty snapshots have no changes.
    """
    if old_digests is not None and width is None:
        raise ValueError("old_digests need the width they were made with")
    width = width or range_width(new, key, range_rows)
    before = old_digests if old_digests is not None else range_digests(old, width, key, cols)
    # staged: read by both sides, and its size is known to the planner
    ranges = materialize(changed_ranges(before, range_digests(new, width, key, cols)), "changed-ranges")
    diff = snapshot_diff(in_ranges(old, ranges, width, key), in_ranges(new, ranges, width, key), (key,), cols)
    return diff.where(F.col("op") != "unchanged")


# --------------------------------------------------------------------------- SNK3
def merge_premises(old: DataFrame, new: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Apply a snapshot to the premises table: deletes vanish, inserts get
    created_at = updated_at = now, updates get the new parts and
    updated_at = now, unchanged rows keep theirs; created_at survives.  The
    search key is recomputed for every row (NULL postcode → NULL key)."""
    cols = list(ADDRESS_COLUMNS)
    o = old.select("id", *[F.col(c).alias(f"_o_{c}") for c in cols], F.col("created_at").alias("_o_created"), F.col("updated_at").alias("_o_updated"))
    n = new.select("id", *[F.col(c).alias(c) for c in cols])
    j = n.join(o, "id", "left")
    existed = F.col("_o_created").isNotNull()
    changed = _any([~F.col(f"_o_{c}").eqNullSafe(F.col(c)) for c in cols])
    now_c = _ts(now)
    return j.select(
        "id",
        *cols,
        F.upper(F.replace(F.col("address_postcode"), F.lit(" "), F.lit(""))).alias("search_postcode"),
        F.when(existed, F.col("_o_created")).otherwise(now_c).alias("created_at"),
        F.when(existed & ~changed, F.col("_o_updated")).otherwise(now_c).alias("updated_at"),
    )


# --------------------------------------------------------------------------- SNK4
def merge_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs merge on the (premises_id, bin, date) triple: old rows whose triple
    is still present are kept (duplicates and ids included); triples new to
    the table are inserted once each with fresh ids; the rest are deleted.
    Adds ``origin``: 'kept' or 'inserted'."""
    # Both sides of each membership test are made distinct first (partial
    # aggregation absorbs a triple copied many times), so the build side of
    # the semi/anti join holds one row per triple; AQE can split the streamed
    # side if one premises dominates.
    new_triples = new.select(*JOB_TRIPLE).distinct()
    keep = old.join(new_triples, JOB_TRIPLE, "left_semi")
    fresh = new_triples.join(old.select(*JOB_TRIPLE).distinct(), JOB_TRIPLE, "left_anti")
    # ids continue after the largest existing one (a scalar from a one-row aggregate)
    base = old.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_base")).first()["_base"]
    inserted = fresh.select((F.lit(base + 1) + F.monotonically_increasing_id()).alias("id"), *JOB_TRIPLE)
    return keep.select("id", *JOB_TRIPLE, F.lit("kept").alias("origin")).unionByName(
        inserted.select("id", *JOB_TRIPLE, F.lit("inserted").alias("origin"))
    )


# --------------------------------------------------------------------------- SNK5 / SNK6
def _unique_batch(batch: DataFrame, key: str, value_cols: Sequence[str]) -> DataFrame:
    """One row per key; a key repeated in the batch fails the job."""
    agg = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_dups"), *[F.first(c).alias(c) for c in value_cols])
    guard = F.when(F.col("_dups") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key} in upsert batch: "), F.col(key).cast("string"))))
    # in the key, which every use of the batch needs: no projection prunes it
    return agg.select(F.coalesce(guard, F.col(key)).alias(key), *value_cols)


def upsert_postcodes(old: DataFrame, batch: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Insert new postcodes; on an existing id overwrite latitude and longitude
    only (updated_at is not bumped)."""
    b = _unique_batch(batch.select("id", "latitude", "longitude"), "id", ["latitude", "longitude"]).select(
        "id", F.col("latitude").alias("_b_lat"), F.col("longitude").alias("_b_lon"), F.lit(True).alias("_in_b")
    )
    j = old.join(b, "id", "full_outer")
    now_c = _ts(now)
    return j.select(
        "id",
        F.coalesce(F.col("_b_lat"), F.col("latitude")).alias("latitude"),
        F.coalesce(F.col("_b_lon"), F.col("longitude")).alias("longitude"),
        F.coalesce(F.col("created_at"), now_c).alias("created_at"),
        F.coalesce(F.col("updated_at"), now_c).alias("updated_at"),
    )


def upsert_markers(old: DataFrame, observations: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Change markers by url: set etag, updated_at (= the source's
    Last-Modified) and checked_at; created_at survives (new rows: now)."""
    b = _unique_batch(observations.select("url", "etag", "last_modified", "checked_at"), "url", ["etag", "last_modified", "checked_at"])
    b = b.select("url", F.col("etag").alias("_b_etag"), F.col("last_modified").alias("_b_lm"), F.col("checked_at").alias("_b_ck"), F.lit(True).alias("_in_b"))
    j = old.join(b, "url", "full_outer")
    in_b = F.col("_in_b").isNotNull()
    return j.select(
        "url",
        F.when(in_b, F.col("_b_etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(in_b, F.col("_b_ck")).otherwise(F.col("checked_at")).alias("checked_at"),
        F.coalesce(F.col("created_at"), _ts(now)).alias("created_at"),
        F.when(in_b, F.col("_b_lm")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
