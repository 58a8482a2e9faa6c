"""Change gate, dataset status and run records (CHG1, CHG3, JOIN5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.dates import ts_lit

# The two datasets and the status table's placeholder.
DATASETS = [
    ("jobs", "Jobs", "jobs.csv"),
    ("premises", "Premises", "premises.csv"),
]
NOT_AVAILABLE = "N/A"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def dataset_list(spark: SparkSession, base_url: str) -> DataFrame:
    """The fixed dataset list: (key, name, url)."""
    rows = [(k, n, f"{base_url.rstrip('/')}/{f}") for k, n, f in DATASETS]
    return spark.createDataFrame(rows, "key string, name string, url string")


def snapshot_marker(df: DataFrame, cols: list[str]) -> DataFrame:
    """A content marker of a snapshot (stands in for an HTTP ETag): row count
    and an order-independent sum of a 60-bit digest of each row, exact in a
    decimal of 38 digits at any row count.  A one-row aggregate; partial sums
    combine map-side."""
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols])
    digest = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit("-"), F.sum(digest).cast("decimal(38,0)").cast("string")).alias("etag")
    )


def change_gate(observations: DataFrame, markers: DataFrame) -> DataFrame:
    """CHG1: per url compare the observed marker with the stored one.

    ``observations``: (url, etag, last_modified, checked_at); a url may be
    listed with NULLs when the probe failed.  ``markers``: the stored table.
    ``decision``: ``unknown`` (no etag or last-modified observed: skip, write
    nothing), ``unchanged`` (same etag: refresh the marker), ``changed``
    (different or nothing stored: load, then commit the marker on success).
    """
    stored = markers.select("url", F.col("etag").alias("stored_etag"), F.lit(True).alias("_has"))
    j = observations.join(stored, "url", "left")
    decision = (
        F.when(F.col("etag").isNull() | F.col("last_modified").isNull(), "unknown")
        .when(F.col("_has").isNotNull() & F.col("etag").eqNullSafe(F.col("stored_etag")), "unchanged")
        .otherwise("changed")
    )
    return j.select("url", "etag", "stored_etag", "last_modified", "checked_at", decision.alias("decision"))


def dataset_status(datasets: DataFrame, markers: DataFrame) -> DataFrame:
    """JOIN5: each dataset with last checked / updated instants and etag, or
    ``N/A`` where nothing is stored (an etag of NULL also shows N/A)."""
    m = markers.join(datasets.select("url"), "url", "left_semi")
    j = datasets.join(m, "url", "left")
    has = F.col("created_at").isNotNull()
    return j.select(
        "key",
        "name",
        "url",
        F.when(has, F.date_format("checked_at", ISO_MILLIS)).otherwise(F.lit(NOT_AVAILABLE)).alias("last_checked"),
        F.when(has, F.date_format("updated_at", ISO_MILLIS)).otherwise(F.lit(NOT_AVAILABLE)).alias("last_updated"),
        F.coalesce(F.col("etag"), F.lit(NOT_AVAILABLE)).alias("etag"),
    )


RUN_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("start", T.TimestampType(), False),
        T.StructField("end", T.TimestampType(), False),
        T.StructField("duration_ms", T.LongType(), False),
        T.StructField("decision", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)


def run_record(spark: SparkSession, dataset: str, start: dt.datetime, end: dt.datetime, decision: str | None, error: str | None) -> DataFrame:
    """CHG3: one run record row (appended to a ``runs`` table by the refresh job)."""
    ms = int((end - start).total_seconds() * 1000)
    return spark.createDataFrame([(dataset, start, end, ms, decision, error)], RUN_SCHEMA)


def marker_rows(marker: DataFrame, url: str | Column, last_modified: dt.datetime, checked_at: dt.datetime) -> DataFrame:
    """An observation row from a one-row snapshot marker."""
    u = url if isinstance(url, Column) else F.lit(url)
    return marker.select(
        u.alias("url"), "etag", ts_lit(last_modified).alias("last_modified"), ts_lit(checked_at).alias("checked_at")
    )
