"""Versioned Parquet tables with a guarded full replace (SNK1) and typed
scans (SRC4).

A table is a folder of immutable version folders plus a pointer dataset:

    <root>/<name>/v=<time>-<uuid>/part-*.parquet
    <root>/<name>/pointer/part-*.parquet      one row (version, committed_at) per commit

``replace_if_nonempty`` writes the staged rows, every column, to a new
version folder (which is what runs the strict typing checks: nothing is
pruned away), and only if that version holds at least one row appends its
number to the pointer dataset.  A one-row append commits as a single file,
so readers, which take the highest committed version once, never see a half
written table, and nothing is overwritten while it may be read.  An empty
snapshot leaves the previous version current and still succeeds.  Only
public DataFrame reads and writes are used, so any Hadoop-compatible store
works.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside import schemas

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "premises": schemas.PREMISES,
    "jobs": schemas.JOBS,
    "postcodes": schemas.POSTCODES,
    "markers": schemas.MARKERS,
}

# Sort order of the files of each table: equality lookups then prune row
# groups by min/max (the reference's secondary indexes).
TABLE_SORT: dict[str, list[str]] = {
    "premises": ["search_postcode", "id"],
    "jobs": ["premises_id", "date", "bin"],
    "postcodes": ["id"],
    "markers": ["url"],
}


class TableStore:
    """Versioned tables under one root folder (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def version_path(self, name: str, version: str) -> str:
        return f"{self.root}/{name}/v={version}"

    def _pointer_path(self, name: str) -> str:
        return f"{self.root}/{name}/pointer"

    def current_version(self, name: str) -> str | None:
        """Last committed version (a one-row aggregate), or None."""
        try:
            pointer = self.spark.read.parquet(self._pointer_path(name))
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":  # nothing committed yet
                return None
            raise
        return pointer.agg(F.max("version").alias("v")).first()["v"]

    # -- SRC4 ----------------------------------------------------------------
    def load(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """Typed scan of the current version (explicit schema, never inferred)."""
        v = self.current_version(name)
        schema = schema or TABLE_SCHEMAS.get(name)
        if v is None:
            if schema is None:
                raise FileNotFoundError(f"table {name} has no version")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.version_path(name, v))

    # -- SNK1 ----------------------------------------------------------------
    def replace_if_nonempty(
        self, staged: DataFrame, name: str, sort_by: Sequence[str] | None = None, num_partitions: int | None = None
    ) -> bool:
        """Write ``staged`` as the next version; make it current only if it has
        rows.  Returns True when the table was replaced."""
        keys = list(sort_by if sort_by is not None else TABLE_SORT.get(name, []))
        out = staged
        if keys:
            n = num_partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions") or "200")
            out = staged.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys]).sortWithinPartitions(*keys)
        # a name of its own for every attempt: leftovers of failed loads are no matter
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        path = self.version_path(name, version)
        out.write.mode("errorifexists").parquet(path)
        if self.spark.read.parquet(path).isEmpty():  # one-row decision
            return False
        commit = self.spark.createDataFrame([(version,)], "version string").select(
            "version", F.current_timestamp().alias("committed_at")
        )
        commit.coalesce(1).write.mode("append").parquet(self._pointer_path(name))
        return True

    def append(self, rows: DataFrame, name: str) -> None:
        """Append-only tables (run records): plain Parquet appends."""
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def load_appended(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")
