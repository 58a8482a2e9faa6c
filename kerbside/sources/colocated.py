"""Premises and jobs stored bucketed on the premises id (JOIN2, SNK7-9).

Two tables bucketed alike join without an exchange of either.  What adaptive
execution could not split there, a premises with very many jobs, is stored
apart: its jobs lie in a plain table, spread over many files, and meet their
premises by broadcast.  There are at most ``buckets / HOT_FACTOR`` such
premises, since each has more than ``HOT_FACTOR`` times a bucket's mean.

    <root>/premises, <root>/jobs    bucketed on id and premises_id
    <root>/hot_jobs, <root>/hot_ids plain Parquet

The bucketing is a property of the catalog's table, so a session that did not
write the folder opens it with ``open_colocated``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_FACTOR = 2  # times the mean of a bucket's jobs

_KEYS = {"premises": "id", "jobs": "premises_id"}


@dataclass
class Colocated:
    premises: DataFrame
    jobs: DataFrame  # but those of hot premises
    hot_jobs: DataFrame
    hot_ids: DataFrame


def write_colocated(premises: DataFrame, jobs: DataFrame, root: str, buckets: int) -> Colocated:
    """Store both tables under ``root`` and open them.  The folders must not
    exist yet.  Jobs of premises that do not exist are stored too."""
    spark, root = premises.sparkSession, root.rstrip("/")
    total = jobs.count()
    counts = jobs.groupBy("premises_id").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") * buckets > F.lit(HOT_FACTOR * total)).select(F.col("premises_id").alias("hot_id"))
    hot.coalesce(1).write.parquet(f"{root}/hot_ids")
    hot = F.broadcast(spark.read.schema(hot.schema).parquet(f"{root}/hot_ids"))  # at most buckets / HOT_FACTOR rows
    is_hot = F.col("premises_id") == F.col("hot_id")
    jobs.join(hot, is_hot, "left_semi").write.parquet(f"{root}/hot_jobs")
    tables = {name: _table_name(name) for name in _KEYS}
    for name, rows in (("premises", premises), ("jobs", jobs.join(hot, is_hot, "left_anti"))):
        key = _KEYS[name]
        # the exchange deals rows as the buckets do: one file each
        (
            rows.repartition(buckets, key)
            .write.bucketBy(buckets, key)
            .sortBy(key)
            .option("path", f"{root}/{name}")
            .saveAsTable(tables[name])
        )
    return _opened(spark, root, tables)


def _table_name(name: str) -> str:
    return f"kerbside_{name}_{uuid.uuid4().hex}"


def open_colocated(spark: SparkSession, root: str, buckets: int, premises: DataFrame, jobs: DataFrame) -> Colocated:
    """The tables that ``write_colocated`` left under ``root``, with the columns
    of the given DataFrames; registers them with the session's catalog."""
    root = root.rstrip("/")
    tables = {name: _table_name(name) for name in _KEYS}
    for name, like in (("premises", premises), ("jobs", jobs)):
        table, key = tables[name], _KEYS[name]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{root}/{name}'"
        )
    return _opened(spark, root, tables)


def _opened(spark: SparkSession, root: str, tables: dict[str, str]) -> Colocated:
    jobs = spark.table(tables["jobs"])
    return Colocated(
        premises=spark.table(tables["premises"]),
        jobs=jobs,
        hot_jobs=spark.read.schema(jobs.schema).parquet(f"{root}/hot_jobs"),
        hot_ids=spark.read.schema("hot_id long").parquet(f"{root}/hot_ids"),
    )


def premises_job_rows(stored: Colocated, premises_cols: list[str], job_cols: list[str]) -> DataFrame:
    """JOIN2 as rows: ``premises_cols`` and ``job_cols`` of every premises and
    each of its jobs; a premises without jobs is one row with NULLs.  Column
    names of the two lists must differ."""
    hot = F.broadcast(stored.hot_ids)
    is_hot = F.col("id") == F.col("hot_id")
    p = stored.premises.select(*dict.fromkeys(["id", *premises_cols]))

    def jobs_of(jobs: DataFrame) -> DataFrame:
        return jobs.select(F.col("premises_id").alias("_of"), *[F.col(c).alias(f"_j_{c}") for c in job_cols])

    out = [*premises_cols, *[F.col(f"_j_{c}").alias(c) for c in job_cols]]
    of = F.col("id") == F.col("_of")
    cold = p.join(hot, is_hot, "left_anti").join(jobs_of(stored.jobs), of, "left").select(*out)
    crowded = jobs_of(stored.hot_jobs).join(F.broadcast(p.join(hot, is_hot, "left_semi")), of).select(*out)
    return cold.unionByName(crowded)
