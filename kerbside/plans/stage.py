"""Cutting lineage through the shared checkpoint folder.

``materialize`` writes a DataFrame once as Parquet under the folder named by
``spark.checkpoint.dir`` and returns a scan of it.  Compared with
``Dataset.checkpoint`` on an unpersisted plan (which computes the plan twice:
once for the eager count, once to write the checkpoint) it computes the plan
once, stores columnar compressed data, and later reads prune columns.  The
folder is shared storage on a cluster, so a lost executor re-reads it
instead of recomputing the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kerbside.session import ensure_checkpoint_dir


def stage_path(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kerbside-stage/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = stage_path(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Drop every staged folder under the checkpoint folder.

    Staged data backs DataFrames returned earlier (they read it lazily), so
    call this once a job's results have been consumed.  Done by overwriting
    the stage root with an empty dataset (public write API, any store).
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kerbside-stage"
    spark.createDataFrame([], "cleared int").write.mode("overwrite").parquet(root)
