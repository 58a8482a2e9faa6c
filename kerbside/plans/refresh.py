"""The dataset refresh job (CHG2): change gate → ingest → guarded replace →
marker commit, per dataset, with a run record each (CHG3).

The gate's decisions are one row per dataset of a fixed list, so they are
the only values brought to the driver; all data work stays in Spark jobs.
One dataset failing (bad rows abort its load) does not stop the others, and
its marker is not committed, so the next run retries it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.changes import change_gate, run_record
from kerbside.operators.merge import upsert_markers
from kerbside.sources.tables import TableStore


@dataclass
class Dataset:
    name: str  # table name in the store
    url: str  # source address, the marker key
    load: Callable[[SparkSession], DataFrame]  # staged rows of a new snapshot


@dataclass
class Outcome:
    name: str
    decision: str
    replaced: bool
    error: str | None


def refresh(
    spark: SparkSession,
    store: TableStore,
    datasets: list[Dataset],
    observations: DataFrame,
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
) -> list[Outcome]:
    """Run the refresh for every dataset, in order; returns one outcome each.

    ``observations``: (url, etag, last_modified, checked_at) probed for the
    datasets' urls (NULLs where the probe failed).
    """
    markers = store.load("markers")
    wanted = spark.createDataFrame([(d.url,) for d in datasets], "url string")
    obs = wanted.join(observations, "url", "left")
    gate = change_gate(obs, markers)
    decisions = {r["url"]: r["decision"] for r in gate.select("url", "decision").collect()}  # ≤ len(datasets) rows
    outcomes: list[Outcome] = []
    commit_urls: list[str] = []
    for d in datasets:
        start = now()
        decision = decisions.get(d.url, "unknown")
        replaced, error = False, None
        if decision == "changed":
            try:
                replaced = store.replace_if_nonempty(d.load(spark), d.name)
                commit_urls.append(d.url)  # marker committed only after success
            except Exception as exc:  # noqa: BLE001 - one dataset must not stop the next
                error = str(exc)
        elif decision == "unchanged":
            commit_urls.append(d.url)  # refresh checked_at / updated_at
        store.append(run_record(spark, d.name, start, now(), decision, error), "runs")
        outcomes.append(Outcome(d.name, decision, replaced, error))
    if commit_urls:
        commit = gate.where(F.col("url").isin(commit_urls))
        store.replace_if_nonempty(upsert_markers(markers, commit, now()), "markers")
    return outcomes
