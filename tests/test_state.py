"""State handling: guarded replace, change gate, merges, upserts, refresh job."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.operators import changes as CHG
from kerbside.operators import merge as MG
from kerbside.plans.refresh import Dataset, refresh
from kerbside.sources import ingest as ING
from kerbside.sources.tables import TableStore
from tests import samples

T0 = dt.datetime(2024, 1, 1, 3, 0)
T1 = dt.datetime(2024, 2, 1, 3, 0)


def test_replace_if_nonempty(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    p = samples.premises(spark)
    assert store.replace_if_nonempty(p, "premises") is True
    first = store.current_version("premises")
    assert store.replace_if_nonempty(p.limit(0), "premises") is False  # empty: keep old rows
    assert store.current_version("premises") == first
    assert store.load("premises").count() == 4
    bad = p.withColumn("address_city", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception):
        store.replace_if_nonempty(bad, "premises")
    assert store.current_version("premises") == first
    assert store.replace_if_nonempty(p.where("id > 100"), "premises") is True
    assert store.current_version("premises") > first  # the empty and failed versions were never made current
    assert store.load("premises").count() == 2


def _markers(spark, rows):
    return spark.createDataFrame(rows, schemas.MARKERS)


def test_change_gate_outcomes(spark):
    markers = _markers(spark, [("u1", "e1", T0, T0, T0), ("u2", "e2", T0, T0, T0), ("u4", None, T0, T0, T0)])
    obs = spark.createDataFrame(
        [("u1", "e1", T1, T1), ("u2", "e9", T1, T1), ("u3", "e3", T1, T1), ("u4", "e4", T1, T1), ("u5", None, None, T1)],
        "url string, etag string, last_modified timestamp, checked_at timestamp",
    )
    got = {r.url: r.decision for r in CHG.change_gate(obs, markers).collect()}
    assert got == {"u1": "unchanged", "u2": "changed", "u3": "changed", "u4": "changed", "u5": "unknown"}


def test_upsert_markers_keeps_created(spark):
    markers = _markers(spark, [("u1", "e1", T0, T0, T0)])
    obs = spark.createDataFrame([("u1", "e2", T1, T1), ("u2", "x", T1, T1)], "url string, etag string, last_modified timestamp, checked_at timestamp")
    got = {r.url: r for r in MG.upsert_markers(markers, obs, T1).collect()}
    assert got["u1"].etag == "e2" and got["u1"].created_at == T0 and got["u1"].updated_at == T1
    assert got["u2"].created_at == T1


def test_merge_premises_timestamps(spark):
    old = samples.premises(spark)
    new = old.where("id <> 8").withColumn("address_locality", F.when(F.col("id") == 7, F.lit("X")).otherwise(F.col("address_locality")))
    new = new.unionByName(old.where("id = 8").withColumn("id", F.lit(9).cast("long")))
    got = {r.id: r for r in MG.merge_premises(old, new, T1).collect()}
    assert sorted(got) == [7, 9, 1001, 1002]
    assert got[1001].updated_at == samples.LOAD and got[1001].created_at == samples.LOAD
    assert got[7].updated_at == T1 and got[7].created_at == samples.LOAD
    assert got[9].created_at == T1 and got[9].search_postcode is None
    diff = {r.id: r.op for r in MG.snapshot_diff(old, new).collect()}
    assert diff == {7: "update", 8: "delete", 9: "insert", 1002: "unchanged", 1001: "unchanged"}


def test_upsert_postcodes(spark):
    old = spark.createDataFrame([("A", 1.0, 2.0, T0, T0)], schemas.POSTCODES)
    batch = spark.createDataFrame([("A", 5.0, 6.0), ("B", 7.0, 8.0)], "id string, latitude double, longitude double")
    got = {r.id: r for r in MG.upsert_postcodes(old, batch, T1).collect()}
    assert (got["A"].latitude, got["A"].longitude, got["A"].updated_at) == (5.0, 6.0, T0)
    assert got["B"].created_at == T1
    dup = batch.unionByName(batch.limit(1))
    with pytest.raises(Exception):
        MG.upsert_postcodes(old, dup, T1).collect()


def test_merge_jobs(spark):
    old = samples.jobs(spark)
    new = old.where("id <> 1").unionByName(spark.createDataFrame([(50, 1001, "GREEN", dt.date(2024, 9, 1))], schemas.JOBS))
    got = MG.merge_jobs(old, new).collect()
    assert sorted(r.origin for r in got).count("inserted") == 1
    assert all(r.id != 1 for r in got)
    assert max(r.id for r in got) == 8  # fresh ids follow the largest old id


def test_refresh_job(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    store = TableStore(spark, os.path.join(tmp_dir, "store"))
    good = os.path.join(src, "good.csv")
    with open(good, "wb") as f:
        f.write(b"1,,2,HIGH STREET,,NORTHTOWN,AB1 2CD\n")
    bad = os.path.join(src, "bad.csv")
    with open(bad, "wb") as f:
        f.write(b"x,,2,HIGH STREET,,NORTHTOWN,AB1 2CD\n")
    empty = os.path.join(src, "empty.csv")
    open(empty, "wb").close()
    url = "https://example.org/premises.csv"
    obs = lambda e: spark.createDataFrame([(url, e, T1, T1)], "url string, etag string, last_modified timestamp, checked_at timestamp")

    def ds(path):
        return [Dataset("premises", url, lambda s: ING.read_premises_csv(s, path, T1))]

    out = refresh(spark, store, ds(good), obs("e1"), now=lambda: T1)
    assert (out[0].decision, out[0].replaced) == ("changed", True)
    assert store.load("premises").count() == 1
    out = refresh(spark, store, ds(good), obs("e1"), now=lambda: T1)
    assert out[0].decision == "unchanged"
    out = refresh(spark, store, ds(bad), obs("e2"), now=lambda: T1)
    assert out[0].error and store.load("markers").first().etag == "e1"  # marker not committed
    assert store.load("premises").count() == 1
    out = refresh(spark, store, ds(empty), obs("e3"), now=lambda: T1)
    assert (out[0].decision, out[0].replaced, out[0].error) == ("changed", False, None)
    assert store.load("markers").first().etag == "e3"  # empty snapshot still commits the marker
    assert store.load("premises").count() == 1
    assert store.load_appended("runs").count() == 4


def test_clear_stages(spark):
    from kerbside.plans.stage import clear_stages, materialize, stage_path

    staged = materialize(spark.range(5), "probe")
    assert staged.count() == 5
    clear_stages(spark)
    assert spark.read.parquet(stage_path(spark, "x").rsplit("/", 1)[0]).count() == 0


def test_pruned_select_still_refuses_duplicate_keys(spark):
    from kerbside.operators.merge import upsert_postcodes

    old = spark.createDataFrame([], "id string, latitude double, longitude double, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([("A", 1.0, 2.0), ("A", 3.0, 4.0)], "id string, latitude double, longitude double")
    with pytest.raises(Exception, match="duplicate id"):
        upsert_postcodes(old, batch, T0).select("id", "longitude").collect()


def test_weighted_pick_returns_k(spark):
    from kerbside.operators.geo import random_pending_geocodes

    p = samples.premises(spark)
    many = spark.range(200).selectExpr("id", "concat('P', id % 25) as address_postcode")
    none = spark.createDataFrame([], "id string")
    assert random_pending_geocodes(many, none, k=20, seed=3).distinct().count() == 20
    assert random_pending_geocodes(many, none, k=100).count() == 25
    assert p.count() == 4


def test_sitemap_page_reads_an_id_range(spark, tmp_dir):
    """Pages by the stored index equal the numbered ones; the range is pushed
    to the scan and the files are sorted on it."""
    import datetime as dt

    from kerbside.plans import feeds

    rows = [(i * 3 % 1009 + 1, dt.datetime(2024, 1, 1)) for i in range(1000)]
    store = TableStore(spark, tmp_dir)
    table = spark.createDataFrame(rows, "id long, updated_at timestamp")
    store.replace_if_nonempty(table, "paged", sort_by=["id"])
    stored = store.load("paged", table.schema)
    index = feeds.page_index(stored, 300)
    assert sorted(r.page for r in index.collect()) == [0, 1, 2, 3]
    ids = sorted(i for i, _ in rows)
    for page in range(5):
        got = sorted(r.id for r in feeds.indexed_sitemap_page(stored, index, page).collect())
        assert got == ids[page * 300 : (page + 1) * 300]
    plan = feeds.page_of(stored, index, 1)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(id,{ids[300]})" in plan and f"LessThan(id,{ids[600]})" in plan
