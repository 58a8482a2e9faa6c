"""Hot keys and skipped work: searches, snapshot changes, co-located tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.operators import lookup as LK
from kerbside.operators import merge as MG
from kerbside.sources import colocated as COL
from tests import samples
from tests.test_plans import plan_of


def _many_premises(spark, n, third="AB1 2CD"):
    """n premises, a third of them at one postcode."""
    pc = F.when(F.col("id") % 3 == 0, F.lit(third)).otherwise(F.concat(F.lit("AB"), (F.col("id") % 499).cast("string"), F.lit(" 1ZZ")))
    part = lambda c: F.lit(c).cast("string")
    return spark.range(n).select(
        "id",
        part(None).alias("address_room"),
        (F.col("id") % 40).cast("string").alias("address_number"),
        part("A ROAD").alias("address_street"),
        part(None).alias("address_locality"),
        part("NORTHTOWN").alias("address_city"),
        pc.alias("address_postcode"),
        F.upper(F.replace(pc, F.lit(" "), F.lit(""))).alias("search_postcode"),
        F.lit(samples.LOAD).alias("created_at"),
        F.lit(samples.LOAD).alias("updated_at"),
    )


@pytest.fixture()
def shuffle_joins(spark):
    """Neither broadcasts by size nor adaptive splits: what a join does by itself."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_search_splits_a_hot_postcode(spark, shuffle_joins):
    n = 30_000
    p = _many_premises(spark, n).repartition(8)
    req = p.select(F.col("address_postcode").alias("request_id"), F.col("address_postcode").alias("postcode")).distinct()
    keyed = req.withColumn("_key", F.upper(F.replace("postcode", F.lit(" "), F.lit(""))))

    def largest(slice_rows):
        hits = LK._search_hits(p, keyed, LK.hot_postcodes(p, slice_rows))
        sizes = [r["count"] for r in hits.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n
        return max(sizes) / (n / 8)

    assert largest(n) > 2.5  # unsplit
    assert largest(100) < 2
    hot = LK.hot_postcodes(p, 100)
    assert [(r.search_postcode, r.slices) for r in hot.collect()] == [("AB12CD", 100)]
    # the same answer, rank for rank
    plain, split = (LK.search_premises(p, req, hot=LK.hot_postcodes(p, s)).orderBy("request_id", "rank").collect() for s in (n, 100))
    assert plain == split


def test_search_keeps_repeated_requests_and_nulls(spark):
    p = _many_premises(spark, 60)
    req = spark.createDataFrame([("a", "ab1 2cd", 1), ("b", "AB12CD", 2), ("c", None, 3)], "request_id string, postcode string, slices int")
    got = LK.search_premises(p, req, hot=LK.hot_postcodes(p, 3)).groupBy("request_id", "slices").count().collect()
    assert {(r.request_id, r.slices): r["count"] for r in got} == {("a", 1): 20, ("b", 2): 20}
    assert LK.search_premises(p.limit(0), req).count() == 0


def test_snapshot_changes_read_changed_ranges_only(spark):
    old = _many_premises(spark, 20_000)
    width = MG.range_width(old, range_rows=100)
    assert width == 100
    # two of 200 ranges: an update, and a delete with an insert
    new = old.withColumn("address_room", F.when(F.col("id") == 4_217, F.lit("FLAT 1"))).where("id <> 9950")
    new = new.unionByName(old.where("id = 9950").withColumn("id", F.lit(9_951_000).cast("long")))
    stored = MG.range_digests(old, width)
    ranges = MG.changed_ranges(stored, MG.range_digests(new, width))
    assert sorted(r[0] for r in ranges.collect()) == [4_200, 9_900, 9_951_000]
    assert MG.in_ranges(old, ranges, width).count() == 200  # 1 % of the rows
    assert MG.in_ranges(new, ranges, width).count() == 200
    want = MG.snapshot_diff(old, new).where("op <> 'unchanged'").orderBy("id").collect()
    assert [(r.id, r.op) for r in want] == [(4_217, "update"), (9_950, "delete"), (9_951_000, "insert")]
    for given in ({"width": width, "old_digests": stored}, {"range_rows": 7}):
        assert MG.snapshot_changes(old, new, **given).orderBy("id").collect() == want


def test_digests_tell_nulls_swaps_and_copies_apart(spark):
    schema = "id long, a string, b string"
    base = [(-5, "x", None), (3, None, "y"), (4, "", "z")]

    def digest(rows):
        return MG.range_digests(spark.createDataFrame(rows, schema), 10, "id", ["a", "b"]).orderBy("_range").collect()

    assert digest(base) == digest(base[::-1])
    assert [r["_range"] for r in digest(base)] == [-10, 0]
    for other in ([(-5, None, "x"), *base[1:]], [base[0], (3, "y", None), base[2]], [*base[:2], (4, None, "z")], [*base, base[2]], [*base, base[2], base[2]]):
        assert digest(other) != digest(base)


def test_snapshot_changes_of_empty_snapshots(spark):
    p = samples.premises(spark)
    none = p.limit(0)
    assert MG.snapshot_changes(none, none).count() == 0
    assert {r.op for r in MG.snapshot_changes(none, p).collect()} == {"insert"}
    assert {r.op for r in MG.snapshot_changes(p, none).collect()} == {"delete"}
    with pytest.raises(ValueError):
        MG.snapshot_changes(p, p, old_digests=MG.range_digests(p, 10))


def _crowded_jobs(spark, n):
    """n jobs, a third of them at premises 77, some at premises that do not exist."""
    of = F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id") % 1_100)
    return spark.range(n).select("id", of.cast("long").alias("premises_id"), F.lit("BLACK").alias("bin"), F.lit(dt.date(2024, 7, 1)).alias("date"))


def test_colocated_join_has_no_exchange(spark, tmp_dir, shuffle_joins):
    premises, jobs = _many_premises(spark, 1_000), _crowded_jobs(spark, 9_000).repartition(6)
    root = f"{tmp_dir}/colocated"
    stored = COL.write_colocated(premises, jobs.withColumnRenamed("id", "job_id"), root, buckets=16)
    assert [r.hot_id for r in stored.hot_ids.collect()] == [77]
    assert {r.premises_id for r in stored.hot_jobs.select("premises_id").distinct().collect()} == {77}
    cols = ["id", "address_postcode"], ["job_id", "bin", "date"]
    want = premises.join(jobs.withColumnRenamed("id", "job_id"), F.col("id") == F.col("premises_id"), "left").select(*cols[0], *cols[1])
    again = COL.open_colocated(spark, root, 16, premises, jobs.withColumnRenamed("id", "job_id"))
    for opened in (stored, again):
        rows = COL.premises_job_rows(opened, *cols)
        plan = plan_of(rows)
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        assert sorted(rows.collect(), key=str) == sorted(want.collect(), key=str)
    sizes = [r["count"] for r in again.jobs.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_colocated_empty_tables(spark, tmp_dir):
    premises, jobs = samples.premises(spark), samples.jobs(spark).withColumnRenamed("id", "job_id")
    stored = COL.write_colocated(premises, jobs.limit(0), f"{tmp_dir}/no-jobs", buckets=4)
    assert COL.premises_job_rows(stored, ["id"], ["job_id"]).where("job_id IS NULL").count() == 4
    stored = COL.write_colocated(premises.limit(0), jobs, f"{tmp_dir}/no-premises", buckets=4)
    assert COL.premises_job_rows(stored, ["id"], ["job_id"]).count() == 0
