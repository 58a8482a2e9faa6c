"""Properties against brute force on small inputs."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbside import fixtures as fx
from kerbside.operators import geo as GEO
from kerbside.operators import merge as MG
from kerbside.operators.recents import recents_add_only, recents_fold
from kerbside.plans import feeds
from kerbside.plans.ordering import global_sequence, sequence_within
from tests.conftest import SF001, SF0001


def skewed(spark, n=3000):
    # one key holds a third of all rows; many ties on the order column
    rows = [(0 if i % 3 == 0 else i % 97, i % 5, i) for i in range(n)]
    return spark.createDataFrame(rows, "g long, o long, u long")


@pytest.mark.parametrize("parts", [1, 7, 13])
def test_sequence_within_equals_row_number(spark, parts):
    df = skewed(spark)
    got = sequence_within(df, ["g"], ["o", "u"], num_partitions=parts)
    w = Window.partitionBy("g").orderBy("o", "u")
    want = df.withColumn("seq", F.row_number().over(w) - 1)
    assert sorted(map(tuple, got.select("g", "u", "seq").collect())) == sorted(map(tuple, want.select("g", "u", "seq").collect()))


def test_sequence_within_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, u long")
    got = sorted(map(tuple, sequence_within(df, ["g"], ["u"], num_partitions=3).collect()), key=str)
    assert got == sorted([(None, 1, 0), (None, 2, 1), ("a", 3, 0)], key=str)


def test_global_sequence_equals_row_number(spark):
    df = skewed(spark)
    got = global_sequence(df, ["u"], num_partitions=5)
    assert sorted(map(tuple, got.select("u", "seq").collect())) == [(i, i) for i in range(3000)]


def test_sitemap_pages_small(spark):
    t = fx.load(spark, SF001)
    rows = feeds.sitemap_rows(t.premises, page_size=100).collect()
    ids = sorted(r.id for r in rows)
    pages = {r.id: r.page for r in rows}
    assert all(pages[i] == k // 100 for k, i in enumerate(ids))


def _haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    dp, dl = p2 - p1, math.radians(b[1]) - math.radians(a[1])
    h = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(min(h, 1.0)))


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(f"P{i:04d}", 53.7 + rnd.random() * 0.3, -1.7 + rnd.random() * 0.4) for i in range(500)]
    # a dense cluster: 150 points within ~300 m (more than the limit of 100)
    pts += [(f"D{i:04d}", 53.8 + rnd.random() * 0.002, -1.55 + rnd.random() * 0.003) for i in range(150)]
    df = spark.createDataFrame(pts, "id string, latitude double, longitude double")
    got = GEO.nearest_postcodes(df, limit=100, radius_m=2000.0).select("origin", "rank", "postcode").collect()
    got_map = {(r.origin, r.postcode): r.rank for r in got}
    want = {}
    for o in pts:
        cand = [(_haversine((o[1], o[2]), (p[1], p[2])), p[0] != o[0], p[0]) for p in pts]
        cand = sorted(c for c in cand if c[0] <= 2000.0)[:100]
        for k, c in enumerate(cand):
            want[(o[0], c[2])] = k
    assert got_map == want


def test_nearest_with_many_postcodes_at_one_point(spark):
    rnd = random.Random(5)
    pts = [(f"S{i:04d}", 53.8, -1.55) for i in range(300)]  # one point holds most rows
    pts += [(f"P{i:04d}", 53.79 + rnd.random() * 0.02, -1.56 + rnd.random() * 0.02) for i in range(60)]
    df = spark.createDataFrame(pts, "id string, latitude double, longitude double")
    got = {(r.origin, r.postcode): r.rank for r in GEO.nearest_postcodes(df, limit=100).select("origin", "rank", "postcode").collect()}
    want = {}
    for o in pts:
        cand = sorted(c for c in ((_haversine((o[1], o[2]), (p[1], p[2])), p[0] != o[0], p[0]) for p in pts) if c[0] <= 2000.0)[:100]
        for k, c in enumerate(cand):
            want[(o[0], c[2])] = k
    assert got == want


def test_nearest_plan_has_no_cartesian(spark):
    df = spark.createDataFrame([("A", 53.8, -1.5), ("B", 53.801, -1.5)], "id string, latitude double, longitude double")
    plan = GEO.nearest_postcodes(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_snapshot_diff_then_apply_gives_new(spark):
    old, new = fx.premises_snapshots(spark, SF001)
    cols = ["id", "address_room", "address_number", "address_street", "address_locality", "address_city", "address_postcode"]
    merged = MG.merge_premises(old, new, fx.MERGE_TS).select(*cols)
    want = new.select(*merged.columns)
    assert merged.exceptAll(want).count() == 0 and want.exceptAll(merged).count() == 0


def apply_ops(current: list, events: pd.DataFrame) -> list:
    """The list after the events, one at a time (brute force)."""
    for op, pid in zip(events["op"], events["pid"]):
        current = [] if op == "clear" else [p for p in current if p != pid]
        if op == "add":
            current = [pid, *current][:10]
    return current


def _python_replay(log: pd.DataFrame) -> dict:
    out = {}
    for user, g in log.sort_values(["ts", "event_id"], kind="stable").groupby("user_id"):
        cur = apply_ops([], g)
        if cur:
            out[user] = cur
    return out


def test_recents_fold_equals_replay(spark):
    log = fx.recents_log(spark, SF001)
    want = _python_replay(log.toPandas())
    got: dict = {}
    for r in sorted(recents_fold(log).collect(), key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append(r.pid)
    assert got == want


def test_add_only_window_equals_fold(spark):
    log = fx.recents_log(spark, SF001).where(F.col("op") == "add")
    want = _python_replay(log.toPandas())
    got: dict = {}
    for r in sorted(recents_add_only(log, salts=4).collect(), key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append(r.pid)
    assert got == want


def test_hot_premises_spreads_over_partitions(spark):
    """One premises holds a third of all jobs: the ordering step still gives
    every partition a similar share and numbers the hot premises densely."""
    from kerbside.plans.ordering import tag_sorted

    n = 30_000
    jobs = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 997 + 2).alias("premises_id"),
        F.when(F.col("id") % 2 == 0, F.lit("BLACK")).otherwise(F.lit("GREEN")).alias("bin"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("date"),
    )
    tagged, _ = tag_sorted(jobs, ["premises_id", "date", "bin", "id"], num_partitions=8)
    sizes = [r["count"] for r in tagged.groupBy("_kb_part").count().collect()]
    assert max(sizes) <= 2 * n / 8, sizes
    seq = sequence_within(jobs, ["premises_id"], ["date", "bin", "id"], num_partitions=8)
    hot = sorted(r.seq for r in seq.where("premises_id = 1").select("seq").collect())
    assert hot == list(range(n // 3))


def test_ordering_exchanges_base_rows_once(spark, monkeypatch):
    """One range exchange before the numbering; afterwards only one row per
    partition is shuffled, and the carries are broadcast."""
    from kerbside.plans import ordering

    staged = []
    keep = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, tag: staged.append(df) or keep(df, tag))
    t = fx.load(spark, SF001)
    jobs = feeds.numbered_jobs(t.premises, t.jobs)
    before = staged[0]._jdf.queryExecution().executedPlan().toString()
    assert before.count("Exchange rangepartitioning(premises_id") == 1 and "Exchange hashpartitioning(seq" not in before
    after = jobs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in after and "SortMergeJoin" not in after
    base = after.split("BroadcastExchange")[0]  # the side with the rows themselves
    assert "Exchange hashpartitioning" not in base and "Exchange rangepartitioning" not in base


def test_recents_fold_batch_random_logs(spark):
    """Exact batch fold vs a plain replay: few ids (many re-adds, removes and
    cap evictions), clears, and one user holding most events."""
    import datetime as dt

    from kerbside.operators.recents import recents_fold

    rnd = random.Random(11)
    rows, eid = [], 0
    t0 = dt.datetime(2024, 1, 1)
    for user, n in [(1, 3000), (2, 40), (3, 15), (4, 200)]:
        for _ in range(n):
            eid += 1
            r = rnd.random()
            op = "add" if r < 0.6 else ("remove" if r < 0.97 else "clear")
            rows.append((user, t0 + dt.timedelta(seconds=rnd.randrange(0, 5000)), eid, op, rnd.randrange(0, 25)))
    log = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, op string, pid long")
    want = _python_replay(pd.DataFrame(rows, columns=["user_id", "ts", "event_id", "op", "pid"]))
    got: dict = {}
    for r in sorted(recents_fold(log).collect(), key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append(r.pid)
    assert got == want


def test_list_summaries_join_in_any_grouping():
    """Summaries of slices, joined left to right, as a tree or all at once,
    leave the list that a plain replay leaves."""
    from kerbside.operators.list_fold import Summary

    rnd = random.Random(17)
    for trial in range(400):
        limit, ids = rnd.choice([1, 2, 3, 10]), rnd.choice([2, 4, 8, 30])
        weights = rnd.choice([(6, 4, 0), (5, 5, 1), (1, 9, 0), (9, 1, 1)])
        events = [(rnd.choices(["add", "remove", "clear"], weights)[0], rnd.randrange(ids)) for _ in range(rnd.randrange(0, 80))]
        want: list = []
        for op, pid in events:
            want = [] if op == "clear" else [x for x in want if x != pid]
            want = ([pid] + want)[:limit] if op == "add" else want
        cuts = sorted(rnd.randrange(len(events) + 1) for _ in range(rnd.randrange(5)))
        runs = []
        for a, b in zip([0, *cuts], [*cuts, len(events)]):
            one = Summary(limit)
            for op, pid in events[a:b]:
                one.event(op, pid)
            runs.append(one)
        left = runs[0]
        for one in runs[1:]:
            left = left.then(one)
        tree = list(runs)
        while len(tree) > 1:
            k = rnd.randrange(len(tree) - 1)
            tree[k : k + 2] = [tree[k].then(tree[k + 1])]
        lists = []
        for one in runs:
            lists = one.after(lists)
        assert left.after([]) == tree[0].after([]) == lists == want, (trial, events, cuts)
        assert all(len(x.touched) <= ids and len(x.front) <= limit for x in runs)


def test_hot_user_is_many_summaries(spark):
    """One user holds most events: every partition that holds some of them
    gives one small row."""
    from kerbside.operators.list_fold import slice_summaries

    n = 40_000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit(1)).otherwise(F.col("id") % 500 + 2).alias("user_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 5 == 0, "remove").otherwise("add").alias("op"),
        (F.col("id") * 7 % 1000).alias("pid"),
    )
    hot = slice_summaries(log, 10).where("user_id = 1").collect()
    assert len(hot) >= 4 and all(r.fresh and not r.touched and len(r.front) <= 10 for r in hot)


def _brute_nearest(pts, limit=100, radius=2000.0):
    import numpy as np

    names = [p[0] for p in pts]
    lat = np.radians([p[1] for p in pts])
    lon = np.radians([p[2] for p in pts])
    want = {}
    for i, o in enumerate(names):
        h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat) * np.sin((lon - lon[i]) / 2) ** 2
        d = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        cand = sorted((float(d[j]), names[j] != o, names[j]) for j in range(len(names)) if d[j] <= radius)[:limit]
        for k, c in enumerate(cand):
            want[(o, c[2])] = k
    return want


def test_nearest_dense_cluster_of_distinct_points(spark):
    """2,000 distinct points within ~40 m (most of the data) next to sparse
    points: origins in the cluster are resolved at a fine level."""
    rnd = random.Random(7)
    pts = [(f"C{i:05d}", 53.8 + rnd.random() * 0.0004, -1.55 + rnd.random() * 0.0006) for i in range(2000)]
    pts += [(f"S{i:04d}", 53.79 + rnd.random() * 0.03, -1.57 + rnd.random() * 0.04) for i in range(300)]
    # a ring of points just outside the cluster, in the neighbouring coarse cells
    pts += [(f"R{i:04d}", 53.8 + 0.0002 + 0.0045 * math.sin(i), -1.55 + 0.0003 + 0.007 * math.cos(i)) for i in range(200)]
    df = spark.createDataFrame(pts, "id string, latitude double, longitude double")
    got = {(r.origin, r.postcode): r.rank for r in GEO.nearest_postcodes(df).select("origin", "rank", "postcode").collect()}
    assert got == _brute_nearest(pts)


def test_nearest_at_the_antimeridian_and_the_poles(spark):
    rnd = random.Random(11)
    pts = [(f"F{i:04d}", -17.0 + rnd.random() * 0.03, (179.98 + rnd.random() * 0.04 + 180) % 360 - 180) for i in range(250)]
    pts += [(f"N{i:04d}", 89.95 + rnd.random() * 0.05, rnd.random() * 360 - 180) for i in range(250)]
    pts += [("N9998", 90.0, 12.0), ("N9999", 90.0, -77.0), ("E0001", 0.0, 180.0), ("E0002", 0.0, -180.0), ("E0003", 0.001, 179.999)]
    pts += [(f"S{i:04d}", -89.99 - rnd.random() * 0.01, rnd.random() * 360 - 180) for i in range(150)]
    pts += [(f"A{i:04d}", 70.0 + rnd.random() * 0.002, 25.0 + rnd.random() * 0.006) for i in range(300)]
    df = spark.createDataFrame(pts + [("X", None, 1.0), ("Y", 1.0, None)], "id string, latitude double, longitude double")
    got = {(r.origin, r.postcode): r.rank for r in GEO.nearest_postcodes(df).select("origin", "rank", "postcode").collect()}
    want = _brute_nearest(pts)
    assert got == want
    some = ["F0000", "N9998", "S0001", "A0007", "E0002", "X"]
    frame = spark.createDataFrame([(p,) for p in some + some[:2]], "postcode string")
    one = {(r.origin, r.postcode): r.rank for r in GEO.nearest_postcodes(df, frame).select("origin", "rank", "postcode").collect()}
    assert one == {k: v for k, v in want.items() if k[0] in some}
    few = {(r.origin, r.postcode): r.rank for r in GEO.nearest_postcodes(df, limit=5, radius_m=300.0).select("origin", "rank", "postcode").collect()}
    assert few == _brute_nearest(pts, 5, 300.0)


def test_one_origin_reads_only_its_box(spark, tmp_dir):
    """The origin's box reaches the scan, and only its surroundings are staged."""
    from kerbside.operators import nearest

    rows = [(f"P{i:05d}", 50.0 + i * 0.001, -1.0) for i in range(5000)]
    spark.createDataFrame(rows, "id string, latitude double, longitude double").write.parquet(f"{tmp_dir}/pc")
    stored = spark.read.parquet(f"{tmp_dir}/pc")
    staged = {}
    keep, nearest.materialize = nearest.materialize, lambda df, tag: staged.setdefault(tag, (df, keep(df, tag)))[1]
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
        out = nearest.nearest_postcodes(stored, spark.createDataFrame([("P02500",)], "postcode string"))
        assert out.count() == 35
    finally:
        nearest.materialize = keep
    points, written = staged["near-points"]
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan
    assert written.count() < 60 and staged["near-origins"][1].count() == 1


def test_nearest_pairs_are_ranked_in_their_tile(spark):
    """The pairs of an origin meet in one task: nothing is exchanged by origin,
    and the reach is cut until it holds few more than ``limit`` points."""
    from kerbside.operators import nearest

    rnd = random.Random(13)
    pts = [(f"C{i:05d}", 53.8 + rnd.random() * 0.02, -1.55 + rnd.random() * 0.03) for i in range(3000)]
    df = spark.createDataFrame(pts, "id string, latitude double, longitude double")
    staged = {}
    keep, nearest.materialize = nearest.materialize, lambda df, tag: staged.update({tag: keep(df, tag)}) or staged[tag]
    try:
        out = nearest.nearest_postcodes(df, limit=20)
    finally:
        nearest.materialize = keep
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(origin" not in plan and "WindowGroupLimit" in plan
    lat, lon = [p[1] for p in pts], [p[2] for p in pts]
    for r in staged["near-reach"].limit(100).collect():
        held = sum(_haversine((r.olat, r.olon), q) <= r.reach for q in zip(lat, lon))
        assert 20 <= held <= 40
    got = {(r.origin, r.postcode): r.rank for r in out.collect()}
    assert got == _brute_nearest(pts, 20)


def test_nearest_with_an_id_on_several_rows(spark):
    """The nearest of all places of an id are ranked together; a null id has
    its own row only, and is nobody's neighbour."""
    rows = [("A", 53.8, -1.5), ("A", 53.801, -1.5), ("B", 53.8002, -1.5), ("C", 53.8011, -1.5), ("D", 53.85, -1.5), ("D", 53.85, -1.5), (None, 53.8, -1.5)]
    df = spark.createDataFrame(rows, "id string, latitude double, longitude double")
    got = sorted(((r.origin or "", r.rank, r.postcode) for r in GEO.nearest_postcodes(df, limit=4).collect()), key=str)
    assert got == [
        ("", 0, None),
        ("A", 0, "A"), ("A", 1, "A"), ("A", 2, "C"), ("A", 3, "B"),
        ("B", 0, "B"), ("B", 1, "A"), ("B", 2, "A"), ("B", 3, "C"),
        ("C", 0, "C"), ("C", 1, "A"), ("C", 2, "B"), ("C", 3, "A"),
        ("D", 0, "D"), ("D", 1, "D"),
    ]


def test_nearest_crowd_at_one_place_is_dealt(spark):
    from kerbside.operators import nearest

    pts = [(f"S{i:04d}", 53.8, -1.55) for i in range(1500)] + [("P", 53.8001, -1.55)]
    df = spark.createDataFrame(pts, "id string, latitude double, longitude double")
    staged = {}
    keep, nearest.materialize = nearest.materialize, lambda df, tag: staged.update({tag: keep(df, tag)}) or staged[tag]
    try:
        out = nearest.nearest_postcodes(df, limit=10)
        assert out.count() == 1501 * 10
    finally:
        nearest.materialize = keep
    parts = [r["count"] for r in staged["near-reach"].groupBy(*nearest.TILE).count().collect()]
    assert len(parts) > 3 and max(parts) < 800


def test_nearby_queries_search_once(spark):
    """Queries that read the nearest postcodes more than once store them."""
    from kerbside.plans import registry

    tags, keep = [], registry.materialize
    registry.materialize = lambda df, tag: (tags.append(tag), keep(df, tag))[1]
    try:
        for q in (registry.q_map_markers, registry.q_date_facets, registry.q_nearby_jobs, registry.q_default_dates):
            q(spark, SF0001)
    finally:
        registry.materialize = keep
    assert tags == ["near"] * 4


def test_grid_cells_are_as_wide_as_high_and_few(spark):
    from kerbside.operators.nearest import Grid

    grid = Grid(2000.0)
    rows = [(float(lat), lon) for lat in (-90, -89.99, -60, 0, 33, 70, 89.9, 89.97, 89.999, 90) for lon in (-180.0, -0.01, 179.99)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    probes = grid.around(F.col("latitude"), F.col("longitude"), F.lit(2000.0), F.lit(0))
    got = df.select("latitude", F.size(probes).alias("n"), F.size(F.array_distinct(probes)).alias("d")).collect()
    assert all(r.n == r.d for r in got)
    assert max(r.n for r in got) <= 110 and max(r.n for r in got if abs(r.latitude) < 89) <= 30


def test_add_only_uses_the_last_add_as_a_pair(spark):
    """Event ids need not follow time: order by the last add's own (ts, id)."""
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=10), 1, "add", 7), (1, t + dt.timedelta(seconds=5), 99, "add", 7),
            (1, t + dt.timedelta(seconds=10), 50, "add", 8)]  # ties pid 7's last add in time
    log = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, op string, pid long")
    got = [r.pid for r in sorted(recents_add_only(log).collect(), key=lambda r: r.position)]
    assert got == _python_replay(pd.DataFrame(rows, columns=["user_id", "ts", "event_id", "op", "pid"]))[1] == [8, 7]


def test_ical_lines_of_one_small_file_are_dealt(spark):
    """A small file of premises is one scan task, but its lines are many: they
    are made by several tasks, event lines of a premises alike."""
    import datetime as dt

    premises = fx.load(spark, SF0001).premises.coalesce(1)
    jobs = fx.jobs_source(spark, SF0001)
    lines = feeds.ical_lines(premises, jobs, dt.datetime(2000, 6, 1))
    heads = lines.where("part = 0").select("premises_id", F.spark_partition_id().alias("task")).distinct()
    assert heads.select("task").distinct().count() > 4
    located = lines.where("part = 1 and line like 'LOCATION:%'").groupBy("premises_id").agg(F.countDistinct("line").alias("n"))
    assert located.where("n <> 1").isEmpty() and not located.isEmpty()
