"""Lookup edge cases: validation, ordering branches, nested arrays."""

from __future__ import annotations

import datetime as dt

from kerbside.operators import lookup as LK
from tests import samples


def test_validate_job_requests(spark):
    raw = spark.createDataFrame(
        [(1, "1001", None), (2, " 12 ", "csv"), (3, "1.5", "json"), (4, "", "ical"), (5, None, None), (6, "7", "xml"), (7, "-3", "ical")],
        "request_id int, premises string, format string",
    )
    got = {r.request_id: (r.premises_id, r.format, r.error) for r in LK.validate_job_requests(raw).collect()}
    assert got[1] == (1001, "json", None)
    assert got[2] == (12, "csv", None)
    assert got[3][2] and got[4][2] and got[5][2]
    assert got[6] == (7, "xml", "format: expected one of json, csv, ical")
    assert got[7] == (-3, "ical", None)
    ok, bad = LK.split_valid(LK.validate_job_requests(raw))
    assert ok.count() == 3 and bad.count() == 4


def test_search_orders_by_house_number_then_text(spark):
    p = samples.premises(spark)
    extra = spark.createDataFrame(
        [(20, None, "10", "A ROAD", None, "NORTHTOWN", "AB1 2CD", "AB12CD", samples.LOAD, samples.LOAD),
         (21, "FLAT 2", "3", "A ROAD", None, "NORTHTOWN", "AB1 2CD", "AB12CD", samples.LOAD, samples.LOAD),
         (22, None, "THE MEWS", "A ROAD", None, "NORTHTOWN", "AB1 2CD", "AB12CD", samples.LOAD, samples.LOAD)],
        p.schema,
    )
    req = spark.createDataFrame([("r", "ab1 2cd")], "request_id string, postcode string")
    rows = LK.search_premises(p.unionByName(extra), req).orderBy("rank").collect()
    # sorter: THE MEWS→0, 1, 2, 3, 10; ties keep room/number/street/id order
    assert [r.id for r in rows] == [22, 1001, 1002, 21, 20]
    rows = LK.search_premises(p.unionByName(extra), req, by_number=False).orderBy("rank").collect()
    # plain text order, NULL rooms last
    assert [r.id for r in rows] == [21, 1001, 20, 1002, 22]


def test_postcode_jobs_answers_every_list(spark):
    p, j = samples.premises(spark), samples.jobs(spark)
    req = spark.createDataFrame([("a", "AB1 2CD"), ("a", "AB1 2CD"), ("b", "AB1 2CD"), ("b", "AB9 9ZZ"), ("b", "X")], "request_id string, postcode string")
    long = spark.range(1000).selectExpr("'c' as request_id", "concat('X', id) as postcode")
    got = LK.postcode_jobs(p, j, req.union(long).union(req.where("request_id = 'a'").selectExpr("'c'", "postcode"))).collect()
    assert {r.request_id for r in got} == {"a", "b", "c"}  # however long the list
    assert sum(r.request_id == "a" for r in got) == 6  # distinct (postcode, date, bin) of both premises (4 + 2)
    assert sum(r.request_id == "c" for r in got) == 6
    assert LK.postcode_jobs(p, j, req.where("postcode = 'ab1 2cd'")).count() == 0  # exact, case-sensitive


def test_nested_array_functions(spark):
    p, j = samples.premises(spark), samples.jobs(spark)
    nested = LK.premises_with_jobs(p, j, spark.createDataFrame([(1001,), (8,), (5,)], "premises_id long"))
    assert sorted(r.id for r in nested.collect()) == [8, 1001]  # unknown id 5: no row
    st = {r.id: [x.status for x in r.jobs] for r in LK.jobs_with_status(nested, dt.date(2024, 7, 29)).collect()}
    assert st[1001] == ["Expired", "Today", "Upcoming", "Upcoming"] and st[8] == []
    nxt = {r.id: r.next_job for r in LK.first_upcoming(nested, dt.date(2024, 7, 30)).collect()}
    assert nxt[1001].date == dt.date(2024, 8, 5) and nxt[8] is None
    arr = spark.createDataFrame([("A", [("A", 1), ("B", 2)])], "postcode string, jobs array<struct<postcode:string,n:int>>")
    assert [x.n for x in LK.jobs_of_postcode(arr).first().jobs] == [1]


def test_random_premises(spark):
    p = samples.premises(spark)
    assert LK.random_premises(p, k=2, seed=1).count() == 2
    assert "TakeOrderedAndProject" in LK.random_premises(p, k=1, seed=1)._jdf.queryExecution().executedPlan().toString()


def test_search_form_trim(spark):
    p = samples.premises(spark)
    req = spark.createDataFrame([("a", "  ab1 2cd "), ("b", "   "), ("c", "AB1 2CD")], "request_id string, postcode string")
    # normalising drops every U+0020, so padding never matters; a blank request
    # normalises to '' and, through the API, finds the premises whose postcode
    # was empty (its search key is '', derived before ''→NULL)
    api = {(r.request_id, r.id) for r in LK.search_premises(p, req).collect()}
    assert {rid for rid, _ in api} == {"a", "b", "c"} and ("b", 8) in api
    # the web form trims and requires a non-empty postcode
    assert {r.request_id for r in LK.search_premises(p, req, trim=True).collect()} == {"a", "c"}


def test_sitemap_page_not_found(spark):
    from kerbside.plans import feeds

    p = samples.premises(spark)
    assert [r.id for r in feeds.sitemap_page(p, 0, page_size=3).orderBy("id").collect()] == [7, 8, 1001]
    assert [r.id for r in feeds.sitemap_page(p, 1, page_size=3).collect()] == [1002]
    assert feeds.sitemap_page(p, 2, page_size=3).isEmpty()


def test_nearby_jobs(spark):
    from kerbside.operators.geo import nearby_jobs

    p, j = samples.premises(spark), samples.jobs(spark)
    near = spark.createDataFrame(
        [("A", 0, "AB1 2CD", 0.0, 0.0, 0.0), ("A", 1, "AB9 9ZZ", 0.0, 0.0, 10.0), ("B", 0, "AB1 2CD", 0.0, 0.0, 0.0)],
        "origin string, rank int, postcode string, latitude double, longitude double, distance double",
    )
    rows = nearby_jobs(near, p, j).collect()
    assert sum(1 for r in rows if r.origin == "B") == 6  # 6 distinct (date, bin) at AB1 2CD
    assert [r.date for r in rows if r.postcode == "AB9 9ZZ"] == [None]  # no jobs: one NULL row


def test_saved_list_validation(spark):
    from kerbside.operators.recents import parse_saved_list

    ok = '{"id":1,"addressRoom":null,"addressNumber":"1","addressStreet":"A","addressLocality":null,"addressCity":"B","addressPostcode":"C"}'
    extra = ok[:-1] + ',"note":"x"}'
    missing = '{"id":2,"addressNumber":"1","addressStreet":"A","addressLocality":null,"addressCity":"B","addressPostcode":"C"}'
    text_id = ok.replace('"id":1', '"id":"1"')
    docs = spark.createDataFrame(
        [
            (1, '{"premises":[' + ok + "," + extra + "]}"),  # extra keys are dropped
            (2, '{"premises":[' + ok + "," + missing + "]}"),  # a missing key empties the list
            (3, '{"premises":[' + text_id + "]}"),  # a non-numeric id empties the list
            (4, "not json"),
            (5, '{"other":[]}'),
            (6, '{"premises":[' + ok.replace('"id":1', '"id":1.5') + "]}"),  # an id is a whole number
            (7, '{"premises":[' + ok.replace('"id":1', '"id":2.0') + "]}"),
        ],
        "user_id int, document string",
    )
    got = {}
    for r in parse_saved_list(docs).collect():
        got.setdefault(r.user_id, []).append((r.position, r.id, r.addressRoom))
    assert got == {1: [(0, 1, None), (1, 1, None)], 7: [(0, 2, None)]}


def test_date_facets_are_sets_of_days(spark):
    """Dates before 1970, on both sides of a word's end, and shared by several
    neighbours; an origin brings one row per neighbour to the join."""
    import datetime as dt

    from kerbside.operators.geo import date_facets, day_sets

    days = [dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 2, 29), dt.date(2024, 3, 1)]
    days += [dt.date(1970, 1, 1) + dt.timedelta(days=k) for k in (63, 64, 127, 128)]
    premises = spark.createDataFrame([(i, ["A", "B", None][i % 3]) for i in range(9)], "id long, address_postcode string")
    jobs = spark.createDataFrame([(i, "BLACK", d) for i in range(9) for k, d in enumerate(days) if (i + k) % 2], "premises_id long, bin string, date date")
    near = spark.createDataFrame([("o", 0, "A"), ("o", 1, "B"), ("p", 0, "B"), ("q", 0, "C")], "origin string, rank int, postcode string")
    assert {r.postcode for r in day_sets(premises, jobs, near).collect()} == {"A", "B"}
    got = [(r.origin, r.date) for r in date_facets(near, premises, jobs).collect()]
    want = {(o, d) for o, pc in (("o", "A"), ("o", "B"), ("p", "B")) for i in range(9) if ["A", "B", None][i % 3] == pc for k, d in enumerate(days) if (i + k) % 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_date_facets_exchange_no_dates(spark):
    """A neighbour's dates go to the origin as one row; they are taken apart
    after the exchange, none is exchanged by (origin, word)."""
    from kerbside.operators.geo import date_facets

    p, j = samples.premises(spark), samples.jobs(spark)
    near = spark.createDataFrame([("A", "AB1 2CD"), ("B", "AB1 2CD")], "origin string, postcode string")
    out = date_facets(near, p, j)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(origin" in x and "word" in x]
    assert [x for x in plan.splitlines() if "Exchange hashpartitioning(origin" in x]
    assert {r.origin for r in out.collect()} == {"A", "B"}
