"""Golden rows for the text functions and the feed documents."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from kerbside.functions import address as A
from kerbside.functions import text as TX
from kerbside.operators.lookup import premises_with_jobs
from kerbside.plans import feeds
from tests import samples


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_capital_case(spark):
    df = spark.createDataFrame([("12A",), ("ST. JOHN'S",), ("FLAT 1",), ("ABCDef",), ("mcDonald",), ("",), (None,), ("  --a--b  ",)], "s string")
    got = [r[0] for r in df.select(A.capital_case("s")).collect()]
    assert got == ["12 A", "St John S", "Flat 1", "Abc Def", "Mc Donald", "", None, "A B"]


def test_leading_int(spark):
    df = spark.createDataFrame([("12A",), (" 7",), ("-3x",), ("+4",), ("THE MEWS",), ("",), (None,)], "s string")
    assert [int(r[0]) for r in df.select(A.leading_int("s")).collect()] == [12, 7, -3, 4, 0, 0, 0]


def test_address_formats(spark):
    p = samples.premises(spark)
    out = {r["id"]: r for r in p.select(
        "id",
        A.full_address().alias("full"),
        A.one_line_address().alias("one"),
        A.summary_address().alias("summary"),
        A.presentable_address().alias("pres"),
        A.two_line_address().alias("two"),
        TX.page_title().alias("title"),
    ).collect()}
    assert out[1001]["full"] == "1\nELM MEWS\nWESTFIELD\nNORTHTOWN\nAB1 2CD"
    assert out[1001]["one"] == "1, ELM MEWS, WESTFIELD, NORTHTOWN, AB1 2CD"
    assert out[1001]["two"] == "1 Elm Mews \n Westfield Northtown AB1 2CD"
    assert out[7]["one"] == "FLAT 1, 12A, ST. JOHN'S ROAD, AB9 9ZZ"  # '' and NULL both dropped
    assert out[7]["pres"] == "Flat 1\n12 A\nSt John S Road\nAB9 9ZZ"
    assert out[7]["summary"] == "FLAT 1 12A ST. JOHN'S ROAD"
    assert out[8]["full"] == "" and out[8]["title"] == "Bin Days for  at null"
    assert out[1001]["title"] == "Bin Days for 1 Elm Mews at AB1 2CD"


def test_csv_document(spark):
    p, j = samples.premises(spark), samples.jobs(spark)
    docs = {r[0]: r[1] for r in feeds.assemble_documents(feeds.csv_lines(p, j), "\n").collect()}
    assert docs[1001] == "Date,Bin\n2024-07-26,BROWN\n2024-07-29,GREEN\n2024-08-05,BLACK\n2024-08-09,BROWN"
    assert docs[1002] == "Date,Bin\n2024-07-26,BLACK\n2024-07-26,FOOD"
    assert docs[8] == "Date,Bin"
    assert 99 not in docs


def test_json_document(spark):
    p, j = samples.premises(spark), samples.jobs(spark)
    docs = {r[0]: r[1] for r in feeds.assemble_documents(feeds.json_lines(p, j), "").collect()}
    doc = json.loads(docs[1001])
    assert doc["addressRoom"] is None and doc["updatedAt"] == "2024-07-01T03:00:00.000Z"
    assert [x["bin"] for x in doc["jobs"]] == ["BROWN", "GREEN", "BLACK", "BROWN"]
    assert json.loads(docs[8])["jobs"] == []
    nested = {r["id"]: r["jobs"] for r in premises_with_jobs(p, j).collect()}
    assert [x["bin"] for x in nested[1001]] == ["BROWN", "GREEN", "BLACK", "BROWN"]
    assert nested[8] == []


def test_ical_document(spark):
    p, j = samples.premises(spark), samples.jobs(spark)
    lines = feeds.ical_lines(p, j, dt.datetime(2024, 7, 1), "https://example.org")
    docs = {r[0]: r[1] for r in feeds.assemble_documents(lines, "\r\n").collect()}
    ics = docs[1001]
    assert ics.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n") and ics.endswith("END:VEVENT\r\nEND:VCALENDAR")
    assert "UID:1001_2024-07-26_BROWN" in ics
    assert "SUMMARY:Brown Bin Collection" in ics
    assert "DTSTART;VALUE=DATE:20240726" in ics
    assert "URL;VALUE=URI:https://example.org/premises/1001?date=2024-07-26&bin=BROWN" in ics
    assert "LOCATION:1\\nELM MEWS\\nWESTFIELD\\nNORTHTOWN\\nAB1 2CD" in ics
    for line in ics.split("\r\n"):
        assert len(line) <= 75
    unfolded = ics.replace("\r\n ", "")
    assert "DESCRIPTION:Bin collection dates for your household\\n\\n1\\nELM MEWS" in unfolded
    assert ics.count("BEGIN:VEVENT") == 4
    assert docs[8].count("BEGIN:VEVENT") == 0


def test_sitemap_index_document(spark):
    p = samples.premises(spark)
    entries = feeds.sitemap_index_entries(p, dt.datetime(2024, 1, 1), "https://example.org", page_size=3)
    rows = feeds.sitemap_index_lines(entries).orderBy("part", "pos").collect()
    xml = rows[0].text + "\n".join(r.text for r in rows[1:-1]) + rows[-1].text
    assert [r.part for r in rows] == [0, 1, 1, 1, 1, 2] and xml.startswith("<?xml") and xml.endswith("</sitemapindex>\n  ")
    assert xml.count("<sitemap>") == 4  # 2 static + ceil(4/3)
    assert "<loc>https://example.org/premises/sitemap/1.xml</loc>" in xml
    assert xml.count("<lastmod>2024-01-01T00:00:00.000Z</lastmod>") == 2


def test_bin_styles(spark):
    df = spark.createDataFrame([("BLACK",), ("FOOD",)], "bin string")
    got = df.select(A.bin_order("bin"), A.bin_list_class("bin"), A.bin_dot_class("bin")).collect()
    assert [tuple(r) for r in got] == [(0, "bg-gray-900 text-gray-50", "bg-gray-900/90"), (-1, "", "")]


def test_write_documents_keeps_documents_contiguous(spark, tmp_dir):
    from kerbside import fixtures as fx
    from tests.conftest import SF001

    t = fx.load(spark, SF001)
    lines = feeds.csv_lines(t.premises, t.jobs)
    out = f"{tmp_dir}/docs"
    feeds.write_documents(lines, out, num_partitions=6)
    files = sorted(f for f in __import__("os").listdir(out) if f.endswith(".parquet"))
    import pyarrow.parquet as pq

    ranges = []
    for f in files:
        tbl = pq.read_table(f"{out}/{f}").to_pandas()
        if len(tbl):
            keys = list(zip(tbl.premises_id, tbl.part, tbl.seq, tbl["sub"]))
            assert keys == sorted(keys)  # sorted inside the file
            ranges.append((keys[0], keys[-1]))
    ranges.sort()
    for (a0, a1), (b0, b1) in zip(ranges, ranges[1:]):
        assert a1 < b0  # files hold disjoint, ordered key ranges
    assert sum(len(pq.read_table(f"{out}/{f}")) for f in files) == lines.count()


def test_calendar_bounds_and_formats(spark):
    from kerbside.functions import dates as D

    df = spark.createDataFrame([(dt.date(2026, 12, 1),), (dt.date(1995, 1, 2),)], "d date")
    got = df.select(
        D.calendar_start(df["d"]), D.calendar_last_day(df["d"]),
        D.long_date("d"), D.short_date("d"), D.job_status("d", dt.date(2026, 12, 1)),
    ).collect()
    assert tuple(got[0]) == (dt.date(2026, 11, 23), dt.date(2027, 1, 3), "01 December 2026", "Tue, Dec 1", "Today")
    assert tuple(got[1])[2:] == ("02 January 1995", "Mon, Jan 2", "Expired")


def test_ical_fold_counts_octets(spark):
    from kerbside.functions.text import ical_fold

    texts = ["A" * 80, "É" * 50, "x" + "😀" * 30, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for src, out in zip(texts, [r[0] for r in df.select(ical_fold(F.col("s"))).collect()]):
        lines = out.split("\r\n")
        assert all(len(line.encode("utf-8")) <= 75 for line in lines)
        assert all(line.startswith(" ") for line in lines[1:])
        assert "".join([lines[0]] + [line[1:] for line in lines[1:]]) == src
    assert df.select(ical_fold(F.col("s"))).collect()[0][0] == "A" * 75 + "\r\n " + "A" * 5
