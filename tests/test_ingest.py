"""Ingest on hand-written files (FIXTURES.md §A): cleaning, typing, failures."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from kerbside.sources import ingest as ING

LOAD = dt.datetime(2024, 1, 1, 3, 0, 0)


def write(tmp_dir: str, name: str, data: bytes) -> str:
    path = os.path.join(tmp_dir, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


PREMISES = (
    b"1,FLAT 1,12A,HIGH\x00 STREET,WESTFIELD,NORTHTOWN,AB1 2CD\n"
    b'2,,"3","CHURCH ROAD, EAST",,NORTHTOWN,ab1 2cd\r\n'
    b"\n"
    b'3,"","","SAY ""HI"" LANE",,NORTHTOWN,\n'
    b"4\x00,,5, SPACE ROAD,,NORTHTOWN,AB9 9ZZ\n"
    b'5,\x00"X",6,BACKSLASH \\ ROAD,,NORTHTOWN,AB9 9ZZ'  # no final newline
)


def test_premises_csv_clean(spark, tmp_dir):
    path = write(tmp_dir, "premises.csv", PREMISES)
    rows = {r["id"]: r.asDict() for r in ING.read_premises_csv(spark, path, LOAD).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[1]["address_street"] == "HIGH STREET"  # NUL stripped
    assert rows[1]["search_postcode"] == "AB12CD"
    assert rows[2]["address_street"] == "CHURCH ROAD, EAST"
    assert rows[2]["address_room"] is None and rows[2]["address_locality"] is None
    assert rows[2]["search_postcode"] == "AB12CD"  # upper, spaces removed; CR stripped
    assert rows[3]["address_room"] is None and rows[3]["address_number"] is None  # quoted-empty
    assert rows[3]["address_street"] == 'SAY "HI" LANE'
    assert rows[3]["address_postcode"] is None and rows[3]["search_postcode"] == ""  # ING7 before ING6
    assert rows[4]["address_street"] == " SPACE ROAD"  # no trimming
    assert rows[5]["address_room"] == "X" and rows[5]["address_street"] == "BACKSLASH \\ ROAD"
    assert rows[1]["created_at"] == LOAD and rows[1]["updated_at"] == LOAD


def test_sqlite_layout(spark, tmp_dir):
    path = write(tmp_dir, "premises.csv", PREMISES)
    df = ING.read_sqlite_premises(spark, path, LOAD)
    assert df.columns == ["id", "address_1", "address_2", "address_3", "locality", "city", "postcode"]
    assert df.count() == 5


JOBS = b"1,BLACK,1/2/24\n1,GREEN,01/02/69\r\n1,BROWN,31/12/70\n2,,29/02/72\n\n1,BLACK,1/2/24\n"


def test_jobs_csv(spark, tmp_dir):
    path = write(tmp_dir, "jobs.csv", JOBS)
    rows = sorted((r["premises_id"], r["bin"], r["date"]) for r in ING.read_jobs_csv(spark, path).collect())
    assert rows == [
        (1, "BLACK", dt.date(2024, 2, 1)),
        (1, "BLACK", dt.date(2024, 2, 1)),
        (1, "BROWN", dt.date(1970, 12, 31)),
        (1, "GREEN", dt.date(2069, 2, 1)),
        (2, "", dt.date(1972, 2, 29)),
    ]
    ids = [r["id"] for r in ING.read_jobs_csv(spark, path).collect()]
    assert len(set(ids)) == len(ids)


def test_jobs_line_dedupe(spark, tmp_dir):
    path = write(tmp_dir, "jobs.csv", JOBS)
    assert ING.read_jobs_csv(spark, path, dedupe=True).count() == 4


def test_empty_file(spark, tmp_dir):
    path = write(tmp_dir, "empty.csv", b"")
    assert ING.read_premises_csv(spark, path, LOAD).count() == 0


BAD_PREMISES = {
    "short": b"1,a,b,c,d,e\n",
    "long": b"1,a,b,c,d,e,f,g\n",
    "bad_int": b"x1,a,b,c,d,e,f\n",
    "space_int": b" 5,a,b,c,d,e,f\n",
    "overflow": b"3000000000,a,b,c,d,e,f\n",
    "empty_id": b",a,b,c,d,e,f\n",
    "unterminated": b'1,"abc,b,c,d,e,f\n',
}


@pytest.mark.parametrize("case", sorted(BAD_PREMISES))
def test_premises_failures(spark, tmp_dir, case):
    path = write(tmp_dir, f"{case}.csv", b"9,a,b,c,d,e,f\n" + BAD_PREMISES[case])
    with pytest.raises(Exception):
        ING.read_premises_csv(spark, path, LOAD).collect()


@pytest.mark.parametrize("line", [b"1,BLACK,31/02/24\n", b"1,BLACK,\n", b"1,BLACK,01/02/2024\n", b"1,BLACK,2024-02-01\n"])
def test_jobs_bad_dates(spark, tmp_dir, line):
    path = write(tmp_dir, "bad.csv", line)
    with pytest.raises(Exception):
        ING.read_jobs_csv(spark, path).collect()


def test_geocodes(spark, tmp_dir):
    good = write(tmp_dir, "a.json", b'{"result":[{"postcode":"AB1 2CD","longitude":-1.5,"latitude":53.8,"distance":0,"x":1}]}')
    write(tmp_dir, "b.json", b'{"status":404,"error":"Postcode not found"}')
    rows = ING.read_geocodes(spark, tmp_dir).collect()
    assert [(r.postcode, r.distance) for r in rows] == [("AB1 2CD", 0.0)]
    del good


def test_geocodes_bad_element_rejects_document(spark, tmp_dir):
    write(tmp_dir, "a.json", b'{"result":[{"postcode":"A","longitude":1,"latitude":2,"distance":0},{"postcode":"B","longitude":1}]}')
    write(tmp_dir, "b.json", b'{"result":[{"postcode":"C","longitude":1,"latitude":2,"distance":3}]}')
    assert [r.postcode for r in ING.read_geocodes(spark, tmp_dir, on_invalid="drop").collect()] == ["C"]
    with pytest.raises(Exception):
        ING.read_geocodes(spark, tmp_dir).collect()


def test_bad_lines_lists_every_rejected_line(spark, tmp_dir):
    data = b"9,a,b,c,d,e,f\n" + b"".join(BAD_PREMISES[k] for k in sorted(BAD_PREMISES))
    path = write(tmp_dir, "bad.csv", data)
    got = sorted((r.value, r.reason) for r in ING.bad_lines(spark, path, "premises").collect())
    assert got == sorted([
        (",a,b,c,d,e,f", "integer id"),
        ("1,a,b,c,d,e", "field count"),
        ("1,a,b,c,d,e,f,g", "field count"),
        ("x1,a,b,c,d,e,f", "integer id"),
        (" 5,a,b,c,d,e,f", "integer id"),
        ("3000000000,a,b,c,d,e,f", "integer id"),
        ('1,"abc,b,c,d,e,f', "unterminated quote"),
    ])
    jobs = write(tmp_dir, "jobs.csv", JOBS + b"1,BLACK,31/02/24\n1,BLACK,\n")
    assert sorted(r.value for r in ING.bad_lines(spark, jobs, "jobs").collect()) == ["1,BLACK,", "1,BLACK,31/02/24"]


def test_quotes_of_any_length_and_place(spark, tmp_dir):
    """A long quoted field, bare quotes, doubled quotes; faults still raise."""
    from kerbside.sources.ingest import csv_from_lines

    rows = ["1,\"" + "x" * 300_000 + "\",a", '2,6" PIPE,2" YARD', '3,"a ""b"", c",""', '4,"""q""",d"e']
    raw = spark.createDataFrame([(r,) for r in rows], "value string")
    got = {r.a: (r.b, r.c) for r in csv_from_lines(raw, ["a", "b", "c"]).collect()}
    assert got["1"] == ("x" * 300_000, "a")
    assert got["2"] == ('6" PIPE', '2" YARD')
    assert got["3"] == ('a "b", c', "") and got["4"] == ('"q"', 'd"e')
    for bad in ['5,"open,x', "6,only two", '7,a,b,"c,d"']:
        with pytest.raises(Exception):
            csv_from_lines(spark.createDataFrame([(bad,)], "value string"), ["a", "b", "c"]).collect()


@pytest.mark.parametrize(
    "body", [b'{"result":[{"postcode":"A","longitude":1,"latit', b'{"status":500,"error":"no"}', b'{"result":[{"postcode":"A","longitude":"x","latitude":2}]}']
)
def test_geocodes_corrupt_or_failed_documents(spark, tmp_dir, body):
    write(tmp_dir, "a.json", body)
    write(tmp_dir, "b.json", b'{"result":[{"postcode":"C","longitude":1,"latitude":2}]}')
    assert [(r.postcode, r.distance) for r in ING.read_geocodes(spark, tmp_dir, on_invalid="drop").collect()] == [("C", None)]
    assert ING.read_geocodes(spark, tmp_dir, on_invalid="drop", require_distance=True).count() == 0
    with pytest.raises(Exception):
        ING.read_geocodes(spark, tmp_dir).collect()
