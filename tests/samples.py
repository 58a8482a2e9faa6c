"""Small hand-made tables for golden tests (the documented sample rows)."""

from __future__ import annotations

import datetime as dt

from kerbside import schemas

LOAD = dt.datetime(2024, 7, 1, 3, 0, 0)


def premises(spark):
    rows = [
        (1001, None, "1", "ELM MEWS", "WESTFIELD", "NORTHTOWN", "AB1 2CD", "AB12CD", LOAD, LOAD),
        (1002, None, "2", "ELM MEWS", "WESTFIELD", "NORTHTOWN", "AB1 2CD", "AB12CD", LOAD, LOAD),
        (7, "FLAT 1", "12A", "ST. JOHN'S ROAD", "", None, "AB9 9ZZ", "AB99ZZ", LOAD, LOAD),
        (8, None, None, None, None, None, None, "", LOAD, LOAD),
    ]
    return spark.createDataFrame(rows, schemas.PREMISES)


def jobs(spark):
    d = dt.date
    rows = [
        (1, 1001, "BROWN", d(2024, 7, 26)),
        (2, 1001, "GREEN", d(2024, 7, 29)),
        (3, 1001, "BLACK", d(2024, 8, 5)),
        (4, 1001, "BROWN", d(2024, 8, 9)),
        (5, 1002, "FOOD", d(2024, 7, 26)),
        (6, 1002, "BLACK", d(2024, 7, 26)),
        (7, 99, "BLACK", d(2024, 7, 26)),  # orphan
    ]
    return spark.createDataFrame(rows, schemas.JOBS)
