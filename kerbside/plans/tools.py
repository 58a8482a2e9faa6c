"""The three remote lookup tools as set-oriented plans: each returns the text
content lines of every request, ``(request_id, seq, is_error, text)``.

Compositions of FIL1 (search), JOIN2 (jobs), DAT1 (status), STR1/3/9/10 and
FIL9 (miss messages).  Job lines are numbered with ``sequence_within``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.address import full_address, one_line_address
from kerbside.functions.dates import job_status
from kerbside.functions.text import DEFAULT_BASE_URL, job_line, premises_url
from kerbside.operators.lookup import miss_id_message, miss_postcode_message, search_premises
from kerbside.plans.ordering import sequence_within

_OUT = ["request_id", "seq", "is_error", "text"]


def _rows(df: DataFrame, seq, is_error: bool, text) -> DataFrame:
    return df.select(
        "request_id",
        (seq if not isinstance(seq, int) else F.lit(seq)).cast("long").alias("seq"),
        F.lit(is_error).alias("is_error"),
        text.alias("text"),
    )


def search_tool_lines(premises: DataFrame, requests: DataFrame) -> DataFrame:
    """``{id}: {one line address}`` per hit in result order, or the miss message."""
    hits = search_premises(premises, requests).select(
        "request_id",
        "rank",
        "id",
        *[F.col(c).alias(c) for c in ["addressRoom", "addressNumber", "addressStreet", "addressLocality", "addressCity", "addressPostcode"]],
    )
    renamed = hits.select(
        "request_id",
        "rank",
        "id",
        F.col("addressRoom").alias("address_room"),
        F.col("addressNumber").alias("address_number"),
        F.col("addressStreet").alias("address_street"),
        F.col("addressLocality").alias("address_locality"),
        F.col("addressCity").alias("address_city"),
        F.col("addressPostcode").alias("address_postcode"),
    )
    found = _rows(renamed, F.col("rank"), False, F.concat(F.col("id").cast("string"), F.lit(": "), one_line_address()))
    misses = requests.join(hits.select("request_id").distinct(), "request_id", "left_anti")
    missed = _rows(misses, 0, True, miss_postcode_message(F.col("postcode")))
    return found.unionByName(missed)


def _found(premises: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = premises.select("id", "address_room", "address_number", "address_street", "address_locality", "address_city", "address_postcode")
    hit = requests.join(p, F.col("premises_id") == F.col("id"))
    miss = requests.join(p.select(F.col("id").alias("_id")), F.col("premises_id") == F.col("_id"), "left_anti")
    return hit, miss


def jobs_tool_lines(premises: DataFrame, jobs: DataFrame, requests: DataFrame, as_of: dt.date) -> DataFrame:
    """``Full Address:\\n…`` then ``{date} ({status}): {bin} bin`` per job in
    (date, bin, id) order, or the miss message.  ``requests``: (request_id, premises_id)."""
    hit, miss = _found(premises, requests)
    head = _rows(hit, 0, False, F.concat(F.lit("Full Address:\n"), full_address()))
    wanted = hit.select("request_id", F.col("id").alias("_pid"))
    j = jobs.select("premises_id", "date", "bin", F.col("id").alias("job_id")).join(
        wanted, F.col("premises_id") == F.col("_pid")
    )
    numbered = sequence_within(j.drop("_pid"), ["request_id"], ["date", "bin", "job_id"], out="_k")
    body = _rows(numbered, F.col("_k") + 1, False, job_line("date", job_status("date", as_of), "bin"))
    missed = _rows(miss, 0, True, miss_id_message(F.col("premises_id")))
    return head.unionByName(body).unionByName(missed)


def permalink_tool_lines(premises: DataFrame, requests: DataFrame, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """``Permalink to the premises page:\\n{url}``, or the miss message."""
    hit, miss = _found(premises, requests)
    found = _rows(hit, 0, False, F.concat(F.lit("Permalink to the premises page:\n"), premises_url("premises_id", base_url)))
    return found.unionByName(_rows(miss, 0, True, miss_id_message(F.col("premises_id"))))
