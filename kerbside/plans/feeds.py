"""Feeds and exports (SNK7-11, EXP1, AGG2).

A per-premises document (CSV, JSON, iCalendar) is produced as *ordered line
rows* ``(premises_id, part, seq, sub, line)``: part 0 is the header, part 1
the job lines (``seq`` = position of the job in (date, bin, id) order, ``sub``
= line inside one job's block), part 2 the footer.  Concatenating a premises'
lines in key order with the format's separator gives the document exactly.

Line rows never hold a premises' jobs in one row or one task: job positions
come from ``sequence_within`` (range-partitioned), and ``write_documents``
range-partitions on the full key, so a premises with millions of jobs is
written by many tasks as contiguous runs.  ``assemble_documents`` joins lines
into one string per premises; use it for request-sized sets only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.address import capital_case, full_address, summary_address
from kerbside.functions.dates import ts_lit
from kerbside.functions.text import DEFAULT_BASE_URL, event_url, ical_escape, ical_fold
from kerbside.plans.ordering import global_sequence, sequence_within
from kerbside.schemas import RESULT_NAMES

# Fixed values of the feeds.
CSV_HEADER = "Date,Bin"
CSV_SEPARATOR = "\n"
ICAL_SEPARATOR = "\r\n"
ICAL_TIMEZONE = "Europe/London"
DEFAULT_PRODID = "-//kerbside//collection feed//EN"
SITEMAP_PAGE_SIZE = 50_000
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
LINE_KEY = ["premises_id", "part", "seq", "sub"]


def _existing_jobs(premises: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of premises that exist (orphans answer 404 in the API)."""
    return jobs.join(premises.select(F.col("id").alias("_pid")), F.col("premises_id") == F.col("_pid"), "left_semi")


def numbered_jobs(premises: DataFrame, jobs: DataFrame) -> DataFrame:
    """SRT3: each job's 0-based position within its premises in (date, bin, id)
    order, computed without a per-premises task."""
    j = _existing_jobs(premises, jobs).select("premises_id", "date", "bin", F.col("id").alias("job_id"))
    return sequence_within(j, ["premises_id"], ["date", "bin", "job_id"], out="seq")


def _line(pid: Column, part: int, seq: Column | int, sub: Column | int, line: Column) -> list[Column]:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [
        pid.alias("premises_id"),
        F.lit(part).alias("part"),
        as_col(seq).cast("long").alias("seq"),
        as_col(sub).cast("int").alias("sub"),
        line.alias("line"),
    ]


# --------------------------------------------------------------------------- SNK7
def csv_lines(premises: DataFrame, jobs: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """``Date,Bin`` header then ``date,bin`` per job, joined by LF, no quoting,
    no trailing newline; a premises without jobs is the header alone."""
    numbered = numbered if numbered is not None else numbered_jobs(premises, jobs)
    header = premises.select(*_line(F.col("id"), 0, 0, 0, F.lit(CSV_HEADER)))
    body = numbered.select(
        *_line(F.col("premises_id"), 1, F.col("seq"), 0, F.concat(F.col("date").cast("string"), F.lit(","), F.col("bin")))
    )
    return header.unionByName(body)


# --------------------------------------------------------------------------- SNK8
def premises_json_head(prefix: str = "") -> Column:
    """The premises object without its closing brace, followed by ``"jobs":[``."""
    fields = [F.col(prefix + src).alias(dst) for src, dst in RESULT_NAMES.items() if src != "updated_at"]
    fields.append(F.date_format(F.col(prefix + "updated_at"), ISO_MILLIS).alias("updatedAt"))
    obj = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(obj, r"\}$", ""), F.lit(',"jobs":['))


def json_lines(premises: DataFrame, jobs: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """The JSON document of a premises (its fields, NULLs kept, plus ``jobs``),
    split into lines that concatenate without a separator."""
    numbered = numbered if numbered is not None else numbered_jobs(premises, jobs)
    header = premises.select(*_line(F.col("id"), 0, 0, 0, premises_json_head()))
    element = F.to_json(F.struct(F.col("date"), F.col("bin")))
    body = numbered.select(
        *_line(
            F.col("premises_id"),
            1,
            F.col("seq"),
            0,
            F.concat(F.when(F.col("seq") > 0, F.lit(",")).otherwise(F.lit("")), element),
        )
    )
    footer = premises.select(*_line(F.col("id"), 2, 0, 0, F.lit("]}")))
    return header.unionByName(body).unionByName(footer)


# --------------------------------------------------------------------------- SNK9
def _ical_stamp(as_of: dt.datetime) -> Column:
    return F.date_format(ts_lit(as_of), "yyyyMMdd'T'HHmmss'Z'")


def ical_lines(
    premises: DataFrame,
    jobs: DataFrame,
    as_of: dt.datetime,
    base_url: str = DEFAULT_BASE_URL,
    prodid: str = DEFAULT_PRODID,
    numbered: DataFrame | None = None,
) -> DataFrame:
    """iCalendar feed lines: one all-day event per job.

    Calendar name ``Bin Days for {summary}``; uid ``{id}_{date}_{bin}``;
    summary ``{Capital Case bin} Bin Collection``; location = full address;
    url with date and bin.  Text values are escaped and folded per RFC 5545.
    """
    numbered = numbered if numbered is not None else numbered_jobs(premises, jobs)
    # lines are far more work than the premises' bytes suggest: one small file
    # would be one task, so they are dealt first
    premises = premises.repartition(int(premises.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    full = full_address()
    name = F.concat(F.lit("Bin Days for "), summary_address())
    desc = F.concat(
        F.lit("Bin collection dates for your household\n\n"),
        full,
        F.lit("\n\nID: "),
        F.col("id").cast("string"),
        F.lit(f"\n\nGenerated by {base_url}"),
    )
    head_values = [
        F.lit("BEGIN:VCALENDAR"),
        F.lit("VERSION:2.0"),
        F.lit(f"PRODID:{prodid}"),
        F.concat(F.lit("NAME:"), ical_escape(name)),
        F.concat(F.lit("X-WR-CALNAME:"), ical_escape(name)),
        F.concat(F.lit("DESCRIPTION:"), ical_escape(desc)),
        F.concat(F.lit("X-WR-CALDESC:"), ical_escape(desc)),
        F.lit(f"TIMEZONE-ID:{ICAL_TIMEZONE}"),
        F.lit(f"X-WR-TIMEZONE:{ICAL_TIMEZONE}"),
    ]
    header = premises.select(
        "id", F.posexplode(F.array(*[ical_fold(v) for v in head_values])).alias("sub", "line")
    ).select(*_line(F.col("id"), 0, 0, F.col("sub"), F.col("line")))

    # Event blocks need the premises' address: join the numbered jobs with the
    # premises (one row per premises id on that side; AQE splits a hot id).
    # Its line is the same in every event, so it is escaped and folded once.
    location = ical_fold(F.concat(F.lit("LOCATION:"), ical_escape(full)))
    p = premises.select(F.col("id").alias("_id"), location.alias("_location"))
    ev = numbered.join(p, F.col("premises_id") == F.col("_id"))
    ymd = F.date_format(F.col("date"), "yyyyMMdd")
    uid = F.concat(F.col("premises_id").cast("string"), F.lit("_"), F.col("date").cast("string"), F.lit("_"), F.col("bin"))
    own_values = {
        "_uid": F.concat(F.lit("UID:"), ical_escape(uid)),
        "_start": F.concat(F.lit("DTSTART;VALUE=DATE:"), ymd),
        "_end": F.concat(F.lit("DTEND;VALUE=DATE:"), ymd),
        "_summary": F.concat(F.lit("SUMMARY:"), ical_escape(F.concat(capital_case(F.col("bin")), F.lit(" Bin Collection")))),
        "_url": F.concat(F.lit("URL;VALUE=URI:"), event_url("premises_id", "date", "bin", base_url)),
    }
    # values of an event are columns before they are folded: folding looks at
    # a value several times
    valued = ev.select("premises_id", "seq", "_location", *[v.alias(n) for n, v in own_values.items()])
    event_lines = [
        F.lit("BEGIN:VEVENT"),
        ical_fold(F.col("_uid")),
        F.lit("SEQUENCE:0"),
        ical_fold(F.concat(F.lit("DTSTAMP:"), _ical_stamp(as_of))),
        ical_fold(F.col("_start")),
        ical_fold(F.col("_end")),
        F.lit("X-MICROSOFT-CDO-ALLDAYEVENT:TRUE"),
        F.lit("X-MICROSOFT-MSNCALENDAR-ALLDAYEVENT:TRUE"),
        ical_fold(F.col("_summary")),
        F.col("_location"),
        ical_fold(F.col("_url")),
        F.lit("END:VEVENT"),
    ]
    body = valued.select("premises_id", "seq", F.posexplode(F.array(*event_lines)).alias("sub", "line")).select(
        *_line(F.col("premises_id"), 1, F.col("seq"), F.col("sub"), F.col("line"))
    )
    footer = premises.select(*_line(F.col("id"), 2, 0, 0, F.lit("END:VCALENDAR")))
    return header.unionByName(body).unionByName(footer)


# --------------------------------------------------------------------------- document helpers
def assemble_documents(lines: DataFrame, separator: str) -> DataFrame:
    """Join each premises' lines into one string, in key order.

    Holds a whole document in one row: for request-sized sets (an API answer),
    not for bulk export (use ``write_documents``).
    """
    return lines.groupBy("premises_id").agg(
        F.concat_ws(
            separator,
            F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "sub", "line"))), lambda x: x["line"]),
        ).alias("document")
    )


def write_documents(lines: DataFrame, path: str, num_partitions: int | None = None) -> None:
    """Bulk export: Parquet files of line rows, range-partitioned and sorted on
    the line key, so every document is a contiguous run (one or more files)
    and a reader prunes files by premises_id min/max."""
    n = num_partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions") or "200")
    keys = [F.col(k).asc() for k in LINE_KEY]
    lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


# --------------------------------------------------------------------------- EXP1 / SNK10 / AGG2 / SNK11
def sitemap_rows(premises: DataFrame, base_url: str = DEFAULT_BASE_URL, page_size: int = SITEMAP_PAGE_SIZE) -> DataFrame:
    """SNK10 + EXP1: every premises url with its lastmod and sitemap page
    (``page_size`` per page in id order), without a single-partition sort."""
    seq = global_sequence(premises.select("id", "updated_at"), [F.col("id").asc()], out="seq")
    return seq.select(
        (F.col("seq") / F.lit(page_size)).cast("long").alias("page"),
        F.col("seq"),
        F.col("id"),
        F.concat(F.lit(f"{base_url}/premises/"), F.col("id").cast("string")).alias("url"),
        F.date_format("updated_at", ISO_MILLIS).alias("lastmod"),
    )


def sitemap_page(premises: DataFrame, page: int, base_url: str = DEFAULT_BASE_URL, page_size: int = SITEMAP_PAGE_SIZE) -> DataFrame:
    """EXP1: one page (ORDER BY id LIMIT size OFFSET page*size); empty = not found."""
    rows = sitemap_rows(premises, base_url, page_size)
    return rows.where(F.col("page") == page)


def sitemap_page_count(premises: DataFrame, page_size: int = SITEMAP_PAGE_SIZE) -> DataFrame:
    """AGG2: row count and ``ceil(n / page_size)`` pages, as a one-row DataFrame."""
    return premises.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.ceil(F.col("n") / F.lit(page_size)).cast("long").alias("pages")
    )


def sitemap_index_entries(
    premises: DataFrame,
    build_time: dt.datetime,
    base_url: str = DEFAULT_BASE_URL,
    page_size: int = SITEMAP_PAGE_SIZE,
) -> DataFrame:
    """SNK11 entries: two static sitemaps with lastmod, then one per page
    without; ``pos`` orders them and ``xml`` is the entry's text."""
    spark = premises.sparkSession
    lastmod = F.date_format(ts_lit(build_time), ISO_MILLIS)
    static = spark.range(2).select(
        F.col("id").cast("long").alias("pos"),
        F.when(F.col("id") == 0, F.lit(f"{base_url}/sitemap.xml")).otherwise(F.lit(f"{base_url}/docs/sitemap.xml")).alias("loc"),
        lastmod.alias("lastmod"),
    )
    pages = sitemap_page_count(premises, page_size).select(
        F.explode(F.when(F.col("pages") > 0, F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("page")
    )
    paged = pages.select(
        (F.col("page") + 2).alias("pos"),
        F.concat(F.lit(f"{base_url}/premises/sitemap/"), F.col("page").cast("string"), F.lit(".xml")).alias("loc"),
        F.lit(None).cast("string").alias("lastmod"),
    )
    entries = static.unionByName(paged)
    lm = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise(F.lit(""))
    xml = F.concat(F.lit("\n  <sitemap>\n    <loc>"), F.col("loc"), F.lit("</loc>\n    "), lm, F.lit("\n  </sitemap>\n    "))
    return entries.select("pos", "loc", "lastmod", xml.alias("xml"))


SITEMAP_INDEX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n  <sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n  '
SITEMAP_INDEX_TAIL = "\n</sitemapindex>\n  "


def sitemap_index_lines(entries: DataFrame) -> DataFrame:
    """The sitemap index as ordered rows (part, pos, text): its head, one row
    an entry, its tail.  The document is the head, the entries joined by line
    feeds, and the tail."""
    spark = entries.sparkSession
    ends = spark.createDataFrame([(0, 0, SITEMAP_INDEX_HEAD), (2, 0, SITEMAP_INDEX_TAIL)], "part int, pos long, text string")
    return ends.unionByName(entries.select(F.lit(1).alias("part"), "pos", F.col("xml").alias("text")))


# --------------------------------------------------------------------------- EXP1, one page
def page_index(premises: DataFrame, page_size: int = SITEMAP_PAGE_SIZE) -> DataFrame:
    """(page, first_id): where every page begins, to be stored beside the
    table.  One row for each ``page_size`` premises; ids are unique."""
    seq = global_sequence(premises.select("id"), [F.col("id").asc()], out="seq")
    return seq.where(F.col("seq") % page_size == 0).select((F.col("seq") / page_size).cast("long").alias("page"), F.col("id").alias("first_id"))


def page_of(premises: DataFrame, index: DataFrame, page: int) -> DataFrame:
    """EXP1: one page (ORDER BY id LIMIT size OFFSET page * size) as a range of
    ids that reaches the scan, from the stored index; empty = not found."""
    ends = {r["page"]: r["first_id"] for r in index.where(F.col("page").isin(page, page + 1)).collect()}  # two rows
    if page not in ends:
        return premises.where(F.lit(False))
    inside = F.col("id") >= ends[page]
    return premises.where(inside & (F.col("id") < ends[page + 1]) if page + 1 in ends else inside)


def indexed_sitemap_page(premises: DataFrame, index: DataFrame, page: int, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """SNK10 for one page: (id, url, lastmod) of its premises."""
    return page_of(premises, index, page).select(
        "id",
        F.concat(F.lit(f"{base_url}/premises/"), F.col("id").cast("string")).alias("url"),
        F.date_format("updated_at", ISO_MILLIS).alias("lastmod"),
    )
