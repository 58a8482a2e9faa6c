"""Registered queries: one Spark plan and one DuckDB oracle text per operator.

Every query reads the driver's test tables (through ``fixtures``) over whole
tables; request sets are derived from the same tables.  Column names are
identical on both sides.
"""

from __future__ import annotations

import datetime as _dt
import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside import fixtures as fx
from kerbside.functions import address as A
from kerbside.functions import dates as D
from kerbside.functions import text as TX
from kerbside.operators import calendar as CAL
from kerbside.operators import changes as CHG
from kerbside.operators import geo as GEO
from kerbside.operators import lookup as LK
from kerbside.operators import merge as MG
from kerbside.plans import feeds
from kerbside.plans import tools as TOOLS
from kerbside.plans.refresh import Dataset, refresh
from kerbside.plans.stage import materialize
from kerbside.schemas import SQLITE_PREMISES_COLUMNS
from kerbside.sources import colocated as COL
from kerbside.sources import ingest as ING
from kerbside.sources.tables import TableStore

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


# Reused oracle fragments ----------------------------------------------------
EXISTING_JOBS_SQL = "existing_jobs AS (SELECT * FROM jobs WHERE premises_id IN (SELECT id FROM premises))"
NUMBERED_JOBS_SQL = (
    "numbered AS (SELECT premises_id, date, bin, id AS job_id, "
    "row_number() OVER (PARTITION BY premises_id ORDER BY date, bin, id) - 1 AS seq FROM existing_jobs)"
)
ISO_MILLIS_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')"


# --------------------------------------------------------------------------- SNK7
@register(
    "snk7_csv_feed_lines",
    fx.oracle(
        """
SELECT id AS premises_id, 0 AS part, CAST(0 AS BIGINT) AS seq, 0 AS sub, 'Date,Bin' AS line FROM premises
UNION ALL
SELECT premises_id, 1, seq, 0, CAST(date AS VARCHAR) || ',' || bin FROM numbered
""",
        EXISTING_JOBS_SQL + ",\n" + NUMBERED_JOBS_SQL,
    ),
)
def q_csv_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.load(spark, sf_dir)
    return feeds.csv_lines(t.premises, t.jobs)


# --------------------------------------------------------------------------- JOIN2 + SNK8
_JSON_HEAD_SQL = (
    "regexp_replace(to_json(struct_pack(id := id, addressRoom := address_room, addressNumber := address_number, "
    "addressStreet := address_street, addressLocality := address_locality, addressCity := address_city, "
    "addressPostcode := address_postcode, updatedAt := " + ISO_MILLIS_SQL.format(c="updated_at") + ")), '}$', '') "
    "|| ',\"jobs\":['"
)


@register(
    "snk8_json_feed_lines",
    fx.oracle(
        f"""
SELECT id AS premises_id, 0 AS part, CAST(0 AS BIGINT) AS seq, 0 AS sub, {_JSON_HEAD_SQL} AS line FROM premises
UNION ALL
SELECT premises_id, 1, seq, 0,
       CASE WHEN seq > 0 THEN ',' ELSE '' END || to_json(struct_pack(date := date, bin := bin)) FROM numbered
UNION ALL
SELECT id, 2, CAST(0 AS BIGINT), 0, ']}}' FROM premises
""",
        EXISTING_JOBS_SQL + ",\n" + NUMBERED_JOBS_SQL,
    ),
)
def q_json_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.load(spark, sf_dir)
    return feeds.json_lines(t.premises, t.jobs)


# =========================================================================== shared


AS_OF = fx.AS_OF

AS_OF_TS = _dt.datetime(2000, 6, 1, 0, 0, 0)
BUILD_TIME = _dt.datetime(2000, 5, 1, 12, 0, 0)
BASE = TX.DEFAULT_BASE_URL


def cc_sql(x: str) -> str:
    """capital_case as DuckDB SQL."""
    s = (
        f"regexp_replace(regexp_replace(regexp_replace({x}, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1 \\2', 'g'), "
        f"'(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '[^\\p{{L}}0-9]+', ' ', 'g')"
    )
    return f"array_to_string(list_transform(string_split(trim({s}), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def nz(x: str) -> str:
    return f"nullif({x}, '')"


PARTS = A.PARTS
FULL_SQL = "concat_ws(chr(10), " + ", ".join(nz(p) for p in PARTS) + ")"
ONE_LINE_SQL = "concat_ws(', ', " + ", ".join(nz(p) for p in PARTS) + ")"
SUMMARY_SQL = "concat_ws(' ', " + ", ".join(nz(p) for p in PARTS[:3]) + ")"
PRESENTABLE_SQL = "concat_ws(chr(10), " + ", ".join([nz(cc_sql(p)) for p in PARTS[:5]] + [nz("upper(address_postcode)")]) + ")"
TWO_LINE_SQL = (
    "concat_ws(' ', "
    + ", ".join([nz(cc_sql(p)) for p in PARTS[:3]] + ["chr(10)"] + [nz(cc_sql(p)) for p in PARTS[3:5]] + [nz("upper(address_postcode)")])
    + ")"
)
LEADING_INT_SQL = "coalesce(TRY_CAST(nullif(regexp_extract(address_number, '^\\s*([+-]?[0-9]+)', 1), '') AS DECIMAL(38,0)), 0)"
RESULT_SQL = (
    "id, address_room AS addressRoom, address_number AS addressNumber, address_street AS addressStreet, "
    "address_locality AS addressLocality, address_city AS addressCity, address_postcode AS addressPostcode, "
    "updated_at AS updatedAt"
)


def ical_escape_sql(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), "
        f"chr(13) || chr(10), '\\n'), chr(10), '\\n')"
    )


def ical_fold_sql(x: str) -> str:
    """Folding in SQL by characters: equal to the octet rule on the ASCII fixtures
    (non-ASCII folding is covered by a unit test)."""
    crlf_sp = "chr(13) || chr(10) || ' '"
    return (
        f"CASE WHEN length({x}) <= 75 THEN {x} ELSE substr({x}, 1, 75) || {crlf_sp} || "
        f"regexp_replace(regexp_replace(substr({x}, 76), '(.{{74}})', '\\1' || {crlf_sp}, 'g'), {crlf_sp} || '$', '') END"
    )


# =========================================================================== FIL1 / SRT1 / SRT2
SEARCH_REQUESTS_SQL = """
pcs AS (SELECT DISTINCT address_postcode FROM premises WHERE address_postcode IS NOT NULL),
requests AS (
  SELECT address_postcode AS request_id, address_postcode AS postcode FROM pcs
  UNION ALL
  SELECT 'lc:' || address_postcode, lower(replace(address_postcode, ' ', '')) FROM pcs
  UNION ALL
  SELECT 'miss:' || address_postcode, replace(address_postcode, 'aB', 'zz') FROM pcs)
"""


def search_requests(t: fx.Tables):
    pcs = t.premises.where(F.col("address_postcode").isNotNull()).select("address_postcode").distinct()
    a = pcs.select(F.col("address_postcode").alias("request_id"), F.col("address_postcode").alias("postcode"))
    b = pcs.select(F.concat(F.lit("lc:"), "address_postcode").alias("request_id"), F.lower(F.replace("address_postcode", F.lit(" "), F.lit(""))).alias("postcode"))
    c = pcs.select(F.concat(F.lit("miss:"), "address_postcode").alias("request_id"), F.replace("address_postcode", F.lit("aB"), F.lit("zz")).alias("postcode"))
    return a.unionByName(b).unionByName(c)


def _search_oracle(by_number: bool) -> str:
    return fx.oracle(
        f"""
SELECT request_id, postcode, rank, {RESULT_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
      {LEADING_INT_SQL if by_number else '1 + 0'},
      address_room ASC NULLS LAST, address_number ASC NULLS LAST, address_street ASC NULLS LAST, id) - 1 AS rank
  FROM (SELECT r.request_id, r.postcode, p.*, count(*) OVER (PARTITION BY r.request_id) AS n
        FROM requests r JOIN premises p ON upper(replace(r.postcode, ' ', '')) = p.search_postcode) h) x
""",
        SEARCH_REQUESTS_SQL,
    )


@register("fil1_srt2_search_premises", _search_oracle(True))
def q_search_premises(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return LK.search_premises(t.premises, search_requests(t))


@register("srt1_search_premises_text_order", _search_oracle(False))
def q_search_premises_text_order(spark, sf_dir):
    """The same search in plain text order."""
    t = fx.load(spark, sf_dir)
    return LK.search_premises(t.premises, search_requests(t), by_number=False)


@register(
    "fil9_search_tool_text",
    fx.oracle(
        f"""
SELECT request_id, CAST(rank AS BIGINT) AS seq, false AS is_error, CAST(id AS VARCHAR) || ': ' || {ONE_LINE_SQL} AS text
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
      {LEADING_INT_SQL},
      address_room ASC NULLS LAST, address_number ASC NULLS LAST, address_street ASC NULLS LAST, id) - 1 AS rank
  FROM (SELECT r.request_id, r.postcode, p.*, count(*) OVER (PARTITION BY r.request_id) AS n
        FROM requests r JOIN premises p ON upper(replace(r.postcode, ' ', '')) = p.search_postcode) h) x
UNION ALL
SELECT request_id, CAST(0 AS BIGINT), true, 'No address matching with postcode ' || postcode || ' found'
FROM requests r WHERE NOT EXISTS (SELECT 1 FROM premises p WHERE p.search_postcode = upper(replace(r.postcode, ' ', '')))
""",
        SEARCH_REQUESTS_SQL,
    ),
)
def q_search_tool(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return TOOLS.search_tool_lines(t.premises, search_requests(t))


# =========================================================================== FIL2 / FIL9 / tools by id
ID_REQUESTS_SQL = "requests AS (SELECT DISTINCT premises_id AS request_id, premises_id FROM jobs)"


def id_requests(t: fx.Tables):
    return t.jobs.select(F.col("premises_id").alias("request_id"), "premises_id").distinct()


@register(
    "fil2_premises_by_id",
    fx.oracle(
        f"""
SELECT r.request_id, r.premises_id, p.id IS NOT NULL AS found,
  p.id, p.address_room AS addressRoom, p.address_number AS addressNumber, p.address_street AS addressStreet,
  p.address_locality AS addressLocality, p.address_city AS addressCity, p.address_postcode AS addressPostcode,
  p.updated_at AS updatedAt,
  CASE WHEN p.id IS NULL THEN 'Address not found (bad premisesId of ' || CAST(r.premises_id AS VARCHAR) || ')' END AS message
FROM requests r LEFT JOIN premises p ON r.premises_id = p.id
""",
        ID_REQUESTS_SQL,
    ),
)
def q_premises_by_id(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    res = LK.premises_by_id(t.premises, id_requests(t))
    return res.withColumn("message", F.when(~F.col("found"), LK.miss_id_message(F.col("premises_id"))))


@register(
    "tool_jobs_text",
    fx.oracle(
        f"""
SELECT r.request_id, CAST(0 AS BIGINT) AS seq, false AS is_error, 'Full Address:' || chr(10) || {FULL_SQL} AS text
FROM requests r JOIN premises p ON r.premises_id = p.id
UNION ALL
SELECT r.request_id, row_number() OVER (PARTITION BY r.request_id ORDER BY j.date, j.bin, j.id), false,
  CAST(j.date AS VARCHAR) || ' (' || CASE WHEN j.date < {fx.AS_OF_SQL} THEN 'Expired' WHEN j.date > {fx.AS_OF_SQL} THEN 'Upcoming' ELSE 'Today' END
  || '): ' || j.bin || ' bin'
FROM requests r JOIN premises p ON r.premises_id = p.id JOIN jobs j ON j.premises_id = p.id
UNION ALL
SELECT r.request_id, CAST(0 AS BIGINT), true, 'Address not found (bad premisesId of ' || CAST(r.premises_id AS VARCHAR) || ')'
FROM requests r WHERE r.premises_id NOT IN (SELECT id FROM premises)
""",
        ID_REQUESTS_SQL,
    ),
)
def q_jobs_tool(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return TOOLS.jobs_tool_lines(t.premises, t.jobs, id_requests(t), AS_OF)


@register(
    "tool_permalink_text",
    fx.oracle(
        f"""
SELECT r.request_id, CAST(0 AS BIGINT) AS seq, false AS is_error,
  'Permalink to the premises page:' || chr(10) || '{BASE}/premises/' || CAST(r.premises_id AS VARCHAR) AS text
FROM requests r JOIN premises p ON r.premises_id = p.id
UNION ALL
SELECT r.request_id, CAST(0 AS BIGINT), true, 'Address not found (bad premisesId of ' || CAST(r.premises_id AS VARCHAR) || ')'
FROM requests r WHERE r.premises_id NOT IN (SELECT id FROM premises)
""",
        ID_REQUESTS_SQL,
    ),
)
def q_permalink_tool(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return TOOLS.permalink_tool_lines(t.premises, id_requests(t))


# =========================================================================== FIL3 / JOIN1 / AGG1
PC_REQUESTS_SQL = """
requests AS (
  SELECT DISTINCT address_city AS request_id, address_postcode AS postcode FROM premises WHERE address_postcode IS NOT NULL
  UNION ALL
  SELECT address_street, address_postcode FROM premises WHERE address_postcode IS NOT NULL)
"""


def postcode_requests(t: fx.Tables):
    pc = t.premises.where(F.col("address_postcode").isNotNull())
    per_city = pc.select(F.col("address_city").alias("request_id"), F.col("address_postcode").alias("postcode")).distinct()
    # every premises' postcode per street: long lists with duplicates
    every = pc.select(F.col("address_street").alias("request_id"), F.col("address_postcode").alias("postcode"))
    return per_city.unionByName(every)


@register(
    "fil3_join1_postcode_jobs",
    fx.oracle(
        """
SELECT DISTINCT r.request_id, p.address_postcode AS postcode, j.date, j.bin
FROM requests r
JOIN premises p ON p.address_postcode = r.postcode
JOIN jobs j ON p.id = j.premises_id
""",
        PC_REQUESTS_SQL,
    ),
)
def q_postcode_jobs(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return LK.postcode_jobs(t.premises, t.jobs, postcode_requests(t))


# =========================================================================== JOIN2 (flattened)
@register(
    "join2_premises_jobs",
    fx.oracle(
        f"""
SELECT {RESULT_SQL}, n.seq, n.date, n.bin
FROM premises p LEFT JOIN numbered n ON n.premises_id = p.id
""",
        EXISTING_JOBS_SQL + ",\n" + NUMBERED_JOBS_SQL,
    ),
)
def q_premises_jobs(spark, sf_dir):
    """JOIN2 as rows: each premises with its jobs in (date, bin, id) order
    (``seq``); a premises without jobs keeps one row with NULLs."""
    t = fx.load(spark, sf_dir)
    num = feeds.numbered_jobs(t.premises, t.jobs)
    p = t.premises.select(*LK.premises_result_columns())
    return p.join(num, p["id"] == num["premises_id"], "left").select(*[p[c] for c in p.columns], "seq", "date", "bin")


@register(
    "join2_colocated_rows",
    fx.oracle(
        """
SELECT p.id, p.address_postcode, j.id AS job_id, j.date, j.bin FROM premises p LEFT JOIN jobs j ON j.premises_id = p.id
"""
    ),
)
def q_colocated_rows(spark, sf_dir):
    """JOIN2 over stored tables that are bucketed on the premises id."""
    t = fx.load(spark, sf_dir)
    jobs = t.jobs.withColumnRenamed("id", "job_id")
    stored = COL.write_colocated(t.premises, jobs, _scratch(spark, "colocated"), buckets=16)
    return COL.premises_job_rows(stored, ["id", "address_postcode"], ["job_id", "date", "bin"])


# =========================================================================== SNK9
def _ical_oracle() -> str:
    name = f"'Bin Days for ' || {SUMMARY_SQL}"
    desc = (
        f"'Bin collection dates for your household' || chr(10) || chr(10) || {FULL_SQL} || chr(10) || chr(10) || 'ID: ' || "
        f"CAST(id AS VARCHAR) || chr(10) || chr(10) || 'Generated by {BASE}'"
    )
    head = [
        "'BEGIN:VCALENDAR'",
        "'VERSION:2.0'",
        f"'PRODID:{feeds.DEFAULT_PRODID}'",
        f"'NAME:' || {ical_escape_sql(name)}",
        f"'X-WR-CALNAME:' || {ical_escape_sql(name)}",
        f"'DESCRIPTION:' || {ical_escape_sql(desc)}",
        f"'X-WR-CALDESC:' || {ical_escape_sql(desc)}",
        f"'TIMEZONE-ID:{feeds.ICAL_TIMEZONE}'",
        f"'X-WR-TIMEZONE:{feeds.ICAL_TIMEZONE}'",
    ]
    head_sql = " UNION ALL ".join(
        f"SELECT id AS premises_id, 0 AS part, CAST(0 AS BIGINT) AS seq, {i} AS sub, {ical_fold_sql('(' + v + ')')} AS line FROM premises"
        for i, v in enumerate(head)
    )
    uid = "CAST(n.premises_id AS VARCHAR) || '_' || CAST(n.date AS VARCHAR) || '_' || n.bin"
    ymd = "strftime(n.date, '%Y%m%d')"
    full_p = FULL_SQL
    events = [
        "'BEGIN:VEVENT'",
        f"'UID:' || {ical_escape_sql(uid)}",
        "'SEQUENCE:0'",
        "'DTSTAMP:20000601T000000Z'",
        f"'DTSTART;VALUE=DATE:' || {ymd}",
        f"'DTEND;VALUE=DATE:' || {ymd}",
        "'X-MICROSOFT-CDO-ALLDAYEVENT:TRUE'",
        "'X-MICROSOFT-MSNCALENDAR-ALLDAYEVENT:TRUE'",
        f"'SUMMARY:' || {ical_escape_sql(cc_sql('n.bin') + " || ' Bin Collection'")}",
        f"'LOCATION:' || {ical_escape_sql(full_p)}",
        f"'URL;VALUE=URI:{BASE}/premises/' || CAST(n.premises_id AS VARCHAR) || '?date=' || CAST(n.date AS VARCHAR) || '&bin=' || n.bin",
        "'END:VEVENT'",
    ]
    ev_sql = " UNION ALL ".join(
        f"SELECT n.premises_id, 1, n.seq, {i}, {ical_fold_sql('(' + v + ')')} FROM numbered n JOIN premises p ON n.premises_id = p.id"
        for i, v in enumerate(events)
    )
    foot = "SELECT id, 2, CAST(0 AS BIGINT), 0, 'END:VCALENDAR' FROM premises"
    return fx.oracle(f"{head_sql}\nUNION ALL\n{ev_sql}\nUNION ALL\n{foot}", EXISTING_JOBS_SQL + ",\n" + NUMBERED_JOBS_SQL)


@register("snk9_ical_feed_lines", _ical_oracle())
def q_ical_feed_lines(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return feeds.ical_lines(t.premises, t.jobs, AS_OF_TS, BASE)


# =========================================================================== SNK10 / EXP1 / AGG2 / SNK11
@register(
    "snk10_exp1_sitemap_rows",
    fx.oracle(
        f"""
SELECT CAST(floor(rn / 50000) AS BIGINT) AS page, rn AS seq, id, '{BASE}/premises/' || CAST(id AS VARCHAR) AS url,
  {ISO_MILLIS_SQL.format(c='updated_at')} AS lastmod
FROM (SELECT id, updated_at, row_number() OVER (ORDER BY id) - 1 AS rn FROM premises) x
"""
    ),
)
def q_sitemap_rows(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return feeds.sitemap_rows(t.premises, BASE)


SITEMAP_TEST_PAGE = 400  # premises of a page here, so that small tables have several


@register(
    "exp1_sitemap_page",
    fx.oracle(
        f"""
SELECT id, 'https://example.org/premises/' || CAST(id AS VARCHAR) AS url,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z') AS lastmod
FROM premises ORDER BY id LIMIT {SITEMAP_TEST_PAGE} OFFSET {SITEMAP_TEST_PAGE}
"""
    ),
)
def q_sitemap_page(spark, sf_dir):
    """The second page, by id range, from a stored table and its page index."""
    store = TableStore(spark, _scratch(spark, "paged"))
    store.replace_if_nonempty(fx.load(spark, sf_dir).premises, "premises", sort_by=["id"])
    stored = store.load("premises")
    store.replace_if_nonempty(feeds.page_index(stored, SITEMAP_TEST_PAGE), "premises_pages")
    return feeds.indexed_sitemap_page(stored, store.load("premises_pages", T.StructType.fromDDL("page long, first_id long")), 1)


@register(
    "agg2_sitemap_page_count",
    fx.oracle("SELECT count(*) AS n, CAST(ceil(count(*) / 50000) AS BIGINT) AS pages FROM premises"),
)
def q_sitemap_pages(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return feeds.sitemap_page_count(t.premises)


@register(
    "snk11_sitemap_index_entries",
    fx.oracle(
        f"""
SELECT pos, loc, lastmod,
  chr(10) || '  <sitemap>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '    ' ||
  CASE WHEN lastmod IS NOT NULL THEN '<lastmod>' || lastmod || '</lastmod>' ELSE '' END ||
  chr(10) || '  </sitemap>' || chr(10) || '    ' AS xml
FROM (
  SELECT CAST(0 AS BIGINT) AS pos, '{BASE}/sitemap.xml' AS loc, '2000-05-01T12:00:00.000Z' AS lastmod
  UNION ALL SELECT CAST(1 AS BIGINT), '{BASE}/docs/sitemap.xml', '2000-05-01T12:00:00.000Z'
  UNION ALL SELECT CAST(g + 2 AS BIGINT), '{BASE}/premises/sitemap/' || CAST(g AS VARCHAR) || '.xml', NULL
  FROM (SELECT unnest(range(CAST(ceil((SELECT count(*) FROM premises) / 50000) AS BIGINT))) AS g) r) e
"""
    ),
)
def q_sitemap_index(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return feeds.sitemap_index_entries(t.premises, BUILD_TIME, BASE)


# =========================================================================== AGG4 / FIL4
@register(
    "agg4_fil4_upcoming_by_bin",
    fx.oracle(
        f"""
SELECT u.premises_id, r.bin_rank, u.bin, {cc_sql('u.bin')} AS title,
  CASE u.bin WHEN 'BLACK' THEN 'bg-gray-900 text-gray-50' WHEN 'GREEN' THEN 'bg-green-700 text-gray-50'
             WHEN 'BROWN' THEN 'bg-amber-900 text-gray-50' ELSE '' END AS style,
  u.date, strftime(u.date, '%d %B %Y') AS long_date
FROM up u JOIN (
  SELECT premises_id, bin, row_number() OVER (PARTITION BY premises_id ORDER BY
      CASE bin WHEN 'BLACK' THEN 0 WHEN 'GREEN' THEN 1 WHEN 'BROWN' THEN 2 ELSE -1 END, min(date), bin) - 1 AS bin_rank
  FROM up GROUP BY premises_id, bin) r ON u.premises_id = r.premises_id AND u.bin = r.bin
""",
        f"up AS (SELECT premises_id, bin, date FROM jobs WHERE date > {fx.AS_OF_SQL})",
    ),
)
def q_upcoming_by_bin(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return CAL.upcoming_by_bin(t.jobs, AS_OF)


# =========================================================================== AGG6 / AGG5 / CAL1 / DAT4
@register(
    "agg6_max_dates",
    fx.oracle(
        f"""
SELECT p.id AS premises_id, greatest(coalesce(m.mx, {fx.AS_OF_SQL}), {fx.AS_OF_SQL}) AS max_date
FROM premises p LEFT JOIN (SELECT premises_id, max(date) AS mx FROM jobs GROUP BY premises_id) m ON p.id = m.premises_id
"""
    ),
)
def q_max_dates(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return CAL.max_dates(t.premises, t.jobs, AS_OF)


DOT_CLASS_SQL = "CASE {b} WHEN 'BLACK' THEN 'bg-gray-900/90' WHEN 'BROWN' THEN 'bg-amber-900/90' WHEN 'GREEN' THEN 'bg-green-600/90' ELSE '' END"


@register(
    "agg5_bins_by_date",
    fx.oracle(
        f"""
SELECT premises_id, date, bin, count(*) AS n, {DOT_CLASS_SQL.format(b='bin')} AS dot_class
FROM jobs GROUP BY premises_id, date, bin
"""
    ),
)
def q_bins_by_date(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return CAL.bins_by_date(t.jobs)


@register(
    "cal1_calendar_grid",
    fx.oracle(
        f"""
SELECT d.premises_id, d.day, d.day = {fx.AS_OF_SQL} AS is_today,
  j.bin, count(j.id) AS n, CASE WHEN j.bin IS NOT NULL THEN {DOT_CLASS_SQL.format(b='j.bin')} END AS dot_class
FROM (
  SELECT e.premises_id, CAST(unnest(generate_series(CAST(date_trunc('week', {fx.AS_OF_SQL} - INTERVAL 7 DAY) AS DATE), e.last_day, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT p.id AS premises_id,
          least(greatest(greatest(coalesce(m.mx, {fx.AS_OF_SQL}), {fx.AS_OF_SQL}), CAST({fx.AS_OF_SQL} + INTERVAL 7 DAY AS DATE)),
                CAST(date_trunc('week', {fx.AS_OF_SQL} + INTERVAL 28 DAY) + INTERVAL 6 DAY AS DATE)) AS last_day
        FROM premises p LEFT JOIN (SELECT premises_id, max(date) AS mx FROM jobs GROUP BY premises_id) m ON p.id = m.premises_id) e
) d LEFT JOIN jobs j ON j.premises_id = d.premises_id AND j.date = d.day
GROUP BY d.premises_id, d.day, j.bin
"""
    ),
)
def q_calendar_grid(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return CAL.calendar_grid(t.premises, t.jobs, AS_OF)


@register(
    "dat4_calendar_bounds",
    fx.oracle(
        """
SELECT date AS today, CAST(date_trunc('week', date - INTERVAL 7 DAY) AS DATE) AS start_day,
  CAST(date_trunc('week', date + INTERVAL 28 DAY) + INTERVAL 6 DAY AS DATE) AS last_day
FROM (SELECT DISTINCT date FROM jobs) d
"""
    ),
)
def q_calendar_bounds(spark, sf_dir):
    """DAT4 for every job date taken as 'today'."""
    t = fx.load(spark, sf_dir)
    d = t.jobs.select(F.col("date").alias("today")).distinct()
    return d.select("today", D.calendar_start(F.col("today")).alias("start_day"), D.calendar_last_day(F.col("today")).alias("last_day"))


# =========================================================================== DAT1-3 / STR10
@register(
    "dat1_3_job_status",
    fx.oracle(
        f"""
SELECT id, premises_id, date, bin,
  CASE WHEN date < {fx.AS_OF_SQL} THEN 'Expired' WHEN date > {fx.AS_OF_SQL} THEN 'Upcoming' ELSE 'Today' END AS status,
  strftime(date, '%d %B %Y') AS long_date, strftime(date, '%a, %b %-d') AS short_date,
  CAST(date AS VARCHAR) || ' (' || CASE WHEN date < {fx.AS_OF_SQL} THEN 'Expired' WHEN date > {fx.AS_OF_SQL} THEN 'Upcoming' ELSE 'Today' END
    || '): ' || bin || ' bin' AS line
FROM jobs
"""
    ),
)
def q_job_status(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    st = D.job_status("date", AS_OF)
    return t.jobs.select(
        "id", "premises_id", "date", "bin", st.alias("status"), D.long_date("date").alias("long_date"),
        D.short_date("date").alias("short_date"), TX.job_line("date", st, "bin").alias("line"),
    )


# =========================================================================== STR1-11
@register(
    "str1_11_address_text",
    fx.oracle(
        f"""
SELECT id, {FULL_SQL} AS full_address, {PRESENTABLE_SQL} AS presentable, {ONE_LINE_SQL} AS one_line,
  {SUMMARY_SQL} AS summary, {TWO_LINE_SQL} AS two_line,
  split_part({TWO_LINE_SQL}, chr(10), 1) AS line1, split_part({TWO_LINE_SQL}, chr(10), 2) AS line2,
  'Bin Days for ' || {cc_sql(SUMMARY_SQL)} || ' at ' || coalesce(address_postcode, 'null') AS title,
  'View the scheduled bin collection days for ' || {cc_sql(SUMMARY_SQL)} || ' at ' || coalesce(address_postcode, 'null') AS description,
  '{BASE}/premises/' || CAST(id AS VARCHAR) AS url,
  '{BASE}/api/jobs?premises=' || CAST(id AS VARCHAR) || '&format=ical' AS ical_url,
  CAST(id AS VARCHAR) || ': ' || {ONE_LINE_SQL} AS list_line,
  search_postcode, upper(replace(address_postcode, ' ', '')) AS normalized,
  CAST({LEADING_INT_SQL} AS BIGINT) AS house_number
FROM premises
"""
    ),
)
def q_address_text(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    two = A.two_line_address()
    l1, l2 = A.two_line_split(two)
    return t.premises.select(
        "id",
        A.full_address().alias("full_address"),
        A.presentable_address().alias("presentable"),
        A.one_line_address().alias("one_line"),
        A.summary_address().alias("summary"),
        two.alias("two_line"),
        l1.alias("line1"),
        l2.alias("line2"),
        TX.page_title().alias("title"),
        TX.page_description().alias("description"),
        TX.premises_url("id", BASE).alias("url"),
        TX.ical_feed_url("id", BASE).alias("ical_url"),
        TX.premises_line().alias("list_line"),
        "search_postcode",
        A.normalize_postcode("address_postcode").alias("normalized"),
        A.leading_int("address_number").cast("long").alias("house_number"),
    )


@register(
    "str12_bin_styles",
    fx.oracle(
        f"""
SELECT bin, {cc_sql('bin')} AS title,
  CASE bin WHEN 'BLACK' THEN 0 WHEN 'GREEN' THEN 1 WHEN 'BROWN' THEN 2 ELSE -1 END AS bin_order,
  bin IN ('BLACK', 'GREEN', 'BROWN') AS is_supported,
  CASE bin WHEN 'BLACK' THEN 'bg-gray-900 text-gray-50' WHEN 'GREEN' THEN 'bg-green-700 text-gray-50'
           WHEN 'BROWN' THEN 'bg-amber-900 text-gray-50' ELSE '' END AS style,
  {DOT_CLASS_SQL.format(b='bin')} AS dot_class, count(*) AS jobs
FROM jobs GROUP BY bin
"""
    ),
)
def q_bin_styles(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return t.jobs.groupBy("bin").agg(F.count(F.lit(1)).alias("jobs")).select(
        "bin", A.capital_case("bin").alias("title"), A.bin_order("bin").alias("bin_order"),
        A.is_supported_bin("bin").alias("is_supported"), A.bin_list_class("bin").alias("style"),
        A.bin_dot_class("bin").alias("dot_class"), "jobs",
    )


# =========================================================================== NEAR1 / JOIN3 / JOIN4 / AGG7 / AGG8 / FIL7
HAV_SQL = (
    "2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(p.latitude) - radians(o.latitude)) / 2), 2) + "
    "cos(radians(o.latitude)) * cos(radians(p.latitude)) * pow(sin((radians(p.longitude) - radians(o.longitude)) / 2), 2), 1.0)))"
)
NEAR_SQL = f"""
near AS (
  SELECT * FROM (
    SELECT origin, postcode, latitude, longitude, distance,
      row_number() OVER (PARTITION BY origin ORDER BY distance, postcode <> origin, postcode) - 1 AS rank
    FROM (SELECT o.id AS origin, p.id AS postcode, p.latitude, p.longitude, {HAV_SQL} AS distance
          FROM postcodes o, postcodes p) pairs
    WHERE distance <= 2000.0) r
  WHERE rank < 100)
"""
NEARBY_JOBS_SQL = (
    NEAR_SQL
    + """,
pj AS (SELECT DISTINCT n.origin, n.postcode, j.date, j.bin
       FROM near n JOIN premises p ON p.address_postcode = n.postcode JOIN jobs j ON j.premises_id = p.id),
nj AS (SELECT n.origin, n.rank, n.postcode, n.latitude, n.longitude, n.distance, pj.date, pj.bin
       FROM near n LEFT JOIN pj ON n.origin = pj.origin AND n.postcode = pj.postcode)
"""
)


def _near(t: fx.Tables):
    return GEO.nearest_postcodes(t.postcodes)


def _stored_near(t: fx.Tables):
    """The nearest postcodes, written once for queries that read them more than once."""
    return materialize(_near(t), "near")


@register(
    "near1_nearest_postcodes",
    fx.oracle("SELECT origin, rank, postcode, round(distance, 3) AS distance FROM near", NEAR_SQL),
)
def q_nearest(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return _near(t).select("origin", F.col("rank").cast("long").alias("rank"), "postcode", F.round("distance", 3).alias("distance"))


@register(
    "near1_of_one_postcode",
    fx.oracle(
        "SELECT origin, rank, postcode, round(distance, 3) AS distance FROM near WHERE origin = (SELECT max(id) FROM postcodes)",
        NEAR_SQL,
    ),
)
def q_nearest_of_one(spark, sf_dir):
    """One origin, as a visitor's page asks."""
    t = fx.load(spark, sf_dir)
    origin = t.postcodes.agg(F.max("id").alias("postcode"))
    near = GEO.nearest_postcodes(t.postcodes, origin)
    return near.select("origin", F.col("rank").cast("long").alias("rank"), "postcode", F.round("distance", 3).alias("distance"))


@register(
    "join4_nearby_jobs",
    fx.oracle("SELECT origin, rank, postcode, round(distance, 3) AS distance, date, bin FROM nj", NEARBY_JOBS_SQL),
)
def q_nearby_jobs(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    nj = GEO.nearby_jobs(_stored_near(t), t.premises, t.jobs)
    return nj.select("origin", F.col("rank").cast("long").alias("rank"), "postcode", F.round("distance", 3).alias("distance"), "date", "bin")


@register("agg7_date_facets", fx.oracle("SELECT DISTINCT origin, date FROM nj WHERE date IS NOT NULL", NEARBY_JOBS_SQL))
def q_date_facets(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return GEO.date_facets(_stored_near(t), t.premises, t.jobs)


AGG8_SQL = f"""
SELECT origin, coalesce(min(CASE WHEN rank = 0 AND date >= {fx.AS_OF_SQL} THEN date END), min(date)) AS default_date
FROM nj GROUP BY origin
"""


@register("agg8_default_dates", fx.oracle(AGG8_SQL, NEARBY_JOBS_SQL))
def q_default_dates(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return GEO.default_dates(_stored_near(t), t.premises, t.jobs, AS_OF)


@register(
    "fil7_map_markers",
    fx.oracle(
        f"""
SELECT nj.origin, d.default_date AS selected_date, nj.rank, nj.postcode, nj.distance = 0 AS is_self,
  string_agg(nj.bin, ',' ORDER BY nj.bin) AS bins,
  string_agg({DOT_CLASS_SQL.format(b='nj.bin')}, ',' ORDER BY nj.bin) AS classes
FROM nj JOIN ({AGG8_SQL}) d ON nj.origin = d.origin AND nj.date = d.default_date
GROUP BY nj.origin, d.default_date, nj.rank, nj.postcode, nj.distance
""",
        NEARBY_JOBS_SQL,
    ),
)
def q_map_markers(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    near = _stored_near(t)
    sel = GEO.default_dates(near, t.premises, t.jobs, AS_OF).select("origin", F.col("default_date").alias("selected_date"))
    m = GEO.map_markers(near, t.premises, t.jobs, sel)
    return m.select(
        "origin", "selected_date", F.col("rank").cast("long").alias("rank"), "postcode", "is_self",
        F.array_join("bins", ",").alias("bins"), F.array_join("classes", ",").alias("classes"),
    )


@register(
    "join3_pending_geocodes",
    fx.oracle(
        """
SELECT address_postcode AS postcode, count(*) AS premises_count FROM premises
WHERE address_postcode IS NOT NULL AND address_postcode NOT IN (SELECT id FROM postcodes)
GROUP BY address_postcode
"""
    ),
)
def q_pending_geocodes(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return GEO.pending_geocodes(t.premises, t.postcodes)


@register(
    "lim1_random_premises",
    fx.oracle(
        """
SELECT id, address_postcode AS addressPostcode FROM premises ORDER BY md5('7:' || CAST(id AS VARCHAR)), id LIMIT 5
"""
    ),
)
def q_random_premises(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return LK.random_premises(t.premises, k=5, seed=7)


@register(
    "lim2_random_pending_geocode",
    fx.oracle(
        """
SELECT postcode FROM (
  SELECT address_postcode AS postcode, count(*) AS n FROM premises
  WHERE address_postcode IS NOT NULL AND address_postcode NOT IN (SELECT id FROM postcodes)
  GROUP BY address_postcode) p
ORDER BY -ln((('0x' || substr(md5('7:' || postcode), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n, postcode LIMIT 20
"""
    ),
)
def q_random_pending(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    return GEO.random_pending_geocodes(t.premises, t.postcodes, k=20, seed=7)


# =========================================================================== SNK2-6 / JOIN6 / CHG1 / JOIN5
SNAP_SQL = """
old_s AS (SELECT * FROM premises WHERE id % 10 <> 0),
new_s AS (SELECT id, address_room, address_number, address_street,
                 CASE WHEN id % 8 = 0 THEN 'X' ELSE address_locality END AS address_locality, address_city, address_postcode
          FROM premises_src WHERE id % 10 <> 1)
"""
_ADDR = A.PARTS
_DISTINCT_SQL = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in _ADDR)


@register(
    "snk2_join6_snapshot_diff",
    fx.oracle(
        f"""
SELECT coalesce(n.id, o.id) AS id,
  CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' WHEN {_DISTINCT_SQL} THEN 'update' ELSE 'unchanged' END AS op,
  {", ".join(f"CASE WHEN n.id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _ADDR)}
FROM old_s o FULL OUTER JOIN new_s n ON o.id = n.id
""",
        SNAP_SQL,
    ),
)
def q_snapshot_diff(spark, sf_dir):
    old, new = fx.premises_snapshots(spark, sf_dir)
    return MG.snapshot_diff(old, new)


@register(
    "snk2_snapshot_changes",
    fx.oracle(
        f"""
SELECT coalesce(n.id, o.id) AS id,
  CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS op,
  {", ".join(f"CASE WHEN n.id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _ADDR)}
FROM old_few o FULL OUTER JOIN new_few n ON o.id = n.id
WHERE n.id IS NULL OR o.id IS NULL OR {_DISTINCT_SQL}
""",
        """
old_few AS (SELECT * FROM premises WHERE id % 499 <> 7),
new_few AS (SELECT id, CASE WHEN id % 701 = 5 THEN NULL ELSE address_room END AS address_room,
                   CASE WHEN id % 701 = 6 THEN 'X' ELSE address_number END AS address_number,
                   address_street, address_locality, address_city, address_postcode
            FROM premises_src WHERE id % 499 <> 8)
""",
    ),
)
def q_snapshot_changes(spark, sf_dir):
    """What a snapshot changes, where few key ranges differ: digests of ranges
    choose what the full outer join reads."""
    base = fx.premises_source(spark, sf_dir)
    i = F.col("id")
    new = base.where(i % 499 != 8).withColumns(
        {
            "address_room": F.when(i % 701 != 5, F.col("address_room")),
            "address_number": F.when(i % 701 == 6, F.lit("X")).otherwise(F.col("address_number")),
        }
    )
    return MG.snapshot_changes(base.where(i % 499 != 7), new, range_rows=50)


MERGE_TS_SQL = "TIMESTAMP '2000-06-01 03:00:00'"


@register(
    "snk3_merge_premises",
    fx.oracle(
        f"""
SELECT n.id, {", ".join(f"n.{c}" for c in _ADDR)}, upper(replace(n.address_postcode, ' ', '')) AS search_postcode,
  CASE WHEN o.id IS NOT NULL THEN o.created_at ELSE {MERGE_TS_SQL} END AS created_at,
  CASE WHEN o.id IS NOT NULL AND NOT ({_DISTINCT_SQL}) THEN o.updated_at ELSE {MERGE_TS_SQL} END AS updated_at
FROM new_s n LEFT JOIN old_s o ON o.id = n.id
""",
        SNAP_SQL,
    ),
)
def q_merge_premises(spark, sf_dir):
    old, new = fx.premises_snapshots(spark, sf_dir)
    return MG.merge_premises(old, new, fx.MERGE_TS)


@register(
    "snk4_merge_jobs",
    fx.oracle(
        """
SELECT o.premises_id, o.bin, o.date, 'kept' AS origin FROM old_j o
WHERE EXISTS (SELECT 1 FROM new_j n WHERE n.premises_id = o.premises_id AND n.bin = o.bin AND n.date = o.date)
UNION ALL
SELECT premises_id, bin, date, 'inserted' FROM (
  SELECT DISTINCT premises_id, bin, date FROM new_j
  EXCEPT SELECT premises_id, bin, date FROM old_j) x
""",
        "old_j AS (SELECT * FROM jobs WHERE id % 10 <> 0),\nnew_j AS (SELECT * FROM jobs WHERE id % 10 <> 1)",
    ),
)
def q_merge_jobs(spark, sf_dir):
    old, new = fx.jobs_snapshots(spark, sf_dir)
    return MG.merge_jobs(old, new).select("premises_id", "bin", "date", "origin")


GEOCODE_BATCH_SQL = """
batch AS (
  SELECT id, latitude + 0.001 AS latitude, longitude FROM postcodes WHERE id LIKE '% 0aB'
  UNION ALL
  SELECT postcode AS id,
    53.8 + CAST(regexp_extract(postcode, '^QX([0-9]+) ', 1) AS INTEGER) * 0.004 AS latitude,
    -1.55 + CAST(regexp_extract(postcode, ' ([0-9]+)aB$', 1) AS INTEGER) * 0.006 AS longitude
  FROM (SELECT DISTINCT address_postcode AS postcode FROM premises
        WHERE address_postcode IS NOT NULL AND address_postcode NOT IN (SELECT id FROM postcodes)) pend)
"""


def geocode_batch(t: fx.Tables):
    moved = t.postcodes.where(F.col("id").like("% 0aB")).select("id", (F.col("latitude") + F.lit(0.001)).alias("latitude"), "longitude")
    pend = GEO.pending_geocodes(t.premises, t.postcodes).select("postcode")
    n = F.regexp_extract("postcode", r"^QX([0-9]+) ", 1).cast("int")
    k = F.regexp_extract("postcode", r" ([0-9]+)aB$", 1).cast("int")
    fresh = pend.select(
        F.col("postcode").alias("id"), (F.lit(53.8) + n * F.lit(0.004)).alias("latitude"), (F.lit(-1.55) + k * F.lit(0.006)).alias("longitude")
    )
    return moved.unionByName(fresh)


@register(
    "snk5_upsert_postcodes",
    fx.oracle(
        f"""
SELECT coalesce(b.id, o.id) AS id, round(coalesce(b.latitude, o.latitude), 6) AS latitude,
  round(coalesce(b.longitude, o.longitude), 6) AS longitude,
  coalesce(o.created_at, {MERGE_TS_SQL}) AS created_at, coalesce(o.updated_at, {MERGE_TS_SQL}) AS updated_at
FROM postcodes o FULL OUTER JOIN batch b ON o.id = b.id
""",
        GEOCODE_BATCH_SQL,
    ),
)
def q_upsert_postcodes(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    m = MG.upsert_postcodes(t.postcodes, geocode_batch(t), fx.MERGE_TS)
    return m.select("id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "created_at", "updated_at")


# Change markers: stored = markers of the old snapshots, observed = markers of
# the new ones (premises changed, jobs unchanged, postcodes probe failed,
# geocodes new).
DL = "https://example.org/downloads"
URLS = {
    "premises": f"{DL}/premises.csv",
    "jobs": f"{DL}/jobs.csv",
    "postcodes": f"{DL}/postcodes.csv",
    "geocodes": f"{DL}/geocodes.json",
}


def marker_sql(table: str, cols: list[str]) -> str:
    row = "concat_ws(chr(1), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(2))" for c in cols) + ")"
    return f"(SELECT CAST(count(*) AS VARCHAR) || '-' || CAST(sum(('0x' || substr(md5({row}), 1, 15))::BIGINT) AS VARCHAR) FROM {table})"


P_COLS = ["id"] + list(A.PARTS)
J_COLS = ["id", "premises_id", "bin", "date"]
MARKERS_SQL = f"""
{SNAP_SQL},
old_j AS (SELECT * FROM jobs WHERE id % 10 <> 0),
pend AS (SELECT DISTINCT address_postcode AS postcode FROM premises
         WHERE address_postcode IS NOT NULL AND address_postcode NOT IN (SELECT id FROM postcodes)),
markers AS (
  SELECT '{URLS['premises']}' AS url, {marker_sql('old_s', P_COLS)} AS etag, {fx.LOAD_TS_SQL} AS checked_at, {fx.LOAD_TS_SQL} AS created_at, {fx.LOAD_TS_SQL} AS updated_at
  UNION ALL SELECT '{URLS['jobs']}', {marker_sql('old_j', J_COLS)}, {fx.LOAD_TS_SQL}, {fx.LOAD_TS_SQL}, {fx.LOAD_TS_SQL}
  UNION ALL SELECT '{URLS['postcodes']}', {marker_sql('postcodes', ['id'])}, {fx.LOAD_TS_SQL}, {fx.LOAD_TS_SQL}, {fx.LOAD_TS_SQL}),
obs AS (
  SELECT '{URLS['premises']}' AS url, {marker_sql('new_s', P_COLS)} AS etag, {MERGE_TS_SQL} AS last_modified, {MERGE_TS_SQL} AS checked_at
  UNION ALL SELECT '{URLS['jobs']}', {marker_sql('old_j', J_COLS)}, {MERGE_TS_SQL}, {MERGE_TS_SQL}
  UNION ALL SELECT '{URLS['postcodes']}', NULL, NULL, {MERGE_TS_SQL}
  UNION ALL SELECT '{URLS['geocodes']}', {marker_sql('pend', ['postcode'])}, {MERGE_TS_SQL}, {MERGE_TS_SQL}),
gate AS (
  SELECT b.url, b.etag, m.etag AS stored_etag,
    CASE WHEN b.etag IS NULL OR b.last_modified IS NULL THEN 'unknown'
         WHEN m.url IS NOT NULL AND b.etag IS NOT DISTINCT FROM m.etag THEN 'unchanged' ELSE 'changed' END AS decision,
    b.last_modified, b.checked_at
  FROM obs b LEFT JOIN markers m ON b.url = m.url),
merged AS (
  SELECT coalesce(g.url, m.url) AS url,
    CASE WHEN g.url IS NOT NULL THEN g.etag ELSE m.etag END AS etag,
    CASE WHEN g.url IS NOT NULL THEN g.checked_at ELSE m.checked_at END AS checked_at,
    coalesce(m.created_at, {MERGE_TS_SQL}) AS created_at,
    CASE WHEN g.url IS NOT NULL THEN g.last_modified ELSE m.updated_at END AS updated_at
  FROM markers m FULL OUTER JOIN (SELECT * FROM gate WHERE decision <> 'unknown') g ON m.url = g.url)
"""


def marker_tables(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    old_p, new_p = fx.premises_snapshots(spark, sf_dir)
    old_j, _ = fx.jobs_snapshots(spark, sf_dir)
    pend = GEO.pending_geocodes(t.premises, t.postcodes)
    load, now = fx.LOAD_TS, fx.MERGE_TS
    stored = [
        CHG.marker_rows(CHG.snapshot_marker(old_p, P_COLS), URLS["premises"], load, load),
        CHG.marker_rows(CHG.snapshot_marker(old_j, J_COLS), URLS["jobs"], load, load),
        CHG.marker_rows(CHG.snapshot_marker(t.postcodes, ["id"]), URLS["postcodes"], load, load),
    ]
    markers = stored[0].unionByName(stored[1]).unionByName(stored[2]).select(
        "url", "etag", "checked_at", F.col("checked_at").alias("created_at"), F.col("last_modified").alias("updated_at")
    )
    failed = CHG.snapshot_marker(t.postcodes, ["id"]).select(
        F.lit(URLS["postcodes"]).alias("url"), F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("timestamp").alias("last_modified"), D.ts_lit(now).alias("checked_at"),
    )
    obs = (
        CHG.marker_rows(CHG.snapshot_marker(new_p, P_COLS), URLS["premises"], now, now)
        .unionByName(CHG.marker_rows(CHG.snapshot_marker(old_j, J_COLS), URLS["jobs"], now, now))
        .unionByName(failed)
        .unionByName(CHG.marker_rows(CHG.snapshot_marker(pend, ["postcode"]), URLS["geocodes"], now, now))
    )
    return markers, obs


@register("chg1_change_gate", fx.oracle("SELECT url, etag, stored_etag, decision FROM gate", MARKERS_SQL))
def q_change_gate(spark, sf_dir):
    markers, obs = marker_tables(spark, sf_dir)
    return CHG.change_gate(obs, markers).select("url", "etag", "stored_etag", "decision")


@register("snk6_upsert_markers", fx.oracle("SELECT url, etag, checked_at, created_at, updated_at FROM merged", MARKERS_SQL))
def q_upsert_markers(spark, sf_dir):
    markers, obs = marker_tables(spark, sf_dir)
    gate = CHG.change_gate(obs, markers).where(F.col("decision") != "unknown")
    return MG.upsert_markers(markers, gate, fx.MERGE_TS)


@register(
    "join5_dataset_status",
    fx.oracle(
        f"""
SELECT d.key, d.name, d.url,
  CASE WHEN m.url IS NOT NULL THEN strftime(m.checked_at, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE 'N/A' END AS last_checked,
  CASE WHEN m.url IS NOT NULL THEN strftime(m.updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE 'N/A' END AS last_updated,
  coalesce(m.etag, 'N/A') AS etag
FROM (SELECT 'jobs' AS key, 'Jobs' AS name, '{URLS['jobs']}' AS url
      UNION ALL SELECT 'premises', 'Premises', '{URLS['premises']}'
      UNION ALL SELECT 'geocodes', 'Geocodes', '{URLS['geocodes']}'
      UNION ALL SELECT 'streets', 'Streets', '{DL}/streets.csv') d
LEFT JOIN merged m ON d.url = m.url
""",
        MARKERS_SQL,
    ),
)
def q_dataset_status(spark, sf_dir):
    markers, obs = marker_tables(spark, sf_dir)
    gate = CHG.change_gate(obs, markers).where(F.col("decision") != "unknown")
    merged = MG.upsert_markers(markers, gate, fx.MERGE_TS)
    datasets = CHG.dataset_list(spark, DL).unionByName(
        spark.createDataFrame([("geocodes", "Geocodes", URLS["geocodes"]), ("streets", "Streets", f"{DL}/streets.csv")], "key string, name string, url string")
    )
    return CHG.dataset_status(datasets, merged)


# =========================================================================== WIN1 / JSN1
RECENTS_SQL = """
adds AS (SELECT user_id, event_id % 1500 AS pid, ts, event_id FROM events),
last_add AS (SELECT user_id, pid, ts AS last_ts, event_id AS last_ev FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, pid ORDER BY ts DESC, event_id DESC) AS rn FROM adds) a WHERE rn = 1),
recents AS (SELECT * FROM (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, last_ev DESC, pid) - 1 AS INTEGER) AS position,
         pid, last_ts FROM last_add) r WHERE position < 10)
"""


def _adds(spark, sf_dir):
    """Every event as an add."""
    return fx.recents_log(spark, sf_dir).withColumn("op", F.lit("add"))


@register("win1_recents_add_only", fx.oracle("SELECT user_id, position, pid, last_ts FROM recents", RECENTS_SQL))
def q_recents_add_only(spark, sf_dir):
    from kerbside.operators.recents import recents_add_only

    return recents_add_only(_adds(spark, sf_dir))


@register(
    "jsn1_saved_list_parse",
    fx.oracle(
        """
SELECT r.user_id, r.position, r.pid AS id, p.address_room AS addressRoom, p.address_number AS addressNumber,
  p.address_street AS addressStreet, p.address_locality AS addressLocality, p.address_city AS addressCity,
  p.address_postcode AS addressPostcode
FROM recents r LEFT JOIN premises p ON r.pid = p.id
WHERE r.user_id % 5 <> 0
""",
        RECENTS_SQL,
    ),
)
def q_saved_list(spark, sf_dir):
    """Saved lists written as JSON from the add-only recents, with the lists of
    users whose id is a multiple of 5 corrupted (an id turned into text): the
    parser must return those as empty."""
    from kerbside.operators.recents import parse_saved_list, recents_add_only, saved_list_json

    t = fx.load(spark, sf_dir)
    docs = saved_list_json(recents_add_only(_adds(spark, sf_dir)), t.premises)
    bad = F.regexp_replace("document", r'^\{"premises":\[\{"id":([0-9]+)', '{"premises":[{"id":"$1"')
    docs = docs.select("user_id", F.when(F.col("user_id") % 5 == 0, bad).otherwise(F.col("document")).alias("document"))
    return parse_saved_list(docs)


# =========================================================================== SRC1-3 / SRC5 / ING1-9 round trips
# Each query exports data Spark derives from the tables in the source file
# format to a scratch folder under the shared checkpoint folder, then ingests
# it with the readers, so the whole ingest path runs over whole tables.


_CSV_OUT = {"header": "false", "quote": '"', "escape": '"', "sep": ",", "lineSep": "\n"}


def _scratch(spark, tag: str) -> str:
    from kerbside.plans.stage import stage_path

    return stage_path(spark, tag)


def _export_premises_csv(spark, sf_dir) -> str:
    path = _scratch(spark, "premises-csv")
    fx.premises_source(spark, sf_dir).select("id", *A.PARTS).write.options(**_CSV_OUT).csv(path)
    return path


_INGEST_PREMISES_SQL = f"SELECT id, {', '.join(A.PARTS)}, search_postcode, {fx.LOAD_TS_SQL} AS created_at FROM premises"


@register("src1_ing_premises_csv", fx.oracle(_INGEST_PREMISES_SQL))
def q_ingest_premises(spark, sf_dir):
    path = _export_premises_csv(spark, sf_dir)
    return ING.read_premises_csv(spark, path, fx.LOAD_TS).select("id", *A.PARTS, "search_postcode", "created_at")


@register(
    "src5_sqlite_premises_layout",
    fx.oracle(
        "SELECT id, address_room AS address_1, address_number AS address_2, address_street AS address_3, "
        "address_locality AS locality, address_city AS city, address_postcode AS postcode FROM premises"
    ),
)
def q_ingest_sqlite_layout(spark, sf_dir):
    path = _export_premises_csv(spark, sf_dir)
    return ING.read_sqlite_premises(spark, path, fx.LOAD_TS).select(*SQLITE_PREMISES_COLUMNS)


def _export_jobs_csv(spark, sf_dir, with_duplicates: bool = False) -> str:
    path = _scratch(spark, "jobs-csv")
    j = fx.jobs_source(spark, sf_dir)
    line = j.select("premises_id", "bin", F.date_format("date", "d/M/yy").alias("date"))
    if with_duplicates:  # every line of a premises divisible by 4 appears twice
        line = line.unionByName(line.where(F.col("premises_id") % 4 == 0))
    line.write.options(**_CSV_OUT).csv(path)
    return path


@register("src2_ing4_jobs_csv", fx.oracle("SELECT premises_id, bin, date FROM jobs"))
def q_ingest_jobs(spark, sf_dir):
    return ING.read_jobs_csv(spark, _export_jobs_csv(spark, sf_dir)).select("premises_id", "bin", "date")


@register("ing5_jobs_line_dedupe", fx.oracle("SELECT DISTINCT premises_id, bin, date FROM jobs"))
def q_ingest_jobs_dedupe(spark, sf_dir):
    """Legacy path: identical raw lines keep one (duplicates injected on export)."""
    path = _export_jobs_csv(spark, sf_dir, with_duplicates=True)
    return ING.read_jobs_csv(spark, path, dedupe=True).select("premises_id", "bin", "date")


@register(
    "src3_geocode_documents",
    fx.oracle(
        "SELECT postcode, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, round(distance, 3) AS distance FROM near",
        NEAR_SQL,
    ),
)
def q_geocode_documents(spark, sf_dir):
    """Nearby answers written as response documents (JSON Lines), plus a
    not-found body per pending postcode, read back by the geocode reader."""
    t = fx.load(spark, sf_dir)
    near = _near(t)
    path = _scratch(spark, "geocodes-json")
    item = F.struct("postcode", "longitude", "latitude", "distance")
    docs = near.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("e")))).alias("_r"))  # ≤ 100 per origin
    ok = docs.select(F.to_json(F.struct(F.transform("_r", lambda x: x["e"]).alias("result"))).alias("value"))
    missing = GEO.pending_geocodes(t.premises, t.postcodes).select(F.lit('{"status":404,"error":"Postcode not found"}').alias("value"))
    ok.unionByName(missing).write.text(path)
    g = ING.read_geocodes(spark, path, multi_line=False)
    return g.select("postcode", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), F.round("distance", 3).alias("distance"))


@register(
    "src3_geocode_faulty_documents",
    fx.oracle(
        """
SELECT id AS postcode, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM postcodes
WHERE ascii(md5(id)) % 4 = 0
"""
    ),
)
def q_geocode_faulty_documents(spark, sf_dir):
    """One document per geocoded postcode, without ``distance``; three in four
    are cut short, refused (500) or not found (404), and give no row."""
    t = fx.load(spark, sf_dir)
    doc = F.to_json(F.struct(F.array(F.struct(F.col("id").alias("postcode"), "longitude", "latitude")).alias("result")))
    kind = F.ascii(F.md5("id")) % 4
    body = (
        F.when(kind == 1, F.substring(doc, 1, 30))
        .when(kind == 2, F.lit('{"status":500,"error":"Server error"}'))
        .when(kind == 3, F.lit('{"status":404,"error":"Postcode not found"}'))
        .otherwise(doc)
    )
    path = _scratch(spark, "geocodes-faulty")
    t.postcodes.select(body.alias("value")).write.text(path)
    g = ING.read_geocodes(spark, path, on_invalid="drop", multi_line=False)
    return g.select("postcode", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


# =========================================================================== FIL8
RAW_REQUESTS_SQL = """
raw AS (SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'abc'
       WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS VARCHAR) || '.5'
       WHEN o_orderkey % 11 = 0 THEN ' ' || CAST(o_custkey AS VARCHAR)
       ELSE CAST(o_custkey AS VARCHAR) END AS premises,
  CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN NULL ELSE 'xml' END AS format
FROM orders)
"""


def raw_requests(spark, sf_dir):
    o = fx.read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return o.select(
        k.alias("request_id"),
        F.when(k % 13 == 0, F.lit("abc")).when(k % 7 == 0, F.concat(c, F.lit(".5"))).when(k % 11 == 0, F.concat(F.lit(" "), c)).otherwise(c).alias("premises"),
        F.when(F.col("o_orderstatus") == "F", F.lit("csv")).when(F.col("o_orderstatus") == "O", F.lit(None).cast("string")).otherwise(F.lit("xml")).alias("format"),
    )


@register(
    "fil8_validate_requests",
    fx.oracle(
        """
SELECT request_id, premises_id, fmt AS format,
  CASE WHEN premises_id IS NULL THEN 'premises: expected a number'
       WHEN fmt NOT IN ('json', 'csv', 'ical') THEN 'format: expected one of json, csv, ical' END AS error
FROM (SELECT request_id, coalesce(format, 'json') AS fmt,
        CASE WHEN regexp_matches(trim(premises), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(premises) AS BIGINT) END AS premises_id
      FROM raw) v
""",
        RAW_REQUESTS_SQL,
    ),
)
def q_validate_requests(spark, sf_dir):
    return LK.validate_job_requests(raw_requests(spark, sf_dir))


@register(
    "fil8_validate_tool_ids",
    fx.oracle(
        """
SELECT request_id, CASE WHEN ok THEN CAST(v AS BIGINT) END AS premises_id,
  CASE WHEN NOT ok THEN 'premisesId: expected a non-negative integer' END AS error
FROM (SELECT request_id, v, v >= 0 AND v = trunc(v) AS ok FROM (
  SELECT id AS request_id,
    CASE WHEN id % 7 = 0 THEN premises_id + 0.5 WHEN id % 11 = 0 THEN -1.0 * premises_id ELSE 1.0 * premises_id END AS v
  FROM jobs) a) b
"""
    ),
)
def q_validate_tool_ids(spark, sf_dir):
    t = fx.load(spark, sf_dir)
    p = F.col("premises_id").cast("double")
    raw = t.jobs.select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 7 == 0, p + 0.5).when(F.col("id") % 11 == 0, -p).otherwise(p).alias("premisesId"),
    )
    return LK.validate_tool_ids(raw)


# --------------------------------------------------------------------------- dirty exports (ING1-3)
_DIRTY_STREET_SQL = (
    "CASE id % 6 WHEN 0 THEN address_street || ', \"THE\" END' WHEN 1 THEN '6\" ' || address_street ELSE address_street END"
)
_DIRTY_ROOM_SQL = "CASE WHEN id % 499 = 0 THEN repeat('x', 100000) ELSE address_room END"


@register(
    "ing1_ing2_dirty_premises_csv",
    fx.oracle(
        f"""
SELECT id, {_DIRTY_ROOM_SQL} AS address_room, address_number, {_DIRTY_STREET_SQL} AS address_street,
  address_locality, address_city, address_postcode FROM premises
"""
    ),
)
def q_dirty_premises(spark, sf_dir):
    """Every premises exported with what real files hold: NUL bytes, carriage
    returns, blank lines, commas and doubled quotes in quoted fields, bare
    quotes in unquoted ones, empty quoted fields and fields of 100,000
    characters; the reader must give the clean values back."""
    rows = fx.premises_source(spark, sf_dir)
    i = F.col("id")
    street = (
        F.when(i % 6 == 0, F.concat("address_street", F.lit(', "THE" END')))
        .when(i % 6 == 1, F.concat(F.lit('6" '), "address_street"))
        .otherwise(F.col("address_street"))
    )
    room = F.when(i % 499 == 0, F.lit("x" * 100_000)).otherwise(F.col("address_room"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    text = lambda c: F.when(i % 6 == 0, quoted(c)).otherwise(F.coalesce(c, F.lit("")))
    fields = [i.cast("string"), quoted(room), *(text(street if p == "address_street" else F.col(p)) for p in A.PARTS[1:])]
    line = F.concat_ws(",", *fields)
    line = F.when(i % 5 == 0, F.concat(F.lit("\u0000"), line, F.lit("\u0000"))).otherwise(line)
    line = F.when(i % 4 == 0, F.concat(line, F.lit("\r"))).otherwise(line)
    line = F.when(i % 9 == 0, F.concat(line, F.lit("\n"))).otherwise(line)
    path = _scratch(spark, "premises-dirty")
    rows.select(line.alias("value")).write.text(path)
    return ING.read_premises_csv(spark, path, fx.LOAD_TS).select("id", *A.PARTS)


@register(
    "ing3_bad_lines",
    fx.oracle(
        """
SELECT value, reason FROM (
  SELECT CASE id % 50 WHEN 1 THEN 'x' || premises_id || ',' || bin || ',' || d WHEN 2 THEN premises_id || ',' || bin || ',32/13/00'
              WHEN 3 THEN premises_id || ',' || bin WHEN 4 THEN premises_id || ',"' || bin || ',' || d END AS value,
         CASE id % 50 WHEN 1 THEN 'integer premises_id' WHEN 2 THEN 'date' WHEN 3 THEN 'field count'
              WHEN 4 THEN 'unterminated quote' END AS reason
  FROM (SELECT id, CAST(premises_id AS VARCHAR) AS premises_id, bin, strftime(date, '%d/%m/%y') AS d FROM jobs) j) x
WHERE value IS NOT NULL
"""
    ),
)
def q_bad_lines(spark, sf_dir):
    """A jobs export in which every fiftieth row has one of four faults."""
    jobs = fx.jobs_source(spark, sf_dir)
    i, p, d = F.col("id") % 50, F.col("premises_id").cast("string"), F.date_format("date", "dd/MM/yy")
    line = (
        F.when(i == 1, F.concat(F.lit("x"), F.concat_ws(",", p, "bin", d)))
        .when(i == 2, F.concat_ws(",", p, "bin", F.lit("32/13/00")))
        .when(i == 3, F.concat_ws(",", p, "bin"))
        .when(i == 4, F.concat(p, F.lit(',"'), F.col("bin"), F.lit(","), d))
        .otherwise(F.concat_ws(",", p, "bin", d))
    )
    path = _scratch(spark, "jobs-bad")
    jobs.select(line.alias("value")).write.text(path)
    return ING.bad_lines(spark, path, "jobs").select("value", "reason")


@register(
    "ing8_job_ids",
    fx.oracle(
        """
SELECT row_number() OVER (ORDER BY CASE WHEN id % 10 = 0 THEN 0 WHEN id % 10 < 4 THEN 1 ELSE 2 END, id) AS id,
  premises_id, bin, date
FROM jobs
"""
    ),
)
def q_job_ids(spark, sf_dir):
    """Ids in load order: three exports of unequal size, each sorted over
    several files, are loaded together; an id is the line's number over all."""
    path = _scratch(spark, "jobs-parts")
    jobs = fx.jobs_source(spark, sf_dir)
    last = F.col("id") % 10
    for k, part in enumerate([last == 0, last.between(1, 3), last > 3]):
        ordered = jobs.where(part).orderBy("id").select("premises_id", "bin", F.date_format("date", "d/M/yy").alias("date"))
        ordered.write.options(**_CSV_OUT).csv(f"{path}/{k}")
    return ING.read_jobs_csv(spark, [f"{path}/{k}" for k in range(3)])


# =========================================================================== SNK1 / SRC4 / AGG3 / CHG2 / CHG3


@register("snk1_src4_guarded_replace", fx.oracle(f"SELECT id, {', '.join(A.PARTS)}, search_postcode FROM premises"))
def q_guarded_replace(spark, sf_dir):
    """Stage the premises into a versioned table, then offer an empty
    snapshot: the guard keeps the first version current; read it back."""
    t = fx.load(spark, sf_dir)
    store = TableStore(spark, _scratch(spark, "store"))
    first = store.replace_if_nonempty(t.premises, "premises")
    second = store.replace_if_nonempty(t.premises.where(F.lit(False)), "premises")
    if not first or second:
        raise RuntimeError(f"expected one replacement, got {first} and {second}")
    return store.load("premises").select("id", *A.PARTS, "search_postcode")


@register("chg2_chg3_refresh_runs")
def q_refresh_runs(spark, sf_dir):
    """Two refresh runs over CSV snapshots exported from the tables: the first
    loads both datasets (changed), the second finds them unchanged; returns
    the run records and the loaded row counts."""
    store = TableStore(spark, _scratch(spark, "refresh"))
    p_path, j_path = _export_premises_csv(spark, sf_dir), _export_jobs_csv(spark, sf_dir)
    datasets = [
        Dataset("premises", URLS["premises"], lambda s: ING.read_premises_csv(s, p_path, fx.LOAD_TS)),
        Dataset("jobs", URLS["jobs"], lambda s: ING.read_jobs_csv(s, j_path)),
    ]
    obs = CHG.marker_rows(CHG.snapshot_marker(fx.premises_source(spark, sf_dir), P_COLS), URLS["premises"], fx.MERGE_TS, fx.MERGE_TS).unionByName(
        CHG.marker_rows(CHG.snapshot_marker(fx.jobs_source(spark, sf_dir), J_COLS), URLS["jobs"], fx.MERGE_TS, fx.MERGE_TS)
    )
    tick = itertools.count()
    clock = lambda: fx.MERGE_TS + _dt.timedelta(seconds=next(tick))  # noqa: E731 - every look at it is a second later
    refresh(spark, store, datasets, obs, now=clock)
    refresh(spark, store, datasets, obs, now=clock)
    counts = store.load("premises").agg(F.count(F.lit(1)).alias("n")).select(F.lit("premises").alias("dataset"), "n").unionByName(
        store.load("jobs").agg(F.count(F.lit(1)).alias("n")).select(F.lit("jobs").alias("dataset"), "n")
    )
    return store.load_appended("runs").join(counts, "dataset").select(
        "dataset", "decision", "error", "n", F.col("start").alias("started_at"), F.col("end").alias("ended_at"), "duration_ms"
    )


# =========================================================================== oracles for the stateful queries
# The saved-list fold (WIN1 with removes) as a recursive SQL fold over each
# user's events in (ts, event_id) order: add = prepend + de-duplicate + cap at
# 10, remove = drop, clear = empty.
RECENTS_FOLD_SQL = """
WITH RECURSIVE ev AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
         CASE WHEN event_id % 47 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op,
         event_id % 1500 AS pid
  FROM events),
fold(user_id, k, lst) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ev
  UNION ALL
  SELECT f.user_id, e.k,
    CASE WHEN e.op = 'clear' THEN CAST([] AS BIGINT[])
         WHEN e.op = 'add' THEN list_slice(list_prepend(e.pid, list_filter(f.lst, lambda x: x <> e.pid)), 1, 10)
         ELSE list_filter(f.lst, lambda x: x <> e.pid) END
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.k = f.k + 1),
final AS (SELECT user_id, lst FROM fold WHERE (user_id, k) IN (SELECT user_id, max(k) FROM fold GROUP BY user_id))
SELECT user_id, CAST(i - 1 AS INTEGER) AS position, lst[i] AS pid
FROM final, unnest(range(1, len(lst) + 1)) AS t(i)
"""

# Two refresh runs over exported snapshots: first both datasets change and
# load every row, then both are unchanged.
ORACLES["chg2_chg3_refresh_runs"] = fx.oracle(
    """
SELECT d.dataset, r.decision, CAST(NULL AS VARCHAR) AS error, d.n,
  TIMESTAMP '2000-06-01 03:00:00' + to_seconds(d.k + r.k) AS started_at,
  TIMESTAMP '2000-06-01 03:00:00' + to_seconds(d.k + r.k + 1) AS ended_at, CAST(1000 AS BIGINT) AS duration_ms
FROM (SELECT 'premises' AS dataset, (SELECT count(*) FROM premises) AS n, 0 AS k
      UNION ALL SELECT 'jobs', (SELECT count(*) FROM jobs), 2) d,
     (SELECT 'changed' AS decision, 0 AS k UNION ALL SELECT 'unchanged', 5) r
"""
)


# =========================================================================== sinks over whole tables
@register(
    "snk7_export_documents",
    fx.oracle(
        """
SELECT id AS premises_id, 0 AS part, CAST(0 AS BIGINT) AS seq, 0 AS sub, 'Date,Bin' AS line FROM premises
UNION ALL
SELECT premises_id, 1, seq, 0, CAST(date AS VARCHAR) || ',' || bin FROM numbered
""",
        EXISTING_JOBS_SQL + ",\n" + NUMBERED_JOBS_SQL,
    ),
)
def q_export_documents(spark, sf_dir):
    """Bulk CSV feed export: line rows written range-sorted as Parquet, read back."""
    t = fx.load(spark, sf_dir)
    path = _scratch(spark, "feed-export")
    feeds.write_documents(feeds.csv_lines(t.premises, t.jobs), path)
    return spark.read.parquet(path)


@register(
    "snk11_sitemap_index_xml",
    fx.oracle(
        f"""
SELECT 0 AS part, CAST(0 AS BIGINT) AS pos,
  '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '  <sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || '  ' AS text
UNION ALL SELECT 2, 0, chr(10) || '</sitemapindex>' || chr(10) || '  '
UNION ALL SELECT 1, pos, xml
FROM (
  SELECT pos, chr(10) || '  <sitemap>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '    ' ||
    CASE WHEN lastmod IS NOT NULL THEN '<lastmod>' || lastmod || '</lastmod>' ELSE '' END ||
    chr(10) || '  </sitemap>' || chr(10) || '    ' AS xml
  FROM (
    SELECT CAST(0 AS BIGINT) AS pos, '{BASE}/sitemap.xml' AS loc, '2000-05-01T12:00:00.000Z' AS lastmod
    UNION ALL SELECT CAST(1 AS BIGINT), '{BASE}/docs/sitemap.xml', '2000-05-01T12:00:00.000Z'
    UNION ALL SELECT CAST(g + 2 AS BIGINT), '{BASE}/premises/sitemap/' || CAST(g AS VARCHAR) || '.xml', NULL
    FROM (SELECT unnest(range(CAST(ceil((SELECT count(*) FROM premises) / 50000) AS BIGINT))) AS g) r) e) x
"""
    ),
)
def q_sitemap_index_xml(spark, sf_dir):
    """The sitemap index as ordered rows of its XML text."""
    t = fx.load(spark, sf_dir)
    return feeds.sitemap_index_lines(feeds.sitemap_index_entries(t.premises, BUILD_TIME, BASE))


@register("win1_recents_fold_batch", RECENTS_FOLD_SQL)
def q_recents_fold_batch(spark, sf_dir):
    """WIN1 with removes as an exact batch plan (no per-user task)."""
    from kerbside.operators.recents import recents_fold

    return recents_fold(fx.recents_log(spark, sf_dir))


_NESTED_SQL = """
nested AS (
  SELECT r.premises_id AS id, count(j.id) AS n,
    coalesce(string_agg(CAST(j.date AS VARCHAR) || ' ' || j.bin, ';' ORDER BY j.date, j.bin, j.id), '') AS jobs,
    coalesce(string_agg(CAST(j.date AS VARCHAR) || ' ' || CASE WHEN j.date < DATE '2000-06-01' THEN 'Expired'
      WHEN j.date > DATE '2000-06-01' THEN 'Upcoming' ELSE 'Today' END, ';' ORDER BY j.date, j.bin, j.id), '') AS statuses,
    min(CASE WHEN j.date >= DATE '2000-06-01' THEN j.date END) AS next_date
  FROM requests r JOIN premises p ON p.id = r.premises_id LEFT JOIN jobs j ON j.premises_id = r.premises_id
  GROUP BY r.premises_id)
"""


@register(
    "join2_arr1_nested_jobs",
    fx.oracle("SELECT id, n, jobs, statuses, next_date FROM nested", ID_REQUESTS_SQL + "," + _NESTED_SQL),
)
def q_nested_jobs(spark, sf_dir):
    """The nested answer of every requested premises, with the array steps:
    map (status of each job) and find (first job from today on)."""
    t = fx.load(spark, sf_dir)
    nested = LK.premises_with_jobs(t.premises, t.jobs, id_requests(t))
    seen = LK.first_upcoming(LK.jobs_with_status(nested, AS_OF), AS_OF)
    show = lambda x, f: F.concat_ws(" ", x["date"].cast("string"), x[f])
    return seen.select(
        "id",
        F.size("jobs").cast("long").alias("n"),
        F.array_join(F.transform("jobs", lambda x: show(x, "bin")), ";").alias("jobs"),
        F.array_join(F.transform("jobs", lambda x: show(x, "status")), ";").alias("statuses"),
        F.col("next_job.date").alias("next_date"),
    )


@register(
    "fil8_validate_postcode_requests",
    fx.oracle(
        """
SELECT id AS request_id, address_postcode AS postcode,
  CASE WHEN address_postcode IS NULL THEN 'postcode: required' END AS error
FROM premises
"""
    ),
)
def q_validate_postcode_requests(spark, sf_dir):
    """One postcode search request per premises (missing postcodes are errors)."""
    t = fx.load(spark, sf_dir)
    raw = t.premises.select(F.col("id").alias("request_id"), F.col("address_postcode").alias("postcode"))
    return LK.validate_postcode_requests(raw)
