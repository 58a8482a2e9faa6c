"""Set-oriented lookups (FIL1-3, FIL8-9, PRJ1, JOIN1-2, SRT1-3, LIM1-2, AGG1).

Every lookup takes a request DataFrame and answers all requests in one job.
Requests are joined to the tables; Catalyst/AQE choose broadcast or
sort-merge at run time, and AQE splits a skewed (hot) key.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.address import leading_int, normalize_postcode
from kerbside.plans.ordering import sequence_within
from kerbside.schemas import RESULT_NAMES

# The result formats.
RESULT_FORMATS = ["json", "csv", "ical"]

SLICE_ROWS = 1_000_000  # premises of one postcode that a join task is given at most, on average


def premises_result_columns(prefix: str = "") -> list[Column]:
    """PRJ1: id, six address parts, updatedAt under their camelCase names."""
    return [F.col(prefix + src).alias(dst) for src, dst in RESULT_NAMES.items()]


# --------------------------------------------------------------------------- FIL1 + SRT1/SRT2
def hot_postcodes(premises: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(search_postcode, slices) of the postcodes with more than ``slice_rows``
    premises: at most one row for every ``slice_rows`` premises.  Counting reads
    one column; a store may keep the answer and hand it to ``search_premises``."""
    counts = premises.where(F.col("search_postcode").isNotNull()).groupBy("search_postcode").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > slice_rows).select("search_postcode", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))


def _search_hits(premises: DataFrame, req: DataFrame, hot: DataFrame) -> DataFrame:
    """Requests (with ``_key``) joined to the premises of that key.  The premises
    of a hot postcode are dealt over its slices by a hash of their id, and each
    request for it is repeated once per slice, so no task meets the whole of it."""
    hot = F.broadcast(hot.select(F.col("search_postcode").alias("_hot"), F.col("slices").alias("_slices")))
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    asked = req.join(hot, F.col("_key") == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), slices - 1)))
    stored = (
        premises.select("id", *[c for c in RESULT_NAMES if c != "id"], "search_postcode")
        .join(hot, F.col("search_postcode") == F.col("_hot"), "left")
        .withColumn("_slice", F.pmod(F.xxhash64("id"), slices).cast("int"))
        .drop("_hot", "_slices")
    )
    return (
        asked.drop("_hot", "_slices")
        .join(stored, (F.col("_key") == F.col("search_postcode")) & (F.col("_part") == F.col("_slice")))
        .drop("_key", "search_postcode", "_part", "_slice")
    )


def search_premises(
    premises: DataFrame,
    requests: DataFrame,
    postcode_col: str = "postcode",
    by_number: bool = True,
    trim: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Premises whose search key equals each request's normalised postcode.

    Returns one row per (request, hit) with ``rank`` (0-based) in result order:
    leading integer of the house number (SRT2), then room, number, street, id
    with NULLs last (SRT1); ``by_number=False`` leaves the plain text order.
    ``trim=True`` adds the web form's trimming.  ``hot`` is the stored answer of
    ``hot_postcodes``; without it the premises are counted here.
    """
    raw = F.col(postcode_col)
    key = normalize_postcode(F.trim(raw) if trim else raw)
    req = requests.withColumn("_key", key)
    if trim:
        req = req.where(F.length(F.trim(raw)) >= 1)
    hits = _search_hits(premises, req, hot if hot is not None else hot_postcodes(premises))
    sorter = leading_int("address_number") if by_number else F.lit(0).cast("decimal(38,0)")
    keyed = hits.withColumn("_sorter", sorter)
    ranked = sequence_within(
        keyed,
        ["request_id"],
        [
            F.col("_sorter").asc(),
            F.col("address_room").asc_nulls_last(),
            F.col("address_number").asc_nulls_last(),
            F.col("address_street").asc_nulls_last(),
            F.col("id").asc(),
        ],
        out="rank",
    )
    req_cols = [c for c in requests.columns]
    return ranked.select(*req_cols, "rank", *premises_result_columns())


# --------------------------------------------------------------------------- FIL2
def premises_by_id(premises: DataFrame, requests: DataFrame, id_col: str = "premises_id") -> DataFrame:
    """First (only) premises with the requested id, or a not-found row."""
    p = premises.select(*[F.col(c).alias(f"_p_{c}") for c in RESULT_NAMES])
    joined = requests.join(p, F.col(id_col) == F.col("_p_id"), "left")
    return joined.select(
        *requests.columns,
        F.col("_p_id").isNotNull().alias("found"),
        *[F.col(f"_p_{src}").alias(dst) for src, dst in RESULT_NAMES.items()],
    )


# --------------------------------------------------------------------------- FIL3 + JOIN1 + AGG1
def postcode_jobs(
    premises: DataFrame,
    jobs: DataFrame,
    requests: DataFrame,
    postcode_col: str = "postcode",
) -> DataFrame:
    """Distinct (postcode, date, bin) of the jobs of premises in each request's
    postcode list (exact, case-sensitive spaced postcode), however long.

    The premises are cut down to requested postcodes *before* the jobs join,
    so the large jobs table only meets matching premises ids; (postcode,
    date, bin) is made distinct once, before it fans out to the requests
    (partial aggregation absorbs a hot postcode), and the fan-out join then
    yields distinct rows by construction.
    """
    wanted = requests.select("request_id", F.col(postcode_col).alias("_rq")).distinct()
    pj = postcode_job_set(premises, jobs, wanted.select(F.col("_rq").alias("postcode")))
    matched = wanted.join(pj, F.col("_rq") == F.col("postcode"))
    return matched.select("request_id", "postcode", "date", "bin")


def postcode_job_set(premises: DataFrame, jobs: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Distinct (postcode, date, bin) of the jobs of premises at the given
    postcodes; the distinct runs once, before any fan-out to requests."""
    return jobs_at_postcodes(premises, jobs, postcodes).dropDuplicates(["postcode", "date", "bin"])


def jobs_at_postcodes(premises: DataFrame, jobs: DataFrame, postcodes: DataFrame) -> DataFrame:
    """(postcode, date, bin) of every job of premises at the given postcodes.
    Premises are cut to those postcodes before the jobs join."""
    wanted = premises.select("id", "address_postcode").join(
        postcodes.select(F.col("postcode").alias("_pc")).distinct(), F.col("address_postcode") == F.col("_pc"), "left_semi"
    )
    return wanted.join(jobs.select("premises_id", "bin", "date"), F.col("id") == F.col("premises_id")).select(
        F.col("address_postcode").alias("postcode"), "date", "bin"
    )


# --------------------------------------------------------------------------- JOIN2
def premises_with_jobs(premises: DataFrame, jobs: DataFrame, requests: DataFrame | None = None, id_col: str = "premises_id") -> DataFrame:
    """Nested result: premises fields + ``jobs`` array<struct<date,bin>> in
    (date, bin, id) order; no jobs → ``[]``.

    With ``requests`` the jobs are cut to the requested premises first, so each
    array is bounded by one request's answer.  Bulk exports of every premises
    use the line-document feeds in ``plans.feeds`` instead, which never hold a
    premises' jobs in one row.
    """
    p = premises
    j = jobs.select("premises_id", "bin", "date", F.col("id").alias("_jid"))
    if requests is not None:
        ids = requests.select(F.col(id_col).alias("_rid")).distinct()
        p = p.join(ids, F.col("id") == F.col("_rid"), "left_semi")
        j = j.join(ids, F.col("premises_id") == F.col("_rid"), "left_semi")
    nested = j.groupBy("premises_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("date", "bin", "_jid"))),
            lambda x: F.struct(x["date"].alias("date"), x["bin"].alias("bin")),
        ).alias("jobs")
    )
    empty = F.array().cast("array<struct<date:date,bin:string>>")
    return p.join(nested, F.col("id") == F.col("premises_id"), "left").select(
        *premises_result_columns(), F.coalesce(F.col("jobs"), empty).alias("jobs")
    )


# --------------------------------------------------------------------------- LIM1 / LIM2
def random_premises(premises: DataFrame, k: int = 1, seed: int | None = None) -> DataFrame:
    """k uniformly random premises (id, addressPostcode): a top-k by a hash of
    (seed, id) (TakeOrderedAndProject), never a full sort.  The same seed picks
    the same premises anywhere; without one every call draws its own."""
    seed = random.getrandbits(62) if seed is None else seed
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return premises.select("id", F.col("address_postcode").alias("addressPostcode")).orderBy(key, "id").limit(k)


# --------------------------------------------------------------------------- FIL8 / FIL9
def validate_job_requests(raw: DataFrame, premises_col: str = "premises", format_col: str = "format") -> DataFrame:
    """FIL8 for the jobs feed: premises must be integer text, format one of
    json/csv/ical (default json).  Adds ``premises_id``, ``format`` and ``error``
    (NULL when valid); nothing raises."""
    text = F.trim(F.col(premises_col))
    pid = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    fmt = F.coalesce(F.col(format_col), F.lit("json"))
    error = (
        F.when(pid.isNull(), F.lit("premises: expected a number"))
        .when(~fmt.isin(RESULT_FORMATS), F.lit("format: expected one of json, csv, ical"))
    )
    others = [c for c in raw.columns if c not in (premises_col, format_col)]
    return raw.select(*others, pid.alias("premises_id"), fmt.alias("format"), error.alias("error"))


def validate_postcode_requests(raw: DataFrame, postcode_col: str = "postcode") -> DataFrame:
    """FIL8 for the premises search: a postcode string is required (any text,
    even empty); a missing one is an error row."""
    others = [c for c in raw.columns if c != postcode_col]
    return raw.select(
        *others,
        F.col(postcode_col).alias("postcode"),
        F.when(F.col(postcode_col).isNull(), F.lit("postcode: required")).alias("error"),
    )


def validate_tool_ids(raw: DataFrame, id_col: str = "premisesId") -> DataFrame:
    """FIL8 for the tool inputs: an integer ≥ 0, else an error row."""
    v = F.col(id_col)
    as_long = v.try_cast("long")
    ok = as_long.isNotNull() & (as_long >= 0) & (as_long == v.try_cast("double"))
    others = [c for c in raw.columns if c != id_col]
    return raw.select(
        *others,
        F.when(ok, as_long).alias("premises_id"),
        F.when(~ok | v.isNull(), F.lit("premisesId: expected a non-negative integer")).alias("error"),
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where(F.col("error").isNull()), validated.where(F.col("error").isNotNull())


def miss_postcode_message(postcode: Column) -> Column:
    """FIL9 for a postcode search with no hit."""
    return F.concat(F.lit("No address matching with postcode "), postcode, F.lit(" found"))


def miss_id_message(premises_id: Column) -> Column:
    """FIL9 for an unknown premises id."""
    return F.concat(F.lit("Address not found (bad premisesId of "), premises_id.cast("string"), F.lit(")"))


# --------------------------------------------------------------------------- ARR1
def jobs_with_status(nested: DataFrame, as_of, jobs_col: str = "jobs") -> DataFrame:
    """ARR1 map: each nested job gains its DAT1 status (``transform``)."""
    from kerbside.functions.dates import as_date

    today = as_date(as_of)
    status = lambda d: F.when(d < today, "Expired").when(d > today, "Upcoming").otherwise("Today")
    return nested.withColumn(
        jobs_col,
        F.transform(jobs_col, lambda j: F.struct(j["date"].alias("date"), j["bin"].alias("bin"), status(j["date"]).alias("status"))),
    )


def first_upcoming(nested: DataFrame, as_of, jobs_col: str = "jobs") -> DataFrame:
    """ARR1 find: the first nested job on or after today, or NULL (``filter`` +
    ``element_at`` on the already ordered array)."""
    from kerbside.functions.dates import as_date

    today = as_date(as_of)
    return nested.withColumn("next_job", F.try_element_at(F.filter(jobs_col, lambda j: j["date"] >= today), F.lit(1)))


def jobs_of_postcode(nested: DataFrame, postcode_col: str = "postcode", jobs_col: str = "jobs") -> DataFrame:
    """ARR1 filter: keep the nested jobs whose postcode is the row's postcode."""
    return nested.withColumn(jobs_col, F.filter(jobs_col, lambda j: j["postcode"] == F.col(postcode_col)))
