"""Snapshot ingest: CSV/JSON sources and the typing/cleaning steps (SRC1-3, SRC5, ING1-9).

The CSV route reads raw *lines* with ``spark.read.text`` (files split across
many tasks), cleans each line, then parses it with ``from_csv``.  Cleaning on
the line is what lets NUL bytes in front of a quote parse at all.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside import schemas
from kerbside.functions.dates import ts_lit

INT_PATTERN = "^[+-]?[0-9]+$"
INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1


# --------------------------------------------------------------------------- lines
def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ING2: split on LF only; a final line without newline is kept."""
    return spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))


LOAD_KEY = ["file", "block", "row"]


def lines_in_order(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``lines`` with the place of each: its file, the start of its split, and a
    number that increases inside the split."""
    raw = lines(spark, paths)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def dedupe_lines(raw: DataFrame) -> DataFrame:
    """ING5: identical raw lines keep one, the first in load order where lines
    have a place (legacy jobs path, before NUL stripping)."""
    if not set(LOAD_KEY) <= set(raw.columns):
        return raw.dropDuplicates(["value"])
    return raw.groupBy("value").agg(F.min(F.struct(*LOAD_KEY)).alias("_first")).select("value", "_first.*")


def strip_nul(raw: DataFrame) -> DataFrame:
    """ING1: drop every NUL byte from the raw line."""
    return raw.withColumn("value", F.translate("value", "\u0000", ""))


def strip_cr(raw: DataFrame) -> DataFrame:
    """ING2: strip one trailing CR (a CR inside the line survives)."""
    return raw.withColumn("value", F.regexp_replace("value", "\r$", ""))


def parse_csv_lines(clean: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Parse comma/double-quote CSV lines into text columns; blank lines are
    skipped, other columns stay.

    Strict mode (FAILFAST) raises on ragged rows and unterminated quotes, as the
    reference's importer aborts.  Empty fields come back as '' (V2).
    """
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "escape": '"', "quote": '"', "sep": ","}
    others = [c for c in clean.columns if c != "value"]
    parsed = clean.where(F.col("value") != "").select(*others, F.from_csv("value", schema.simpleString(), options).alias("_r"))
    return parsed.select(*others, *[F.coalesce(F.col(f"_r.{c}"), F.lit("")).alias(c) for c in columns])


def _outside_quotes(value: Column) -> Column:
    """The line without its quoted fields' contents.  Doubled quotes go first;
    a quote opens a field only at the field's start, and elsewhere it is an
    ordinary character.  The possessive loop needs no stack, so a field of any
    length is read."""
    single = F.regexp_replace(value, '""', "")
    return F.regexp_replace(single, '(^|,)"[^"]*+"', "$1")


def _field_count_check(clean: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise on rows whose field count differs from the schema, or with a
    field that opens a quote and never closes it.

    The check is folded into the ``value`` column itself, so every parse of
    the line depends on it and column pruning cannot drop it.  Commas inside
    double-quoted sections (doubled quotes allowed) do not count.
    """
    n = len(columns)
    value = F.col("value")
    unquoted = _outside_quotes(value)
    fields = F.length(unquoted) - F.length(F.regexp_replace(unquoted, ",", "")) + 1
    open_quote = unquoted.rlike('(^|,)"')
    checked = (
        F.when(open_quote, F.raise_error(F.concat(F.lit("unterminated quote in line: "), value)))
        .when(fields != n, F.raise_error(F.concat(F.lit(f"expected {n} fields in line: "), value)))
        .otherwise(value)
    )
    return clean.where(value != "").withColumn("value", checked)


def read_csv_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    dedupe: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Raw CSV route shared by SRC1/SRC2: lines → ING5? → ING1 → ING2 → parse."""
    return csv_from_lines(lines(spark, paths), columns, dedupe=dedupe, strict=strict)


def csv_from_lines(raw: DataFrame, columns: Sequence[str], dedupe: bool = False, strict: bool = True) -> DataFrame:
    """The CSV route on a DataFrame of raw lines (column ``value``); the place
    of a line (``LOAD_KEY``) stays with it."""
    raw = raw.select("value", *[c for c in LOAD_KEY if c in raw.columns])
    if dedupe:
        raw = dedupe_lines(raw)
    clean = strip_cr(strip_nul(raw))
    if strict:
        clean = _field_count_check(clean, columns)
    return parse_csv_lines(clean, columns, strict=strict)


# --------------------------------------------------------------------------- typing
def strict_int(c: Column, name: str) -> Column:
    """ING3: signed decimal digits only, within the 32-bit column range; else raise."""
    ok = c.rlike(INT_PATTERN)
    wide = F.when(ok, c.try_cast("decimal(38,0)"))
    in_range = wide.between(F.lit(INT32_MIN), F.lit(INT32_MAX))
    return F.when(ok & in_range, wide.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid integer for {name}: '"), c, F.lit("'")))
    )


def parse_dmy(c: Column) -> Column:
    """ING4: day-first two-digit-year date; years 70-99 are 19xx, 00-69 are 20xx.

    Returns NULL for text that is not such a date.
    """
    strict = c.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$")
    d = F.when(strict, F.try_to_timestamp(c, F.lit("d/M/yy")).cast("date"))
    return F.when(F.year(d) >= 2070, F.add_months(d, -1200)).otherwise(d)


def strict_dmy(c: Column, name: str) -> Column:
    d = parse_dmy(c)
    return F.when(d.isNotNull(), d).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid date for {name}: '"), c, F.lit("'")))
    )


def null_if_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ING6: '' → NULL on the given columns only."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in cols else F.col(c) for c in df.columns])


def with_search_postcode(df: DataFrame) -> DataFrame:
    """ING7: search key = upper-cased postcode without U+0020 spaces.

    Computed on scanned text before ING6, so an empty postcode gives ''.
    """
    return df.withColumn(
        "search_postcode", F.upper(F.replace(F.coalesce(F.col("address_postcode"), F.lit("")), F.lit(" "), F.lit("")))
    )


def split_offsets(placed: DataFrame) -> DataFrame:
    """(file, block, base): what to subtract from ``row`` so that a split's lines
    go on counting where the split before it ends; files in the order of their
    names.  One row per split, from a scan that parses nothing."""
    splits = placed.groupBy("file", "block").agg(F.min("row").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "block", (F.col("_low") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("base"))


def with_job_id(df: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """ING8: surrogate id in load order, from 1: the line's number over all
    files (a skipped line leaves a gap).  ``df`` and ``placed``, the lines it
    comes from, have their places; without them ids follow partitions."""
    if placed is None:
        return df.withColumn("id", F.monotonically_increasing_id())
    offsets = split_offsets(placed)
    return df.join(offsets, ["file", "block"]).withColumn("id", F.col("row") - F.col("base") + 1).drop(*LOAD_KEY, "base")


def with_load_ts(df: DataFrame, load_ts: dt.datetime) -> DataFrame:
    """ING9: created_at / updated_at are the load instant on every reload."""
    ts = ts_lit(load_ts)
    return df.withColumn("created_at", ts).withColumn("updated_at", ts)


# --------------------------------------------------------------------------- sources
def read_premises_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    load_ts: dt.datetime,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """SRC1 (+ ING1-3, ING6, ING7, ING9): the premises snapshot, staged and typed.

    Validation errors surface when the staged rows are written (SNK1 writes
    every column, so no check is pruned away).
    """
    return premises_from_lines(lines(spark, paths), load_ts, names)


def premises_from_lines(raw: DataFrame, load_ts: dt.datetime, names: Sequence[str] | None = None) -> DataFrame:
    """SRC1 on a DataFrame of raw lines."""
    text = csv_from_lines(raw, schemas.PREMISES_CSV_COLUMNS)
    typed = text.select(strict_int(F.col("id"), "id").alias("id"), *schemas.ADDRESS_COLUMNS)
    staged = with_load_ts(null_if_empty(with_search_postcode(typed), schemas.ADDRESS_COLUMNS), load_ts)
    if names is not None:  # SRC5: alternate column names of the same file
        return staged.select(*[F.col(src).alias(dst) for src, dst in zip(schemas.PREMISES_CSV_COLUMNS, names)])
    return staged


def read_jobs_csv(spark: SparkSession, paths: str | Sequence[str], dedupe: bool = False) -> DataFrame:
    """SRC2 (+ ING1-4, ING8): the jobs snapshot; '' bins stay ''."""
    return jobs_from_lines(lines_in_order(spark, paths), dedupe=dedupe)


def jobs_from_lines(raw: DataFrame, dedupe: bool = False) -> DataFrame:
    """SRC2 on a DataFrame of raw lines, with or without their places."""
    text = csv_from_lines(raw, schemas.JOBS_CSV_COLUMNS, dedupe=dedupe)
    known = set(LOAD_KEY) <= set(raw.columns)
    typed = text.select(
        *(LOAD_KEY if known else []),
        strict_int(F.col("premises_id"), "premises_id").alias("premises_id"),
        F.col("bin"),
        strict_dmy(F.col("date"), "date").alias("date"),
    )
    return with_job_id(typed, raw if known else None).select("id", "premises_id", "bin", "date")


def read_sqlite_premises(spark: SparkSession, paths: str | Sequence[str], load_ts: dt.datetime) -> DataFrame:
    """SRC5: the premises file under the SQLite loader's column names."""
    return read_premises_csv(spark, paths, load_ts, names=schemas.SQLITE_PREMISES_COLUMNS)


def read_geocodes(
    spark: SparkSession,
    paths: str | Sequence[str],
    on_invalid: str = "raise",
    multi_line: bool = True,
    require_distance: bool = False,
) -> DataFrame:
    """SRC3: flatten geocode documents to (postcode, longitude, latitude, distance).

    Every field but ``distance`` is required (that one too with
    ``require_distance``); one bad element rejects its whole document.  A body
    with status 404 and no ``result`` is an empty list; a corrupt document, or
    any other body without ``result``, is invalid.  ``on_invalid='raise'``
    fails the job, ``'drop'`` skips the document.
    ``multi_line=True`` reads one document per file (a saved response body);
    ``False`` reads JSON Lines, one document per line (bulk archives).
    """
    schema = T.StructType([*schemas.GEOCODE_DOCUMENT.fields, T.StructField("_corrupt", T.StringType(), True)])
    docs = (
        spark.read.schema(schema)
        .option("multiLine", "true" if multi_line else "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(paths if isinstance(paths, str) else list(paths))
        .withColumn("_doc", F.input_file_name())
    )
    result = F.coalesce(F.col("result"), F.array().cast(T.ArrayType(schemas.GEOCODE_ELEMENT)))
    needed = ("postcode", "longitude", "latitude", *(["distance"] if require_distance else []))
    whole = F.forall(
        result, lambda e: functools.reduce(lambda a, b: a & b, [e.isNotNull(), *(e[c].isNotNull() for c in needed)])
    )
    answered = F.col("result").isNotNull() | F.coalesce(F.col("status") == 404, F.lit(False))
    valid = F.col("_corrupt").isNull() & answered & whole
    checked = docs.select("_doc", result.alias("result"), valid.alias("_valid"))
    if on_invalid == "raise":
        checked = checked.select(
            "_doc",
            F.when(F.col("_valid"), F.col("result"))
            .otherwise(F.raise_error(F.concat(F.lit("invalid geocode document: "), F.col("_doc"))))
            .alias("result"),
        )
    elif on_invalid == "drop":
        checked = checked.where("_valid").select("_doc", "result")
    else:
        raise ValueError("on_invalid must be 'raise' or 'drop'")
    return checked.select(F.explode("result").alias("e")).select(
        F.col("e.postcode").alias("postcode"),
        F.col("e.longitude").alias("longitude"),
        F.col("e.latitude").alias("latitude"),
        F.col("e.distance").alias("distance"),
    )


# --------------------------------------------------------------------------- diagnostics
def bad_lines(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """Every line the strict readers would reject, with the first reason, instead
    of aborting on the first one: (file, value, reason).

    ``kind``: 'premises' or 'jobs'.  Reasons: 'unterminated quote', 'field
    count', 'integer <column>', 'date'.
    """
    columns = schemas.PREMISES_CSV_COLUMNS if kind == "premises" else schemas.JOBS_CSV_COLUMNS
    raw = lines(spark, paths).select("value", F.input_file_name().alias("file"))
    clean = raw.select(F.regexp_replace(F.translate("value", "\u0000", ""), "\r$", "").alias("value"), "file").where(
        F.col("value") != ""
    )
    unquoted = _outside_quotes(F.col("value"))
    fields = F.length(unquoted) - F.length(F.regexp_replace(unquoted, ",", "")) + 1
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    parsed = F.from_csv(F.col("value"), schema.simpleString(), {"mode": "PERMISSIVE", "escape": '"', "quote": '"', "sep": ","})
    first_int = columns[0]
    int_text = F.coalesce(parsed[first_int], F.lit(""))
    int_ok = int_text.rlike(INT_PATTERN) & int_text.try_cast("decimal(38,0)").between(F.lit(INT32_MIN), F.lit(INT32_MAX))
    reason = (
        F.when(unquoted.rlike('(^|,)"'), F.lit("unterminated quote"))
        .when(fields != len(columns), F.lit("field count"))
        .when(~F.coalesce(int_ok, F.lit(False)), F.lit(f"integer {first_int}"))
    )
    if kind == "jobs":
        reason = reason.when(parse_dmy(F.coalesce(parsed["date"], F.lit(""))).isNull(), F.lit("date"))
    return clean.select("file", "value", reason.alias("reason")).where(F.col("reason").isNotNull())
