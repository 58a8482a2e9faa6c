"""URL and message text (STR9-11) and iCalendar text escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.address import capital_case, one_line_address, summary_address

# Base address of the site; a deployment passes its own.
DEFAULT_BASE_URL = "https://example.org"


def _s(c: Column) -> Column:
    return c.cast("string")


def premises_url(id_col: Column | str, base_url: str = DEFAULT_BASE_URL) -> Column:
    """STR9: the premises permalink."""
    return F.concat(F.lit(f"{base_url}/premises/"), _s(F.col(id_col) if isinstance(id_col, str) else id_col))


def event_url(id_col: Column | str, date_col: Column | str, bin_col: Column | str, base_url: str = DEFAULT_BASE_URL) -> Column:
    """STR9: permalink with ``?date=…&bin=…`` (values not escaped)."""
    return F.concat(premises_url(id_col, base_url), F.lit("?date="), _s(F.col(date_col)), F.lit("&bin="), F.col(bin_col))


def ical_feed_url(id_col: Column | str, base_url: str = DEFAULT_BASE_URL) -> Column:
    """STR9: the calendar subscription url of a premises."""
    return F.concat(F.lit(f"{base_url}/api/jobs?premises="), _s(F.col(id_col)), F.lit("&format=ical"))


def premises_line(prefix: str = "") -> Column:
    """STR10: ``{id}: {one line address}``."""
    return F.concat(_s(F.col(prefix + "id")), F.lit(": "), one_line_address(prefix))


def job_line(date_col: Column | str, status: Column, bin_col: Column | str) -> Column:
    """STR10: ``{date} ({status}): {bin} bin``."""
    return F.concat(_s(F.col(date_col)), F.lit(" ("), status, F.lit("): "), F.col(bin_col), F.lit(" bin"))


def page_title(prefix: str = "") -> Column:
    """STR11: ``Bin Days for {capitalCase(summary)} at {postcode}``; a missing
    postcode prints as ``null``."""
    return F.concat(
        F.lit("Bin Days for "),
        capital_case(summary_address(prefix)),
        F.lit(" at "),
        F.coalesce(F.col(prefix + "address_postcode"), F.lit("null")),
    )


def page_description(prefix: str = "") -> Column:
    """STR11: the page description text."""
    return F.concat(
        F.lit("View the scheduled bin collection days for "),
        capital_case(summary_address(prefix)),
        F.lit(" at "),
        F.coalesce(F.col(prefix + "address_postcode"), F.lit("null")),
    )


def ical_escape(c: Column) -> Column:
    """RFC 5545 TEXT escaping: backslash, semicolon, comma, newline."""
    s = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit(";"), F.lit("\\;"))
    s = F.replace(s, F.lit(","), F.lit("\\,"))
    s = F.replace(s, F.lit("\r\n"), F.lit("\\n"))
    return F.replace(s, F.lit("\n"), F.lit("\\n"))


def ical_fold(c: Column) -> Column:
    """RFC 5545 line folding: no physical line longer than 75 octets (UTF-8);
    a continued line starts with one space, which counts.  Characters are
    never split: non-ASCII text longer than 75 octets is walked code point by
    code point (``aggregate``); ASCII text is folded by a regex."""
    chars = F.regexp_extract_all(c, F.lit("(?s)(.)"), 1)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, ch: Column) -> Column:
        size = F.octet_length(ch)
        wrap = acc["n"] + size > 75
        return F.struct(
            F.when(wrap, F.concat(acc["out"], F.lit("\r\n "), ch)).otherwise(F.concat(acc["out"], ch)).alias("out"),
            F.when(wrap, size + 1).otherwise(acc["n"] + size).alias("n"),
        )

    folded = F.aggregate(chars, start, step, lambda acc: acc["out"])
    # ASCII text (one octet per character): the same folding by regex
    ascii_tail = F.regexp_replace(F.regexp_replace(F.substring(c, 76, 1 << 30), "(.{74})", "$1\r\n "), "\r\n $", "")
    ascii_folded = F.concat(F.substring(c, 1, 75), F.lit("\r\n "), ascii_tail)
    octets = F.octet_length(c)
    return F.when(octets <= 75, c).when(octets == F.length(c), ascii_folded).otherwise(folded)
