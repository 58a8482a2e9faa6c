"""Address text functions (STR1-8, STR12): Column → Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bins the product knows, in preferred display order, and
# their style classes (list view / calendar dot).
PREFERRED_BIN_ORDER = ["BLACK", "GREEN", "BROWN"]
BIN_LIST_CLASS = {
    "BLACK": "bg-gray-900 text-gray-50",
    "GREEN": "bg-green-700 text-gray-50",
    "BROWN": "bg-amber-900 text-gray-50",
}
BIN_DOT_CLASS = {
    "BLACK": "bg-gray-900/90",
    "BROWN": "bg-amber-900/90",
    "GREEN": "bg-green-600/90",
}

PARTS = ["address_room", "address_number", "address_street", "address_locality", "address_city", "address_postcode"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """A part that counts: NULL and '' both drop out of joined text (V6)."""
    return F.nullif(_c(c), F.lit(""))


def capital_case(c: Column | str) -> Column:
    """STR6: words split at lower/digit→Upper and Upper→Upper+lower boundaries,
    runs of non-letter/non-digit become one separator, each word capitalised.

    ``12A`` → ``12 A``; ``ST. JOHN'S`` → ``St John S``; NULL stays NULL.
    """
    s = _c(c)
    s = F.regexp_replace(s, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    s = F.regexp_replace(s, r"[^\p{L}0-9]+", " ")
    return F.initcap(F.trim(s))


def normalize_postcode(c: Column | str) -> Column:
    """STR8: upper-case and drop U+0020 spaces (the search key form)."""
    return F.replace(F.upper(_c(c)), F.lit(" "), F.lit(""))


def leading_int(c: Column | str) -> Column:
    """STR7: integer prefix like JS parseInt; NULL, '' or no digits → 0."""
    digits = F.regexp_extract(_c(c), r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def _join(sep: str, parts: list[Column]) -> Column:
    return F.concat_ws(sep, *[present(p) for p in parts])


def full_address(prefix: str = "") -> Column:
    """STR1: the six parts joined by newlines."""
    return _join("\n", [F.col(prefix + p) for p in PARTS])


def presentable_address(prefix: str = "") -> Column:
    """STR2: capital-cased parts and an upper-cased postcode, newline-joined;
    emptiness is tested after casing."""
    cased = [capital_case(F.col(prefix + p)) for p in PARTS[:5]] + [F.upper(F.col(prefix + PARTS[5]))]
    return _join("\n", cased)


def one_line_address(prefix: str = "") -> Column:
    """STR3: the six parts joined by ', '."""
    return _join(", ", [F.col(prefix + p) for p in PARTS])


def summary_address(prefix: str = "") -> Column:
    """STR4: room, number and street joined by spaces."""
    return _join(" ", [F.col(prefix + p) for p in PARTS[:3]])


def two_line_address(prefix: str = "") -> Column:
    """STR5: space-joined, with a literal newline element between street and
    locality (so line 1 ends and line 2 starts with a space)."""
    first = [capital_case(F.col(prefix + p)) for p in PARTS[:3]]
    second = [capital_case(F.col(prefix + p)) for p in PARTS[3:5]] + [F.upper(F.col(prefix + PARTS[5]))]
    return _join(" ", first + [F.lit("\n")] + second)


def two_line_split(c: Column | str) -> tuple[Column, Column]:
    """STR5 lines: the text before and after the first newline."""
    s = _c(c)
    return F.split_part(s, F.lit("\n"), F.lit(1)), F.split_part(s, F.lit("\n"), F.lit(2))


def bin_order(bin_col: Column | str) -> Column:
    """V9: index in the preferred order; unknown bins are -1 (so first)."""
    return (F.array_position(F.array(*[F.lit(b) for b in PREFERRED_BIN_ORDER]), _c(bin_col)) - 1).cast("int")


def is_supported_bin(bin_col: Column | str) -> Column:
    return _c(bin_col).isin(PREFERRED_BIN_ORDER)


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def bin_list_class(bin_col: Column | str) -> Column:
    """STR12: style class of a bin card; unknown bins get '' but keep their slot."""
    return F.coalesce(F.try_element_at(_map(BIN_LIST_CLASS), _c(bin_col)), F.lit(""))


def bin_dot_class(bin_col: Column | str) -> Column:
    """STR12: calendar dot class; unknown bins get ''."""
    return F.coalesce(F.try_element_at(_map(BIN_DOT_CLASS), _c(bin_col)), F.lit(""))
