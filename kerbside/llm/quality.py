"""Quality rules, line first: failing lines are removed, then documents that
lose too much text are rejected.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_RUN = "[ \\t-\\r]+"
NOT_WHITE = "[^ \\t-\\r]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50

SENTENCE_MARK = "[.!?…。！？؟।]"
NAVIGATION = "|»›•·"
MIN_SEPARATORS = 3
MAX_SYMBOL_PERCENT = 10  # symbols for each hundred words of a line
SEARCHED = 64  # up to so many repeated windows are looked up, more are found by sorting
BOILERPLATE_CHARS = 300  # a boilerplate phrase condemns only lines shorter than this
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
)


def _count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` among ``chars``."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_RUN), "")


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules of one line with a word.

    * punctuation: it has a sentence mark somewhere, and few symbols;
    * navigation: fewer than three menu separators;
    * boilerplate: a short line has none of the phrases.
    """
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return (
        line.rlike(SENTENCE_MARK)
        & (_count_of(line, SYMBOLS) * 100 <= n_words * MAX_SYMBOL_PERCENT)
        & (_count_of(line, NAVIGATION) < MIN_SEPARATORS)
        & ~((F.length(line) < BOILERPLATE_CHARS) & line.rlike("(?i)" + "|".join(BOILERPLATE)))
    )


def _twice(hashes: Column, in_order: Column) -> Column:
    """Values that occur twice or more; ``in_order`` is ``hashes`` sorted."""
    return F.array_distinct(F.filter(in_order, lambda x, i: x == F.get(in_order, i - 1)))


def _covered(places: Column) -> Column:
    """Words that 3-word windows at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def _places_by_search(hashes: Column, twice: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, F.get(hashes, i)))


def _places_by_sort(hashes: Column) -> Column:
    """Sorting (window, place) brings equal windows together; each is compared
    with its neighbours through two shifted copies, in one pass."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    flagged = F.filter(
        F.zip_with(
            F.zip_with(placed, F.slice(placed, F.lit(2), F.size(placed)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), placed),
            lambda x, before: F.struct(
                x["a"]["i"].alias("i"),
                ((x["a"]["h"] == x["b"]["h"]) | (x["a"]["h"] == before["h"])).alias("twice"),
            ),
        ),
        lambda x: x["twice"],
    )
    return F.transform(flagged, lambda x: x["i"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_chars, clean_text) of every document.

    Words are runs of characters other than the six ASCII white-space ones.
    Null text counts as empty: no words, base_failed.  Lines without a word
    are neither kept nor counted as lost.  Repeated rows are measured each.
    3-word windows are compared by a 64-bit hash.  A text without repeated
    windows is not sorted.  ``carry`` adds the input row as struct ``row``.
    The measures leave through a generator, so that a filter on any of them
    stays above and never evaluates them inside one another.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = ["row"] if carry else []
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        text.alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    split = base.select(
        *row,
        "doc_id",
        "text",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_WHITE)).alias("lines"),
    )
    hashed = split.select(
        *row,
        "doc_id",
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("hashes"),
        F.filter("lines", line_passes).alias("good"),
    )
    sorted_ = hashed.select(
        *row,
        "doc_id",
        "n_words",
        "word_chars",
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "hashes",
        # only texts with a repeated window need them sorted
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array("hashes")).alias("in_order"),
        F.array_join("lines", "\n").alias("all_text"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    repeated = sorted_.withColumn("twice", _twice(F.col("hashes"), F.col("in_order"))).drop("in_order")
    counted = repeated.withColumn(
        "n_repeat_words",
        F.when(F.col("twice").isNull(), F.lit(0))
        .when(F.size("twice") <= SEARCHED, _covered(_places_by_search(F.col("hashes"), F.col("twice"))))
        .otherwise(_covered(_places_by_sort(F.col("hashes"))))
        .cast("long"),
    )
    judged = counted.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    ).withColumn("lost_chars", (F.length("all_text") - F.length("clean_text")).cast("long"))
    measured = F.struct(
        *row,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.length("all_text"))).alias("kept"),
        "lost_chars",
        "clean_text",
    )
    return judged.select(F.explode_outer(F.array(measured)).alias("measured")).select("measured.*")


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that are kept, with their failing lines removed; same
    columns as ``docs``."""
    changed = {text_col: F.col("clean_text"), chars_col: F.length("clean_text").cast("long")}
    out = [changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return measure(docs, docs.columns[0], text_col, carry=True).where("kept").select(*out)


ORACLE = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
    SELECT r, doc_id, t,
           list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
    FROM d
), g AS (
    SELECT *, list_filter(ls, lambda x:
        regexp_matches(x, '[.!?…。！？؟।]')
        AND (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100
            <= (length(x) - length(replace(x, ' ', '')) + 1) * 10
        AND length(x) - length(regexp_replace(x, '[|»›•·]', '', 'g')) < 3
        AND NOT (length(x) < 300 AND (
            contains(lower(x), 'all rights reserved') OR contains(lower(x), 'privacy policy')
            OR contains(lower(x), 'terms of use') OR contains(lower(x), 'terms of service')
            OR contains(lower(x), 'cookie policy') OR contains(lower(x), 'accept cookies')
            OR contains(lower(x), 'enable javascript') OR contains(lower(x), 'lorem ipsum')
            OR contains(lower(x), 'click here')))) AS good
    FROM s
), w AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)
), t AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w) WHERE c > 1
), p AS (
    SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words,
           length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(p.n, 0)::BIGINT AS n_repeat_words,
           length(coalesce(array_to_string(ls, chr(10)), '')) AS total,
           length(coalesce(array_to_string(good, chr(10)), '')) AS clean
    FROM g LEFT JOIN p USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
           AND 100 * (total - clean) <= 50 * total AS kept,
       (total - clean)::BIGINT AS lost_chars
FROM m
"""
