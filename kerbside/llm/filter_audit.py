"""How filters overlap: for every order of five filters, what each step removes.

1. Every document gets its number (``rid``) and the filters it fails; a
   document's text is read once, and only a digest of it meets the others'.
2. *Posting lists*: the sorted numbers of the documents that fail a filter, for
   every part (source) and range of numbers; likewise of the good and the
   toxic documents.  A list covers at most ``RANGE`` numbers, so a part that
   holds a third of all documents is many short lists.
3. In each (part, range), the union of every set of filters is built by
   galloping merges, a filter at a time; its size, and the sizes of its
   intersections with the good and the toxic lists, are kept.
4. Sizes are summed over the ranges: 32 rows a part.  What a step removes is
   the difference of two unions, so any order of the filters is read off them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import shuffle_width
from kerbside.plans.stage import materialize

FILTERS = "ABCDE"
RANGE = 1 << 16  # document numbers of a posting list
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
NOT_WHITE = "[^ \\t-\\r]"
SIZES = "part string, mask int, all long, good long, toxic long"


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(rid, doc_id, part, fails): ``fails`` is an array of five booleans, one a
    filter, in the order of ``FILTERS``.

    A null text is empty, a null part the empty string.  Filter E fails a
    document whose text some smaller doc_id has; a null doc_id is smaller than
    none and has none smaller.  Repeated rows are documents of their own.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.alias("t"),
        F.regexp_extract_all(text, F.lit(f"({NOT_WHITE}+)"), F.lit(1)).alias("words"),
    )
    flags = F.array(
        F.size("words") < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.size("words"),
        100 * F.regexp_count("t", F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length("t"),
        F.col("t").rlike("[#$%&*|]"),
    )
    # numbers that are stored with the rows; texts stay behind as digests
    marked = materialize(
        base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "part", F.unhex(F.md5("t")).alias("digest"), flags.alias("flags")),
        "llm-audit",
    )
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copied = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return marked.join(first, "digest", "left").select("rid", "doc_id", "part", F.concat("flags", F.array(copied)).alias("fails"))


def posting_lists(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, block, name, n, ids): sorted numbers of the documents of a part
    and range that fail filter ``name``, or are ``good`` or ``toxic``; and
    ``all`` of them, counted in ``n`` without their numbers.

    ``labels``: (doc_id, quality, toxic); a document is good or toxic if any of
    its label rows says 1.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    docs = failed.join(known, "doc_id", "left")
    held = [F.when(F.get("fails", F.lit(i)), F.lit(f)) for i, f in enumerate(FILTERS)]
    held += [F.when(F.col(c), F.lit(c)) for c in ("good", "toxic")]
    rows = docs.select(
        "part",
        F.floor(F.col("rid") / RANGE).alias("block"),
        F.explode(F.array_append(F.array_compact(F.array(*held)), F.lit("all"))).alias("name"),
        "rid",
    )
    ids = F.sort_array(F.collect_list(F.when(F.col("name") != "all", F.col("rid"))))
    return rows.groupBy("part", "block", "name").agg(F.count("*").alias("n"), ids.alias("ids"))


def gallop(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the elements of the sorted list ``a`` belong in the sorted list
    ``b``: doubling steps from the last place found, then halving ones; all
    elements of ``a`` move together."""
    low = np.zeros(len(a), dtype=np.int64)
    if not len(a) or not len(b):
        return low
    # the places found for every 64th element bound those of the ones between
    marks = np.searchsorted(b, a[::64])
    low = np.repeat(marks, 64)[: len(a)]
    high = np.minimum(np.repeat(np.append(marks[1:], len(b)), 64)[: len(a)], len(b))
    step = np.ones(len(a), dtype=np.int64)
    open_ = (low < high) & (b[np.minimum(low, len(b) - 1)] < a)
    while open_.any():
        ahead = np.minimum(low + step, high)
        past = (ahead >= high) | (b[np.minimum(ahead, len(b) - 1)] >= a)
        high = np.where(open_ & past, ahead, high)
        low = np.where(open_ & ~past, ahead, low)
        step = np.where(open_, step * 2, step)
        open_ &= ~past
    while (low < high).any():
        middle = (low + high) // 2
        less = (low < high) & (b[np.minimum(middle, len(b) - 1)] < a)
        high = np.where((low < high) & ~less, middle, high)
        low = np.where(less, middle + 1, low)
    return low


def missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elements of ``a`` that ``b`` lacks."""
    if not len(a) or not len(b):
        return a
    at = gallop(a, b)
    return a[(at == len(b)) | (b[np.minimum(at, len(b) - 1)] != a)]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted lists as one: the new elements of the shorter go in."""
    if len(a) < len(b):
        a, b = b, a
    new = missing(b, a)
    return np.insert(a, gallop(new, a), new)


def union_sizes(lists: dict[str, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(mask, size, good ones, toxic ones) of the union of every set of filters."""
    none = np.zeros(0, dtype=np.int64)
    good, toxic = lists.get("good", none), lists.get("toxic", none)
    unions, out = {0: none}, []
    for mask in range(1 << len(FILTERS)):
        if mask:
            top = mask.bit_length() - 1  # one more list joins a union that is known
            unions[mask] = union(unions[mask ^ (1 << top)], lists.get(FILTERS[top], none))
        u = unions[mask]
        out.append((mask, len(u), len(good) - len(missing(good, u)), len(toxic) - len(missing(toxic, u))))
    return out


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    part = key[0].as_py()
    lists = {n: np.asarray(i, dtype=np.int64) for n, i in zip(rows.column("name").to_pylist(), rows.column("ids").to_pylist(), strict=True)}
    out = [(part, *row) for row in union_sizes(lists)]
    names = ["part", "mask", "all", "good", "toxic"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def in_every_order(per_part: DataFrame) -> DataFrame:
    """Adds (filter_order, step, letter, before, after): every order of the
    filters grown a filter at a time; ``before`` and ``after`` are the sets of
    filters around the step."""
    filters = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    grown = per_part.withColumn("steps", F.array().cast("array<int>"))
    for _ in FILTERS:
        left = F.filter(filters, lambda f: ~F.array_contains("steps", f))
        grown = grown.withColumn("next", F.explode(left)).withColumn("steps", F.array_append("steps", F.col("next"))).drop("next")
    letter = {1 << i: f for i, f in enumerate(FILTERS)}
    names = F.create_map(*[F.lit(v) for p in letter.items() for v in p])
    stepped = grown.withColumn("filter_order", F.array_join(F.transform("steps", lambda f: F.element_at(names, f)), "")).select(
        "*", F.posexplode("steps").alias("at", "own")
    )
    before = F.aggregate(F.slice("steps", F.lit(1), F.col("at")), F.lit(0), lambda a, f: a + f)
    return stepped.select(
        *per_part.columns, "filter_order", (F.col("at") + 1).alias("step"), F.element_at(names, F.col("own")).alias("letter"),
        before.alias("before"), (before + F.col("own")).alias("after"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see ``failures`` and
    ``posting_lists`` for nulls, ties and repeated rows.  An empty table has no
    part and gives no row.

    ``kept``, ``removed``, ``redundant`` (fail the step's filter, removed
    before), ``unique_fails`` (fail no other filter), ``good_lost``,
    ``toxic_lost``, ``shapley`` (removed by the filter, summed over all orders).
    """
    spark = docs.sparkSession
    postings = materialize(posting_lists(failures(docs, id_col, text_col, part_col), labels), "llm-postings")
    totals = postings.where("name = 'all'").groupBy("part").agg(F.sum("n").alias("total"))
    lists = postings.where("name <> 'all'").repartition(shuffle_width(spark), "part", "block")  # lists are small, merging them is not
    sizes = lists.groupBy("part", "block").applyInArrow(_merged, SIZES)
    summed = sizes.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("all", "good", "toxic")])
    # a part's 32 unions in one row
    unions = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", "good", "toxic"))))
    per_part = totals.join(summed.groupBy("part").agg(unions.alias("u")), "part", "left")

    def of(mask: Column, what: str = "all") -> Column:
        return F.coalesce(F.element_at("u", mask)[what], F.lit(0))

    own = F.col("after") - F.col("before")
    every = (1 << len(FILTERS)) - 1
    rows = in_every_order(per_part).select(
        "part",
        "filter_order",
        "step",
        "letter",
        (F.col("total") - of(F.col("after"))).alias("kept"),
        (of(F.col("after")) - of(F.col("before"))).alias("removed"),
        (of(own) - of(F.col("after")) + of(F.col("before"))).alias("redundant"),
        (of(F.lit(every)) - of(every - own)).alias("unique_fails"),
        (of(F.col("after"), "good") - of(F.col("before"), "good")).alias("good_lost"),
        (of(F.col("after"), "toxic") - of(F.col("before"), "toxic")).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT t, min(doc_id) AS first FROM d GROUP BY t
), l AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           [len(ws) < 200,
            100 * len(list_distinct(ws)) < 50 * len(ws),
            100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
            regexp_matches(t, '[#$%&*|]'),
            coalesce(first < doc_id, false)] AS fails
    FROM d JOIN s USING (t) LEFT JOIN l USING (doc_id)
), g AS (
    SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT [strpos('ABCDE', a.x), strpos('ABCDE', b.x), strpos('ABCDE', c.x), strpos('ABCDE', e.x), strpos('ABCDE', h.x)] AS o,
           a.x || b.x || c.x || e.x || h.x AS filter_order
    FROM letters a, letters b, letters c, letters e, letters h
    WHERE len(list_distinct([a.x, b.x, c.x, e.x, h.x])) = 5
), steps AS (
    SELECT filter_order, step, o[step] AS f, o[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), c AS (
    SELECT part, filter_order, step, f,
           sum(CASE WHEN NOT gone AND NOT fails[f] THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND fails[f] THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails[f] THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails[f] THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails[f] THEN toxic ELSE 0 END) AS toxic_lost
    FROM (SELECT *, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone FROM g, steps)
    GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM c
"""
