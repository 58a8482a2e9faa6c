"""Benchmark decontamination by SimHash of item-sized windows.
DataFrame functions only.

1. Items and documents become five-word shingles (64-bit hashes).
2. Similarity 0.8 takes a least number of shared shingles (8/9 of them, for a
   window of the item's size).  Sliding item-sized windows over a document,
   every window with that many shingles of items of the size is fingerprinted,
   in whatever order the shingles stand; no other window can reach 0.8.
3. Every such window and item gets a 126-bit SimHash over all its shingles.  A
   window's bit sums are the difference of two running sums over its document,
   so overlapping windows share the work.
4. Multi-index Hamming search: with B blocks and radius R, two fingerprints
   within R agree in some block up to floor(R / B) bits (pigeonhole), so
   probing the items' blocks with up to that many bits flipped finds all
   fingerprints within R.  Windows meet only items of their size.
5. The exact weighted-shingle similarity (sum of the smaller over the sum of
   the larger counts) decides.  It too is a running sum: every shared shingle
   counts for an interval of starts.

Rows grow with the documents' lengths and the number of windows, never with
their product.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import BROADCAST_LIMIT
from kerbside.plans.stage import materialize

SHINGLE = 5
MIN_SIMILARITY = 0.8
BITS = 63  # of each of the two fingerprint words
BLOCK_BITS = 7
RADIUS = 35  # a pair at similarity 0.8 differs in 19.2 of 126 bits on average, s.d. 4.0

LANE = 32  # bits i and i + LANE are counted together in one sum
N_BLOCKS = 2 * BITS // BLOCK_BITS


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null text: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _shingles(words: Column) -> Column:
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - SHINGLE),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _hashed(rows: DataFrame, key: list[Column], text: str) -> DataFrame:
    return rows.select(*key, _words(F.col(f"`{text}`")).alias("words")).select(
        *[c for c in rows.select(*key).columns], _shingles(F.col("words")).alias("hashes")
    )


# The many like expressions of a fingerprint are SQL text: built as Columns they
# take the driver longer than the executors.
def _bits(h: str) -> dict[str, str]:
    """What one shingle adds to each sum.  A text has fewer than 2^31 shingles, so
    no lane runs over."""
    return {
        f"s{k}_{i}": f"shiftrightunsigned({w}, {i}) & {1 << LANE | 1 if i + LANE < BITS else 1}L"
        for k, w in enumerate((f"xxhash64({h})", f"xxhash64({h}, 1)"))
        for i in range(LANE)
    }


def _majorities(n: str) -> list[Column]:
    """The fingerprint words f0 and f1 from the sums over ``n`` shingles."""

    def word(k: int) -> str:
        lanes = [divmod(bit, LANE) for bit in range(BITS)]
        counts = [f"(shiftrightunsigned(s{k}_{i}, {LANE * lane}) & {(1 << LANE) - 1}L)" for lane, i in lanes]
        return " | ".join(f"if(2 * {count} > {n}, {1 << bit}L, 0L)" for bit, count in enumerate(counts))

    return [F.expr(word(0)).alias("f0"), F.expr(word(1)).alias("f1")]


def _item_prints(item_at: DataFrame) -> DataFrame:
    sums = [F.expr(f"sum({v}) AS {c}") for c, v in _bits("h").items()]
    counted = item_at.groupBy("item_id", "item_key").agg(F.count("*").alias("item_size"), *sums)
    return counted.select("item_id", "item_key", "item_size", *_majorities("item_size"))


def _window_prints(windows: DataFrame, positions: DataFrame) -> DataFrame:
    """``windows`` with f0 and f1.  Shingles (at, h) and the windows' two ends
    stand in one order per document; the running sums at the end less those
    before the start are the window's."""
    keys = windows.columns
    none = [F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in keys if c != "doc_key"]
    ends = F.explode(
        F.array(
            F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign")),
            F.struct((F.col("start") + F.col("size") - 1).alias("at"), F.lit(1).alias("sign")),
        )
    ).alias("end")
    marks = windows.select(*keys, ends).select(*keys, "end.at", "end.sign", F.lit(None).cast("long").alias("h"))
    shingles = positions.select("doc_key", *none, "at", F.lit(0).alias("sign"), "h")
    # dealt before the sums are spelled out, so narrow rows are exchanged
    dealt = shingles.unionByName(marks).repartition("doc_key")
    added = _bits("h")
    spelled = dealt.select(*keys, "at", "sign", *[F.expr(f"if(h IS NULL, 0L, {v}) AS {c}") for c, v in added.items()])
    so_far = "OVER (PARTITION BY doc_key ORDER BY at, abs(sign) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    summed = spelled.select(*keys, "sign", *[F.expr(f"sum({c}) {so_far} AS {c}") for c in added]).where("sign <> 0")
    sums = summed.groupBy(*keys).agg(*[F.expr(f"sum(sign * {c}) AS {c}") for c in added])
    return sums.select(*keys, *_majorities("size"))


def _common(pairs: DataFrame, positions: DataFrame, item_at: DataFrame) -> DataFrame:
    """``pairs`` with ``common``: the sum over shingles of the smaller of the
    window's and the item's counts.

    An occurrence counts if fewer than m (the item's count) of its kind stand
    before it in the window: for starts after its m-th predecessor, up to
    itself.  Sums over such intervals are running sums over their borders."""
    of = ["doc_key", "item_key"]
    item_counts = item_at.groupBy("item_key", "h").agg(F.count("*").cast("int").alias("m"))
    sought = pairs.select(*of, "size").distinct().join(_hint(item_counts, 32), "item_key")
    found = (
        positions.join(sought, ["doc_key", "h"])
        .groupBy(*of, "h", "size", "m")
        .agg(F.sort_array(F.collect_list("at")).alias("ats"))
        .select(*of, "size", "m", "ats", F.posexplode("ats").alias("j", "at"))
    )
    before = F.when(F.col("j") >= F.col("m"), F.get("ats", F.col("j") - F.col("m")) + 1).otherwise(0)
    borders = F.explode(
        F.array(
            F.struct(F.greatest(before, F.col("at") - F.col("size") + 1, F.lit(0)).alias("start"), F.lit(1).alias("step")),
            F.struct((F.col("at") + 1).alias("start"), F.lit(-1).alias("step")),
        )
    ).alias("border")
    steps = found.select(*of, borders).select(*of, "border.start", "border.step")
    asked = pairs.withColumn("step", F.lit(0))
    so_far = Window.partitionBy(*of).orderBy("start", F.col("step") == 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        asked.unionByName(steps, allowMissingColumns=True)
        .withColumn("common", F.sum("step").over(so_far))
        .where("step = 0")
        .drop("step")
    )


def _blocks(f0: Column, f1: Column) -> Column:
    """array of (block number, its bits)."""
    per_word = BITS // BLOCK_BITS
    return F.array(
        *[
            F.struct(
                F.lit(k * per_word + b).alias("block"),
                F.shiftright(f, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("bits"),
            )
            for k, f in enumerate((f0, f1))
            for b in range(per_word)
        ]
    )


def _flips(radius: int) -> list[int]:
    within = radius // N_BLOCKS
    return [sum(1 << i for i in c) for n in range(within + 1) for c in combinations(range(BLOCK_BITS), n)]


def _hint(small: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast only what was counted and fits; else a shuffle join."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_LIMIT else small


def _least_common(sizes: Column, min_similarity: float) -> Column:
    """Shared shingles that a window and an item of ``sizes`` shingles together
    need: common / (sizes - common) >= min_similarity."""
    return F.greatest(F.lit(1), F.ceil(sizes * min_similarity / (1 + min_similarity) - 1e-9).cast("int"))


def _starts() -> Column:
    """Starts of the windows of ``size`` that hold at least ``least`` of the
    sorted positions ``hits``.  Such a window has a first hit i that is not
    before its start, and its hit i + least - 1 is not behind its end; starts up
    to the hit before i belong to that one."""
    hits = F.col("hits")

    def with_first(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(hits, i + F.col("least") - 1) - F.col("size") + 1, F.coalesce(F.get(hits, i - 1) + 1, F.lit(0)))
        high = F.least(F.get(hits, i), F.col("total") - F.col("size"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    ranges = F.transform(F.sequence(F.lit(0), F.size(hits) - F.col("least")), with_first)
    return F.when(F.size(hits) >= F.col("least"), F.flatten(ranges)).otherwise(F.array().cast("array<int>"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    min_similarity: float = MIN_SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, start_word, n_words): one row for
    each document and item where the document holds a window that similar to
    the item, with the best window (ties: the first).

    Null, empty and short texts (under five words) hold no shingle and match
    nothing, on either side.  A document shorter than an item is one window.
    Rows with equal id and text count once; equal ids with different texts
    are compared each and give one row.  Repeated item rows count once.
    """
    scored = _matches(docs, items, id_col, item_col, text_col, min_similarity, radius)
    best = F.max_by(
        F.struct("hamming", "start", "window_size"), F.struct("similarity", -F.col("start"))
    )
    return (
        scored.groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), best.alias("best"))
        .select(
            "doc_id",
            "item_id",
            "similarity",
            F.col("best.hamming").cast("int").alias("hamming"),
            F.col("best.start").alias("start_word"),
            (F.col("best.window_size") + (SHINGLE - 1)).cast("int").alias("n_words"),
        )
    )


def _doc_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart that differ in id or text."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _matches(
    docs: DataFrame, items: DataFrame, id_col: str, item_col: str, text_col: str, min_similarity: float, radius: int
) -> DataFrame:
    """Every window of a document that is similar to an item, with its
    ``doc_key`` and ``similarity``."""
    item_rows = _hashed(
        items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct(),
        [F.col("item_id"), F.xxhash64("item_id", "text").alias("item_key")],
        "text",
    )
    item_at = materialize(
        item_rows.select(
            "item_id", "item_key", F.size("hashes").alias("size"), F.posexplode_outer("hashes").alias("place", "h")
        ).where(F.col("h").isNotNull()),
        "llm-items",
    )
    base = docs.select(_doc_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    key = [F.col("key").alias("doc_key"), F.col("doc_id")]
    doc_rows = _hashed(base, key, "text")

    # windows with enough shared shingles, in shingle positions
    known = item_at.select("h", F.col("size").alias("item_size")).distinct()
    # outer, so that no filter on the array's size is pushed below its making
    found = doc_rows.select(
        "doc_key", "doc_id", F.size("hashes").alias("total"), F.posexplode_outer("hashes").alias("at", "h")
    )
    hits = (
        found.join(_hint(known, 32), "h")
        .groupBy("doc_key", "doc_id", "total", "item_size")
        .agg(F.sort_array(F.collect_set("at")).alias("hits"))
        .withColumn("size", F.least("item_size", "total"))
        .withColumn("least", _least_common(F.col("size") + F.col("item_size"), min_similarity))
    )
    windows = hits.select("doc_key", "doc_id", "item_size", "size", F.explode(_starts()).alias("start"))
    windows = materialize(windows, "llm-windows")

    # the shingles that those windows span; only documents with a window move
    spans = windows.groupBy("doc_key").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("size")).alias("high"))
    holders = doc_rows.select("doc_key", "hashes").join(_hint(materialize(spans, "llm-spans"), 32), "doc_key").dropDuplicates(["doc_key"])
    positions = materialize(
        holders.select("doc_key", "low", F.posexplode_outer(F.slice("hashes", F.col("low") + 1, F.col("high") - F.col("low"))).alias("k", "h"))
        .select("doc_key", (F.col("low") + F.col("k")).alias("at"), "h"),
        "llm-positions",
    )
    win = ["doc_key", "doc_id", "item_size", "size", "start"]
    window_prints = materialize(_window_prints(windows.select(*win), positions), "llm-prints")
    item_prints = materialize(
        _item_prints(item_at).withColumnsRenamed({"f0": "g0", "f1": "g1"}),
        "llm-item-prints",
    )

    # multi-index Hamming search
    probes = item_prints.select("*", F.explode(_blocks(F.col("g0"), F.col("g1"))).alias("b")).select(
        "item_id",
        "item_key",
        "item_size",
        "g0",
        "g1",
        F.col("b.block").alias("block"),
        F.explode(F.array(*[F.col("b.bits").bitwiseXOR(F.lit(x)) for x in _flips(radius)])).alias("bits"),
    )
    sought = window_prints.select("*", F.explode(_blocks(F.col("f0"), F.col("f1"))).alias("b")).select(
        *win, "f0", "f1", F.col("b.block").alias("block"), F.col("b.bits").alias("bits")
    )
    hamming = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    pairs = (
        sought.join(_hint(materialize(probes, "llm-probes"), 64), ["item_size", "block", "bits"])
        .withColumn("hamming", hamming)
        .where(F.col("hamming") <= radius)
        .select(*win, "item_id", "item_key", "hamming")
        .distinct()
    )

    # exact similarity of the candidates
    shared = _common(materialize(pairs, "llm-leak-pairs"), positions, item_at).withColumnRenamed("size", "window_size")
    return shared.withColumn(
        "similarity", F.col("common") / (F.col("window_size") + F.col("item_size") - F.col("common"))
    ).where(F.col("similarity") >= min_similarity)


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a leaked item; same columns.  A row goes if its own
    id and text leak, whatever its id: null and repeated ids stand for
    nothing else."""
    found = _matches(docs, items, id_col, "item_id", text_col, MIN_SIMILARITY, RADIUS).select(F.col("doc_key").alias("__leaked_key")).distinct()
    return docs.join(found, _doc_key(id_col, text_col) == F.col("__leaked_key"), "left_anti")
