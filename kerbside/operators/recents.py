"""Recently viewed premises (WIN1) and the saved-list document (JSN1).

Adding a premises moves it to the front, the list is distinct by id and
capped at 10.  For an add-only log the list is exactly "the 10 premises with
the latest add", computed here as a two-phase top-k: per (user, salt) first,
then per user over at most ``10 × salts`` rows, so a user holding a third of
all events never lands in one window partition.

With removes the list is a fold (an entry pushed out by the cap never comes
back): mergeable summaries of sorted slices, joined per user.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from kerbside.operators.list_fold import fold_lists
from kerbside.schemas import SAVED_DOCUMENT, SAVED_ELEMENT

MAX_SAVED = 10  # fixed value: entries kept in the list
SALTS = 32


def recents_add_only(log: DataFrame, limit: int = MAX_SAVED, salts: int = SALTS) -> DataFrame:
    """Current list per user from an add-only log (user_id, ts, event_id, pid).

    Output: (user_id, position, pid, last_ts), position 0 = most recent.
    """
    # the last add of each premises, as one (ts, event_id) pair
    last = log.groupBy("user_id", "pid").agg(F.max(F.struct("ts", "event_id")).alias("_last")).select(
        "user_id", "pid", F.col("_last.ts").alias("last_ts"), F.col("_last.event_id").alias("_last_ev")
    )
    order = [F.col("last_ts").desc(), F.col("_last_ev").desc(), F.col("pid").asc()]
    salted = last.withColumn("_salt", F.pmod(F.xxhash64("pid"), F.lit(salts)))
    w1 = Window.partitionBy("user_id", "_salt").orderBy(*order)
    local = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= limit)
    w2 = Window.partitionBy("user_id").orderBy(*order)
    # filter on the row number itself so Spark adds a partial (map-side)
    # WindowGroupLimit before each shuffle
    top = local.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= limit)
    return top.select("user_id", (F.col("_rn") - 1).cast("int").alias("position"), "pid", "last_ts")


def saved_list_json(recents: DataFrame, premises: DataFrame) -> DataFrame:
    """The stored document ``{"premises": [{id, six address parts}]}`` per user,
    from a recents list (≤ 10 entries per user, so the array is bounded)."""
    p = premises.select(
        F.col("id").alias("_pid"),
        F.col("address_room").alias("addressRoom"),
        F.col("address_number").alias("addressNumber"),
        F.col("address_street").alias("addressStreet"),
        F.col("address_locality").alias("addressLocality"),
        F.col("address_city").alias("addressCity"),
        F.col("address_postcode").alias("addressPostcode"),
    )
    j = recents.join(p, F.col("pid") == F.col("_pid"), "left")
    item = F.struct(
        F.col("position"),
        F.struct(
            F.col("pid").alias("id"),
            "addressRoom", "addressNumber", "addressStreet", "addressLocality", "addressCity", "addressPostcode",
        ).alias("p"),
    )
    per_user = j.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    doc = F.to_json(F.struct(F.transform("_items", lambda x: x["p"]).alias("premises")), {"ignoreNullFields": "false"})
    return per_user.select("user_id", doc.alias("document"))


_KEYS = ["id", "addressRoom", "addressNumber", "addressStreet", "addressLocality", "addressCity", "addressPostcode"]


def parse_saved_list(docs: DataFrame, col: str = "document") -> DataFrame:
    """JSN1: parse saved-list documents; every element needs all seven keys and
    a whole number as id (address parts may be null).  One bad element empties
    the whole list, so a fractional id is refused and never cut; unknown keys are dropped.  Output: (…, position, id, parts)."""
    raw_items = F.from_json(F.col(col), "struct<premises: array<string>>")["premises"]
    typed = F.from_json(F.col(col), SAVED_DOCUMENT)["premises"]
    has_keys = F.forall(
        raw_items,
        lambda e: F.forall(F.array(*[F.lit(k) for k in _KEYS]), lambda k: F.array_contains(F.json_object_keys(e), k)),
    )
    whole = lambda e: e["id"] == F.rint(e["id"])
    ids_ok = F.forall(typed, lambda e: e["id"].isNotNull() & whole(e) & (F.abs(e["id"]) < float(1 << 53)))

    def kind(e: Column, key: str) -> Column:
        return F.schema_of_variant(F.variant_get(F.try_parse_json(e), f"$.{key}", "variant"))

    # JSON types as written: a numeric address part or a textual id is invalid
    parts_ok = F.forall(
        raw_items,
        lambda e: functools.reduce(lambda a, b: a & b, [kind(e, k).isin("STRING", "VOID") for k in _KEYS[1:]]),
    )
    valid = raw_items.isNotNull() & typed.isNotNull() & has_keys & ids_ok & F.coalesce(parts_ok, F.lit(False))
    items = F.when(valid, typed).otherwise(F.array().cast(T.ArrayType(SAVED_ELEMENT)))
    others = [c for c in docs.columns if c != col]
    exploded = docs.select(*others, F.posexplode(items).alias("position", "e"))
    return exploded.select(
        *others,
        F.col("position").cast("int").alias("position"),
        F.col("e.id").cast("long").alias("id"),
        *[F.col(f"e.{k}").alias(k) for k in _KEYS[1:]],
    )


def recents_fold(log: DataFrame, limit: int = MAX_SAVED) -> DataFrame:
    """WIN1 with removes and clears: every user's list after the whole log
    (user_id, ts, event_id, op, pid), op in add / remove / clear, in (ts,
    event_id) order.  Output: (user_id, position, pid), position 0 = most
    recent.  See ``operators.list_fold``.
    """
    return fold_lists(log, limit)
