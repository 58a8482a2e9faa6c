"""Exact row numbering without a single-task partition.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task, and ``OVER (ORDER BY o)`` sends the whole table to one task.
Both break when one group (a postcode, a premises) holds a third of the data.

Here the rows are range-partitioned on the full sort key (group keys, order
keys, unique tie-breaker), so a hot group is spread over many tasks.  After a
local sort, each row's position inside its partition plus the number of rows
in earlier partitions is its global rank.  The per-partition count table has
one row per partition: its size is bounded by the partition count, so it is
safe to broadcast.  The sorted, tagged rows are written once as Parquet to
the shared checkpoint folder (``plans.stage.materialize``), so every later
pass reads the same numbering and a lost executor re-reads instead of
recomputing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.plans.stage import materialize

_P, _I, _OFF, _RUN = "_kb_part", "_kb_pos", "_kb_off", "_kb_run"


def _as_order(c: Column | str) -> Column:
    return F.col(c).asc_nulls_last() if isinstance(c, str) else c


def tag_sorted(
    df: DataFrame,
    sort_keys: Sequence[Column | str],
    num_partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Range-partition and sort ``df``; return (tagged rows, partition offsets).

    ``tagged`` carries ``_kb_part`` (partition) and ``_kb_pos`` (position in
    the partition); ``offsets`` has one row per partition with the number of
    rows in all earlier partitions.
    """
    keys = [_as_order(k) for k in sort_keys]
    # Without an explicit count the range exchange uses spark.sql.shuffle.partitions
    # and AQE may merge adjacent small ranges; merged partitions stay contiguous
    # and in key order, so partition ids remain monotone in the sort key.
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    part = F.spark_partition_id()
    tagged = materialize(
        ranged.sortWithinPartitions(*keys)
        .select(
            "*",
            part.alias(_P),
            # monotonically_increasing_id = (partition << 33) + row index in partition
            (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias(_I),
        ),
        "ordered",
    )
    counts = tagged.groupBy(_P).agg(F.count(F.lit(1)).alias("_kb_n"))
    before = Window.orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)  # ≤ n rows
    offsets = counts.select(_P, F.coalesce(F.sum("_kb_n").over(before), F.lit(0)).cast("long").alias(_OFF))
    return tagged, offsets


def global_sequence(
    df: DataFrame,
    order_keys: Sequence[Column | str],
    out: str = "seq",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based position of every row in the total order ``order_keys``.

    Equals ``row_number() OVER (ORDER BY order_keys) - 1`` when the keys are
    unique, without a SinglePartition exchange.
    """
    tagged, offsets = tag_sorted(df, order_keys, num_partitions)
    return tagged.join(F.broadcast(offsets), _P).select(
        *[F.col(c) for c in df.columns], (F.col(_OFF) + F.col(_I)).alias(out)
    )


def _number_runs(group_keys: Sequence[str]):
    """Arrow batches of a sorted partition, with each row's place in the
    partition and in its run of equal group keys."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        pos, length, last = 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(g)) for g in group_keys]
            new = np.zeros(n, dtype=bool)
            for c in columns:  # equal values have equal codes, nulls included
                codes = np.asarray(c.dictionary_encode(null_encoding="encode").indices)
                new[1:] |= codes[1:] != codes[:-1]
            first = [c[0].as_py() for c in columns]
            if first != last:
                new[0], length = True, 0
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start, at + length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pos + at, pa.int64()), pa.array(place, pa.int64())], names=[*batch.schema.names, _I, _RUN]
            )
            pos, length, last = pos + n, int(place[-1]) + 1, [c[n - 1].as_py() for c in columns]

    return run


def sequence_within(
    df: DataFrame,
    group_keys: Sequence[str],
    order_keys: Sequence[Column | str],
    out: str = "seq",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based position of every row inside its group, in ``order_keys`` order.

    Equals ``row_number() OVER (PARTITION BY group_keys ORDER BY order_keys) - 1``
    for unique keys.  The rows are exchanged once, by range; a row's place in
    its run of equal keys is counted while the partition is sorted.  Only the
    first run of a partition can have begun earlier: how many rows earlier
    partitions hold of it is one number per partition, which is broadcast.
    """
    if not group_keys:
        return global_sequence(df, order_keys, out, num_partitions)
    keys = [F.col(g).asc_nulls_last() for g in group_keys] + [_as_order(k) for k in order_keys]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    kept = ranged.sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias(_P))
    schema = T.StructType([*kept.schema.fields, T.StructField(_I, T.LongType()), T.StructField(_RUN, T.LongType())])
    tagged = materialize(kept.mapInArrow(_number_runs(list(group_keys)), schema), "ordered")
    # the first run of every partition, and the last with its length
    group = F.struct(*[F.col(g) for g in group_keys])
    edges = tagged.groupBy(_P).agg(
        F.min_by(group, _I).alias("_kb_first"), F.max_by(group, _I).alias("_kb_last"), (F.max_by(_RUN, _I) + 1).alias("_kb_len")
    )
    ends = edges.select(
        _P,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_kb_end"), F.col("_kb_first").alias("_kb_key"), F.lit(0).cast("long").alias("_kb_n")),
                F.struct(F.lit(1).alias("_kb_end"), F.col("_kb_last").alias("_kb_key"), F.col("_kb_len").alias("_kb_n")),
            )
        ),
    )
    before = Window.partitionBy("_kb_key").orderBy(_P, "_kb_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows per partition
    carry = ends.withColumn(_OFF, F.sum("_kb_n").over(before)).where(F.col("_kb_end") == 0).select(_P, _OFF)
    in_first_run = F.col(_I) == F.col(_RUN)
    return tagged.join(F.broadcast(carry), _P).select(
        *[F.col(c) for c in df.columns], (F.col(_RUN) + F.when(in_first_run, F.col(_OFF)).otherwise(F.lit(0))).alias(out)
    )
