"""Helpers shared by the operators: tables, worker state, packing."""

from __future__ import annotations

import sys
import types

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_LIMIT = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns of the caller never clash with ours."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def smallest_hashes(rows: DataFrame, group: str, per_group: int) -> DataFrame:
    """(doc_id, group, rank) of distinct (doc_id, group): at most ``per_group``
    of each group, ranked by the ids' hash.

    A threshold from the group's row count leaves about ``per_group`` rows (ten
    standard deviations more) before they are ranked, so no task ranks a group.
    Repeated rows lower the threshold, and may leave fewer."""
    h = F.xxhash64("doc_id")
    share = (per_group + 10 * per_group**0.5 + 100) / F.col("n")
    rows = rows.select("doc_id", group)
    few = rows.join(F.broadcast(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))), group).where(h / 2.0**64 + 0.5 <= share)
    order = Window.partitionBy(group).orderBy("h", "doc_id")
    ranked = few.select("doc_id", group, h.alias("h")).distinct().withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= per_group).select("doc_id", group, "rank")


def worker_state(key: str, make):
    """A value kept by the Python worker across tasks (caches, tokenizers)."""
    store = sys.modules.setdefault("_kerbside_llm_worker", types.ModuleType("_kerbside_llm_worker"))
    found = store.__dict__.get(key)
    if found is None:
        found = store.__dict__[key] = make()
    return found


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_ints(values: np.ndarray, level: int = 3) -> bytes:
    """Unsigned 32-bit integers as byte planes in one zstandard frame.  The low
    bytes of small values (below 256) stand apart from the others': they are
    distributed differently."""
    v = values.astype("<u4")
    planes = v.view(np.uint8).reshape(-1, 4)
    small = v < 256
    parts = [planes[:, 3], planes[:, 2], planes[:, 1], planes[small, 0], planes[~small, 0]]
    return zstandard.ZstdCompressor(level=level).compress(
        np.uint32(len(v)).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)
    )


def _ints(raw: bytes) -> tuple[np.ndarray, int]:
    """Values of an unpacked ``pack_ints`` frame, and where they end."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    planes = np.zeros((n, 4), dtype=np.uint8)
    high = np.frombuffer(raw, np.uint8, 3 * n, 4).reshape(3, n)
    planes[:, 3], planes[:, 2], planes[:, 1] = high
    small = ~high.any(axis=0)
    low = np.frombuffer(raw, np.uint8, n, 4 + 3 * n)
    k = int(small.sum())
    planes[small, 0], planes[~small, 0] = low[:k], low[k:]
    return planes.reshape(-1).view("<u4"), 4 + 4 * n


def unpack_ints(blob: bytes) -> np.ndarray:
    return _ints(zstandard.ZstdDecompressor().decompress(blob))[0]


def pack_bytes(items: list[bytes], level: int = 3) -> bytes:
    """Byte strings as zstandard frames: lengths, then the bytes."""
    lens = pack_ints(np.fromiter(map(len, items), dtype="<u4", count=len(items)), level)
    body = zstandard.ZstdCompressor(level=level).compress(b"".join(items))
    return np.uint32(len(lens)).tobytes() + lens + body


def unpack_bytes(blob: bytes) -> tuple[np.ndarray, bytes]:
    """(lengths, concatenated bytes) of ``pack_bytes``."""
    at = 4 + int(np.frombuffer(blob, "<u4", 1)[0])
    return unpack_ints(blob[4:at]), zstandard.ZstdDecompressor().decompress(blob[at:])


def pack_codes(items: list[bytes], level: int = 3) -> bytes:
    """Strings of 32-bit integers: how many each holds, then all as planes."""
    lens = pack_ints(np.fromiter(map(len, items), dtype="<u4", count=len(items)) // 4, level)
    return np.uint32(len(lens)).tobytes() + lens + pack_ints(np.frombuffer(b"".join(items), "<u4"), level)


def unpack_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(how many, all integers) of ``pack_codes``."""
    at = 4 + int(np.frombuffer(blob, "<u4", 1)[0])
    return unpack_ints(blob[4:at]), unpack_ints(blob[at:])


def spans_of(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length) pair, in order."""
    ends = np.cumsum(lens, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lens), lens) + np.arange(total, dtype=np.int64)
