"""Distinct-word shuffle shared by BPE encoding (op4) and token counts (op8).

A *unit* is a piece of text whose encoding does not depend on its
neighbours under the rank files' split pattern.  The pattern always breaks
before a single space or line feed that stands between two other characters,
so ordinary texts are cut there with ``str.split``; a text with any other
white space is cut by the pattern itself.

Units are written as keys:
  ``w``     a space, then w
  ``\\nw``   a line feed, then w
  ``\\rX``   X itself (first unit of a text, a comma or full stop after a word,
          or a match of the pattern)

Map tasks pre-aggregate: one *block* of whole documents (a few MB of text)
keeps each distinct unit once, dealt by hash into as many buckets as the
session has shuffle partitions, and the units' positions as one compressed
stream of block-local numbers.  The first shuffle brings all rows of a bucket
together, where each distinct unit is encoded once; a unit has at most one
entry per block, so none is hot.  The second shuffle brings a block's stream
and its encoded buckets together, where they are joined by number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbside.llm.common import pack_bytes, pack_codes, pack_ints, shuffle_width, unpack_bytes, unpack_codes, unpack_ints

BLOCK_CHARS = 12_000_000

# A row is either one bucket of a block's distinct units (``blob``) or, with
# bucket -1, the block's documents and their stream.
ROW_SCHEMA = (
    "block long, bucket int, deal int, blob binary, doc_ids array<long>, doc_bytes array<long>, doc_units binary, "
    "units binary, freqs binary, bucket_of binary"
)


def row_schema() -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("bucket", pa.int32()),
            ("deal", pa.int32()),
            ("blob", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())),
            ("doc_bytes", pa.list_(pa.int64())),
            ("doc_units", pa.binary()),
            ("units", pa.binary()),
            ("freqs", pa.binary()),
            ("bucket_of", pa.binary()),
        ]
    )


OTHER_SPACE = re.compile("[^\\S \n]")
# a comma or full stop that does not stand between a letter or digit and a
# space, line feed or the end
ODD_MARK = re.compile(r"(?<![^\W_])[.,]|[.,](?=[^ \n])")


def odd_space(text: str) -> bool:
    """White space other than single inner spaces and line feeds: such texts
    are cut by the pattern."""
    return (
        text[0] in " \n"
        or text[-1] in " \n"
        or "  " in text
        or " \n" in text
        or "\n " in text
        or "\n\n" in text
        or OTHER_SPACE.search(text) is not None
    )


def units_of(text: str, findall: Callable[[str], list[str]]) -> list[str]:
    if not text:
        return []
    if odd_space(text):
        return ["\r" + m for m in findall(text)]
    if not ODD_MARK.search(text):  # such a mark is always a match of its own
        text = text.replace(",", " \r,").replace(".", " \r.")
    units = text.replace("\n", " \n").split(" ")
    units[0] = "\r" + units[0]
    return units


def unit_text(key: str) -> str:
    if key[:1] == "\r":
        return key[1:]
    return key if key[:1] == "\n" else " " + key


def _rows(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for batch in batches:
        texts = batch.column(1)
        ids = batch.column(0)
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            held.append((ids[i].as_py(), text))
            chars += len(text)
            if chars >= block_chars:
                yield held
                held, chars = [], 0
    if held:
        yield held


def blocks(docs: DataFrame, pattern: str, frequencies: bool, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ROW_SCHEMA for the blocks of (doc_id, text).

    ``frequencies`` keeps (unit, count) pairs per document instead of the
    ordered stream of units.
    """
    width = shuffle_width(docs.sparkSession)

    def cut(batches):
        import regex
        from pyspark import TaskContext

        findall = regex.compile(pattern).findall
        base = TaskContext.get().partitionId() << 32
        schema = row_schema()
        for n, held in enumerate(_rows(batches, block_chars)):
            number: dict[str, int] = {}
            parts, per_doc, sizes = [], [], []
            for _, text in held:
                units = units_of(text, findall)
                parts.append(np.array([number.setdefault(u, len(number)) for u in units], dtype=np.uint32))
                per_doc.append(len(units))
                sizes.append(len(text.encode()))
            stream = np.concatenate(parts)
            del parts
            # small numbers for frequent units: the stream compresses better
            order = np.argsort(-np.bincount(stream, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            stream = rank[stream]
            keys = [k.encode() for k in number]
            del number
            bucket_of = np.fromiter((zlib.crc32(k) % width for k in keys), dtype=np.uint32, count=len(keys))[order]
            by_bucket = np.argsort(bucket_of, kind="stable")
            cuts = np.searchsorted(bucket_of[by_bucket], np.arange(width + 1))
            lens = np.array(per_doc, dtype=np.int64)
            freqs = None
            if frequencies:
                ends = np.cumsum(lens).tolist()
                pairs = [np.unique(stream[b - n : b], return_counts=True) for b, n in zip(ends, per_doc, strict=True)]
                lens = np.array([len(p[0]) for p in pairs], dtype=np.int64)
                stream = np.concatenate([p[0] for p in pairs])
                freqs = pack_ints(np.concatenate([p[1] for p in pairs]), 6)
                del pairs
            block = base + n
            rows = [
                {
                    "block": block,
                    "bucket": -1,
                    "deal": zlib.crc32(str(block).encode()) % width,
                    "doc_ids": [d for d, _ in held],
                    "doc_bytes": sizes,
                    "doc_units": pack_ints(lens),
                    "units": pack_ints(stream, 6),
                    "freqs": freqs,
                    "bucket_of": pack_ints(bucket_of),
                }
            ]
            del stream, held
            for b in range(width):
                if cuts[b] < cuts[b + 1]:
                    blob = pack_bytes([keys[i] for i in order[by_bucket[cuts[b] : cuts[b + 1]]]], 9)
                    rows.append({"block": block, "bucket": b, "deal": b, "blob": blob})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, ROW_SCHEMA)


def coded(rows: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list[bytes]]]) -> DataFrame:
    """The rows with every bucket's units encoded (strings of little-endian
    unsigned 32-bit integers), brought together and sorted by block, each
    block's stream first."""
    width = shuffle_width(rows.sparkSession)

    def encode(batches):
        known: dict[bytes, bytes] = {}
        encoder = None
        schema = row_schema()
        blob_at, bucket_at = schema.get_field_index("blob"), schema.get_field_index("bucket")
        for batch in batches:
            encoder = encoder or make_encoder()
            blobs = []
            for row in range(batch.num_rows):
                if batch.column(bucket_at)[row].as_py() < 0:
                    blobs.append(None)
                    continue
                lens, raw = unpack_bytes(batch.column(blob_at)[row].as_py())
                keys, at = [], 0
                for end in np.cumsum(lens, dtype=np.int64).tolist():
                    keys.append(raw[at:end])
                    at = end
                new = [k for k in keys if k not in known]
                if new:
                    known.update(zip(new, encoder([unit_text(k.decode()) for k in new]), strict=True))
                blobs.append(pack_codes([known[k] for k in keys], 6))
            columns = list(batch.columns)
            columns[blob_at] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return (
        rows.repartition(width, "deal")
        .mapInArrow(encode, ROW_SCHEMA)
        .repartition(width, "block")
        .sortWithinPartitions("block", "bucket")
    )


def coded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(stream row, starts, sizes, integers) of every block of ``coded`` rows:
    unit n's integers are ``integers[starts[n]:][:sizes[n]]``."""
    head, codes = None, []

    def joined():
        bucket_of = unpack_ints(head["bucket_of"])
        lens = np.concatenate([c[0] for c in codes] or [np.zeros(0)]).astype(np.int64)
        at = np.cumsum(lens) - lens
        by_bucket = np.argsort(bucket_of, kind="stable")
        starts, sizes = np.empty_like(at), np.empty_like(lens)
        starts[by_bucket], sizes[by_bucket] = at, lens
        return head, starts, sizes, np.concatenate([c[1] for c in codes] or [np.zeros(0, "<u4")])

    for batch in batches:
        for row in range(batch.num_rows):
            if batch.column(1)[row].as_py() < 0:
                if head is not None:
                    yield joined()
                head, codes = {n: batch.column(n)[row].as_py() for n in batch.schema.names}, []
            else:
                codes.append(unpack_codes(batch.column(3)[row].as_py()))
    if head is not None:
        yield joined()
