"""Byte-level BPE encoding and decoding through a global distinct-word shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import doc_text, spans_of, unpack_ints, worker_state
from kerbside.llm.words import blocks, coded, coded_blocks


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_bytes_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, bytes) of every token id; as large as the vocabulary."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    lens = np.array([len(t) for t in by_id], dtype=np.int64)
    return np.cumsum(lens) - lens, lens, np.frombuffer(b"".join(by_id), np.uint8)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens; a null id stays null; repeated rows
    are encoded each; an empty table gives an empty result.  Special strings
    are ordinary text.  The vocabulary path must exist on every executor.
    """
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def make_encoder():
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        return lambda units: [np.array(own.encode_ordinary(u), dtype="<u4").tobytes() for u in units]

    def assemble(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for head, starts, sizes, flat in coded_blocks(batches):
            doc_ids, lens = head["doc_ids"], unpack_ints(head["doc_units"]).astype(np.int64)
            units, ends = unpack_ints(head["units"]), np.cumsum(lens)
            for first in range(0, len(doc_ids), 256):  # a slice of the block's documents at a time
                last = min(first + 256, len(doc_ids))
                lo = int(ends[first] - lens[first])
                part = units[lo : int(ends[last - 1])]
                ids = flat[spans_of(starts[part], sizes[part])]
                counts = np.concatenate([[0], np.cumsum(sizes[part])])
                cuts = counts[np.concatenate([[0], ends[first:last] - lo])]
                out = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[first:last], pa.int64()),
                        pa.array(np.diff(cuts), pa.int64()),
                        pa.array(out, pa.binary()),
                    ],
                    schema=schema,
                )

    rows = blocks(doc_text(docs), pattern, frequencies=False)
    return coded(rows, lambda: worker_state(f"tiktoken:{ranks_path}", make_encoder)).mapInArrow(assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``encoded`` plus ``decoded`` (binary): the ids joined with the
    token-byte table, which every task holds (its size is the vocabulary's)."""
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def join_bytes(batches):
        starts, lens, raw = token_bytes_table(ranks_path)
        for batch in batches:
            ids_at = batch.schema.get_field_index("ids")
            out = []
            for ids in batch.column(ids_at):
                ids = np.frombuffer(ids.as_py(), "<u4")
                out.append(raw[spans_of(starts[ids], lens[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(join_bytes, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    out = decode(encode(docs, ranks_path), ranks_path)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
