"""Token ids on disk as bit planes.

The ids of all documents, in ascending id order, form one stream.  A *shard*
is the stretch of the stream that one write task holds; each shard is cut
into blocks of ``BLOCK_IDS`` ids (its last one may be shorter).  A block is
stored as one row: its ids transposed into bit planes, each plane compressed
with zstandard, beside the index columns (shard, block, first position, number
of ids, documents that begin in it and where).  Parquet is the container, so
any store that Spark writes to will do, a lost task is committed once or not
at all, and the index columns are read without the planes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kerbside.llm.common import doc_text, worker_state
from kerbside.plans.stage import stage_path

BLOCK_IDS = 1 << 16
END_ID = 1
PART_CHARS = 4_000_000  # text that a task tokenizes at a time
CACHE_WORDS = 900_000

CHUNK_SCHEMA = (
    "shard int, chunk int, first long, n_ids int, first_doc long, doc_ids array<long>, doc_starts array<int>, "
    "planes array<binary>"
)
CHUNK_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int32()),
        ("first_doc", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_starts", pa.list_(pa.int32())),
        ("planes", pa.list_(pa.binary())),
    ]
)


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Plane b holds bit b of every id, eight ids a byte, compressed."""
    z = zstandard.ZstdCompressor(level=3)
    return [z.compress(np.packbits((ids >> b) & 1).tobytes()) for b in range(bits)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    ids = np.zeros(n, dtype=np.uint32)
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(z.decompress(plane), np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return ids


PLAIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Encodes white-space-free words, remembering up to ``CACHE_WORDS`` of
    them, or all of the texts at hand; for tokenizers that drop white space before they split.

    A word of Latin letters needs no normalisation but lower case and no
    splitting, so the tokenizer's model is asked directly; any other word goes
    through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.letters = byte_letters()
        self.whole: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        probes = ["Table", "éLÈVE", "straße", "Über", "niño"]
        self.direct = [self._plain(w.lower()) for w in probes] == [self._any(w) for w in probes] and self._any(
            "Table,."
        ) == self._any("table") + self._any(",.")

    def _plain(self, core: str) -> bytes:
        letters = core if core.isascii() else "".join([self.letters[b] for b in core.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _any(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _fill(self, missing: set[str]) -> None:
        if len(self.cores) > CACHE_WORDS:
            self.cores = {}
        cores, whole = self.cores, self.whole
        for w in missing:
            core = w.rstrip(".,")
            if self.direct and PLAIN(core):  # "word," is "word" and ","
                tail, core = w[len(core) :], core.lower()
                found = cores.get(core)
                if found is None:
                    found = cores[core] = self._plain(core)
                if tail:
                    ending = cores.get(tail)
                    if ending is None:
                        ending = cores[tail] = self._any(tail)
                    found += ending
                whole[w] = found
            else:
                whole[w] = self._any(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        seen: set[str] = set()
        for t in texts:
            seen.update(t.replace("\n", " ").split(" "))
        missing = seen - self.whole.keys()
        if len(self.whole) + len(missing) > CACHE_WORDS:  # keep what these texts need
            self.whole = {"": b""} | {w: self.whole[w] for w in seen - missing}
        self._fill(missing)
        del seen, missing
        get = self.whole.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(d.as_py())
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if chars >= PART_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenize every whole text, append ``end_id``, store the stream at ``path``.

    Null and empty texts hold the end id alone.  Order: doc_id (null ids
    first), then text, so repeated ids have a fixed order too.  An empty table
    leaves an empty store.  The shuffle is by doc_id range; every task
    tokenizes its own sorted range and writes its shard.
    """
    import public_tokenizers

    tokenizer_path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def shard(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encoder = worker_state(f"words:{tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        bits = max(encoder.size - 1, end_id).bit_length()
        end = np.uint32(end_id).tobytes()
        held = np.zeros(0, dtype=np.uint32)
        first = chunk = n_docs = 0
        starts: list[tuple[int, int | None]] = []  # position in the shard, doc_id

        def rows(final: bool):
            nonlocal held, first, chunk, starts, n_docs
            at = 0
            while len(held) - at >= BLOCK_IDS or (final and at < len(held)):
                ids = held[at : at + BLOCK_IDS]
                inside = [s for s in starts if s[0] < first + len(ids)]
                starts = starts[len(inside) :]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "shard": number,
                            "chunk": chunk,
                            "first": first,
                            "n_ids": len(ids),
                            "first_doc": n_docs,
                            "doc_ids": [d for _, d in inside],
                            "doc_starts": [p - first for p, _ in inside],
                            "planes": to_planes(ids, bits),
                        }
                    ],
                    schema=CHUNK_ARROW,
                )
                at += len(ids)
                first += len(ids)
                n_docs += len(inside)
                chunk += 1
            held = held[at:]

        for doc_ids, texts in _parts(batches):
            coded = [c + end for c in encoder.encode(texts)]
            lens = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            begin = first + len(held) + np.cumsum(lens) - lens
            starts += zip(begin.tolist(), doc_ids, strict=True)
            held = np.concatenate([held, np.frombuffer(b"".join(coded), "<u4")])
            yield from rows(False)
        yield from rows(True)

    (
        doc_text(docs)
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(shard, CHUNK_SCHEMA)
        .write.option("compression", "none")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc, doc_id, position, n_tokens, pieces) of a store: for every document
    where it begins in its shard and the (position, length, crc32) of its
    pieces, one per block it touches."""

    def pieces(batches):
        schema = pa.schema(
            [
                ("shard", pa.int32()),
                ("doc", pa.int64()),
                ("doc_id", pa.int64()),
                ("position", pa.int64()),
                ("n", pa.int64()),
                ("crc", pa.int64()),
            ]
        )
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"]).astype("<u4")
                cuts = [0, *row["doc_starts"], row["n_ids"]]
                names = [None, *row["doc_ids"]]
                found = [
                    (row["shard"], row["first_doc"] - 1 + k, names[k], row["first"] + a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                    if b > a
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return (
        spark.read.parquet(path)
        .mapInArrow(pieces, "shard int, doc long, doc_id long, position long, n long, crc long")
        .groupBy("shard", "doc")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.min("position").alias("position"),
            F.sum("n").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("position", "n", "crc"))).alias("pieces"),
        )
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, first, ids): the stored ids of every block."""

    def blocks(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"])
                yield pa.RecordBatch.from_pydict(
                    {"shard": [row["shard"]], "chunk": [row["chunk"]], "first": [row["first"]], "ids": [ids.tolist()]},
                    schema=pa.schema(
                        [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))]
                    ),
                )

    return spark.read.parquet(path).mapInArrow(blocks, "shard int, chunk int, first long, ids array<long>")


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc32_joined(crc_a: int, crc_b: int, len_b: int) -> int:
    """crc32 of a + b from the parts' crc32 and b's length in bytes: the
    register of a is moved over len_b zero bytes by repeated squaring of the
    one-zero-bit operator, then the parts are added."""
    op = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):  # one bit, two, four, eight: one byte
        op = [_times(op, v) for v in op]
    while len_b:
        if len_b & 1:
            crc_a = _times(op, crc_a)
        op = [_times(op, v) for v in op]
        len_b >>= 1
    return crc_a ^ crc_b


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document."""

    @F.udf(T.LongType())
    def join_pieces(parts):
        crc = parts[0]["crc"]
        for p in parts[1:]:
            crc = crc32_joined(crc, p["crc"], 4 * p["n"])
        return crc

    shards = (
        spark.read.parquet(path)
        .groupBy("shard")
        .agg(F.sum("n_ids").alias("size"))  # one row a shard
        .withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    read_back = read(spark, path)
    one = read_back.where(F.size("pieces") == 1).withColumn("ids_crc32", F.col("pieces")[0]["crc"])
    more = read_back.where(F.size("pieces") > 1).withColumn("ids_crc32", join_pieces("pieces"))
    docs = one.unionByName(more)
    return docs.join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "ids_crc32"
    )


def store(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write a store in the shared folder and return its digests."""
    spark = docs.sparkSession
    path = stage_path(spark, "llm-token-store")
    write(docs, path, tokenizer_path)
    return digests(spark, path)
