"""Substring deduplication over sliding sentence spans.

Texts are cut into sentences, and sentences of more than ``WINDOW`` words
further, where the words themselves say so: of every ``WINDOW`` neighbouring
words the one with the smallest hash of itself and the word before it begins a
piece (winnowing; a sentence's first word counts as smaller than all others).
Whether a word begins a piece depends only on the words around it, never on
how far away its sentence began.

A *run* is a stretch of two or more consecutive pieces with at least
``MIN_WORDS`` words: for every piece the shortest run that begins with it, and
the shortest that ends with it, so that every repeated passage is covered up
to its last piece.  A run's hash is over its words, not its pieces.  So any
``3 * WINDOW + MIN_WORDS - 1`` = 49 words that two places share have a common
run, wherever they are set: one of their first ``WINDOW`` + 1 words begins a
piece at both places, and from ``WINDOW`` words on until ``WINDOW`` words
before their end all pieces are the same.

In scripts without spaces (Han, kana, Thai, Khmer, ...) every letter counts as a
word for the cuts and ``1 / WORD_LETTERS`` word for the floor, so 69 shared
letters are enough.

Runs are compared by 128-bit hashes over all documents.  The first occurrence,
by (doc_id, position), stays; pieces covered by any other occurrence are
removed.

Map tasks pre-aggregate: a block of documents sends each distinct run once,
with its smallest place, to the run's bucket.  A bucket task sorts its runs
and answers, for each block and run, whether it is repeated and whether the
block holds the first occurrence.  So a passage that a third of all documents
share costs one row per block, not one per document.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kerbside.llm.common import doc_text, pack_bytes, shuffle_width, unpack_bytes, worker_state
from kerbside.llm.quality import SENTENCE_MARK

MIN_WORDS = 20
WINDOW = 10  # sentences of up to so many words stay whole
BLOCK_CHARS = 5_000_000
HASHED_WORDS = 500_000  # word hashes kept by a worker; others are made again
NO_ID = 2**63 - 1

MARKS = SENTENCE_MARK[1:-1] + "\u0964\u0965\u06d4\u1362\u17d4\u104b\uff61"
SPACE, MARK, LETTER = 1, 2, 3
# scripts without spaces between words: Thai to Myanmar, Khmer, kana, Han
UNSPACED = ((0x0E00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x3040, 0x3100), (0xA980, 0xA9E0), (0xAA60, 0xAAE0))
HAN = ((0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xF900, 0xFB00), (0xFF66, 0xFF9E), (0x20000, 0x40000))
WORD_LETTERS = 2  # so many letters of those scripts measure as a word
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

ROWS = "block long, bucket int, deal int, blob binary, doc_ids array<long>, texts binary"


def row_schema() -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("bucket", pa.int32()),
            ("deal", pa.int32()),
            ("blob", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())),
            ("texts", pa.binary()),
        ]
    )


def _kinds() -> np.ndarray:
    """SPACE, MARK or LETTER by code point; other characters 0."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for a, b in HAN:
        kinds[a:b] = LETTER
    for a, b in UNSPACED:  # vowel and tone signs stay with their letter
        kinds[[c for c in range(a, b) if unicodedata.category(chr(c))[0] == "L"]] = LETTER
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = SPACE
    kinds[[ord(c) for c in MARKS]] = MARK
    return kinds


class _Hashes(dict):
    """64-bit hash of a word in lower case."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= HASHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return found


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, whether a sentence begins, length in letters of scripts
    without spaces) of the words of a text.  Letters of such scripts are words
    of their own, with the signs behind them; others measure WORD_LETTERS."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = worker_state("runs:kinds", _kinds)[points]
    solid = kind != SPACE
    ended = np.zeros(len(kind), dtype=bool)  # the character before ends a sentence
    ended[1:] = (kind[:-1] == MARK) & (kind[1:] != MARK)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | ended[1:] | (kind[1:] == LETTER)
    start = np.flatnonzero(begins)
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, bool), start
    end = solid.copy()
    end[:-1] &= ~solid[1:] | begins[1:]
    end = np.flatnonzero(end) + 1
    # a sentence mark or line feed between the word's start and the last one's
    breaks = np.cumsum(ended | (points == 10))
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = breaks[start[1:]] > breaks[start[:-1]]
    hashes = worker_state("runs:hashes", _Hashes)
    found = [hashes[text[a:b]] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return start, np.array(found, dtype=np.uint64), opens, np.where(kind[start] == LETTER, 1, WORD_LETTERS)


def _least(v: np.ndarray) -> np.ndarray:
    """Which values are the smallest of some WINDOW neighbours."""
    if len(v) < WINDOW:
        return np.zeros(len(v), dtype=bool)
    low = np.lib.stride_tricks.sliding_window_view(v, WINDOW).min(axis=1)
    edge = np.zeros(WINDOW - 1, dtype=v.dtype)
    held = np.concatenate([edge, low, edge])
    return v == np.lib.stride_tricks.sliding_window_view(held, WINDOW).max(axis=1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64, k < n."""
    inverse = pow(base, -1, 2**64)
    return tuple(
        np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n - 1, 0), b, dtype=np.uint64))])[:n]
        for b in (base, inverse)
    )


def runs(texts: list[str]) -> dict[str, np.ndarray]:
    """Pieces and runs of a block: piece start, end, document; run first and
    last piece (indices into the block) and 128-bit hash."""
    found = [words(text) for text in texts]
    count = np.array([len(f[0]) for f in found], dtype=np.int64)
    at, h, opens, length = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))
    h, opens = h.astype(np.uint64), opens.astype(bool)
    doc_of = np.repeat(np.arange(len(texts)), count)
    order = h.copy()
    order[1:] = (h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    order = (order ^ (order >> np.uint64(31))) | np.uint64(1)
    order[opens] = 0
    cuts = np.flatnonzero(opens | _least(order))
    n = len(cuts)
    start, doc = at[cuts], doc_of[cuts]
    end = np.append(start[1:], 0)
    of_doc = np.searchsorted(doc, np.arange(len(texts) + 1))
    lasts = of_doc[1:][np.diff(of_doc) > 0] - 1
    end[lasts] = [len(texts[d]) for d in doc[lasts].tolist()]
    border = np.append(cuts, len(h))  # words before each piece
    total = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)[border]
    least = MIN_WORDS * WORD_LETTERS
    index = np.arange(n)
    # shortest run that begins with i: ends at the first j with enough words
    j = np.maximum(np.searchsorted(total, total[:-1] + least) - 1, index + 1)
    ok = j < of_doc[doc + 1] if n else np.zeros(0, bool)
    # shortest run that ends with i
    k = np.minimum(np.searchsorted(total, total[1:] - least, side="right") - 1, index - 1)
    back = k >= of_doc[doc] if n else np.zeros(0, bool)
    ways = np.concatenate([index[ok] * (n + 1) + j[ok], k[back] * (n + 1) + index[back]]).astype(np.int64)
    first, last = np.divmod(np.unique(ways), n + 1)
    a, b = cuts[first], border[last + 1]
    keys = []
    for base in _BASES:
        power, inverse = _powers(base, len(h) + 1)
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(base)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[: len(h)], dtype=np.uint64)])
        key = (sums[b] - sums[a]) * inverse[a]
        keys.append((key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))
        h = h * np.uint64(0x94D049BB133111EB) + np.uint64(1)
    return {
        "start": start.astype(np.int64),
        "end": end.astype(np.int64),
        "doc": doc,
        "first": first,
        "last": last,
        "hi": keys[0],
        "lo": keys[1],
    }


def _distinct(r: dict[str, np.ndarray], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, head, group): runs sorted by (hash, doc_id, place), which of
    them is its hash's first in the block, and each one's distinct number."""
    doc = r["doc"][r["first"]] if len(r["first"]) else r["first"]
    order = np.lexsort((r["first"], doc_ids[doc] if len(doc) else doc, r["lo"], r["hi"]))
    hi, lo = r["hi"][order], r["lo"][order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return order, head, np.cumsum(head) - 1


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(d.as_py())
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _ids(doc_ids: list) -> np.ndarray:
    return np.array([NO_ID if d is None else d for d in doc_ids], dtype=np.int64)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) of every document; the
    pieces of a long sentence count as sentences.

    ``removed`` lists the removed stretches as start:end in code points of the
    given text, comma-joined; ``text`` is what is left.  Null texts count as
    empty; empty texts have no sentences.  Null ids come last in the order of
    occurrences.  Of rows with equal ids and texts, only one keeps a repeated
    passage.
    """
    width = shuffle_width(docs.sparkSession)

    def spread(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for n, (doc_ids, texts) in enumerate(_held(batches)):
            block = base + n
            ids = _ids(doc_ids)
            r = runs(texts)
            order, head, _ = _distinct(r, ids)
            many = np.diff(np.append(np.flatnonzero(head), len(order))) > 1
            one = order[head]
            hi, lo, first = r["hi"][one], r["lo"][one], r["first"][one]
            doc = ids[r["doc"][first]] if len(first) else first
            place = r["start"][first] if len(first) else first
            bucket = (hi % np.uint64(width)).astype(np.int64)
            rows = [
                {
                    "block": block,
                    "bucket": -1,
                    "deal": zlib.crc32(str(block).encode()) % width,
                    "doc_ids": doc_ids,
                    "texts": pack_bytes([t.encode() for t in texts], 3),
                }
            ]
            for b in np.unique(bucket).tolist():
                at = bucket == b
                raw = b"".join(x[at].astype("<u8").tobytes() for x in (hi, lo, doc, place, many))
                rows.append({"block": block, "bucket": b, "deal": b, "blob": zstandard.ZstdCompressor(3).compress(raw)})
            yield pa.RecordBatch.from_pylist(rows, schema=row_schema())

    def settle(batches):
        """Answers every bucket row with two bits a run: repeated, first here."""
        found: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            passed = []
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    passed.append(row)
                else:
                    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), "<u8").reshape(5, -1)
                    found.append((row["block"], row["bucket"], raw))
            if passed:
                yield pa.RecordBatch.from_pylist(passed, schema=row_schema())
        if not found:
            return
        all_runs = np.concatenate([f[2] for f in found], axis=1)
        block = np.repeat([f[0] for f in found], [f[2].shape[1] for f in found])
        order = np.lexsort((block, all_runs[3], all_runs[2].astype(np.int64), all_runs[1], all_runs[0]))
        hi, lo = all_runs[0][order], all_runs[1][order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        cuts = np.append(np.flatnonzero(head), len(order))
        several = np.repeat((np.diff(cuts) > 1) | np.maximum.reduceat(all_runs[4][order], cuts[:-1]).astype(bool), np.diff(cuts))
        answer = np.empty(len(order), dtype=np.uint8)
        answer[order] = several * np.uint8(1) + head * np.uint8(2)
        at = 0
        for b, bucket, raw in found:
            part = answer[at : at + raw.shape[1]]
            at += raw.shape[1]
            yield pa.RecordBatch.from_pylist(
                [{"block": b, "bucket": bucket, "blob": zstandard.ZstdCompressor(3).compress(part.tobytes())}],
                schema=row_schema(),
            )

    def remove(head_row: dict, answers: dict[int, bytes]) -> pa.RecordBatch:
        doc_ids = head_row["doc_ids"]
        lens, raw = unpack_bytes(head_row["texts"])
        ends = np.cumsum(lens, dtype=np.int64).tolist()
        texts = [raw[e - n : e].decode() for e, n in zip(ends, lens.tolist(), strict=True)]
        r = runs(texts)
        order, head, group = _distinct(r, _ids(doc_ids))
        hi = r["hi"][order[head]]
        bucket = (hi % np.uint64(width)).astype(np.int64)
        answer = np.zeros(len(hi), dtype=np.uint8)
        for b, blob in answers.items():
            answer[bucket == b] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        mine = answer[group]
        # repeated, and not the first occurrence of all
        gone = ((mine & 1) > 0) & ~(head & ((mine & 2) > 0))
        mark = np.zeros(len(r["start"]) + 1, dtype=np.int64)
        np.add.at(mark, r["first"][order[gone]], 1)
        np.add.at(mark, r["last"][order[gone]] + 1, -1)
        covered = np.cumsum(mark[:-1]) > 0
        of_doc = np.searchsorted(r["doc"], np.arange(len(texts) + 1))
        out = []
        for d, text in enumerate(texts):
            a, b = int(of_doc[d]), int(of_doc[d + 1])
            hit = np.flatnonzero(covered[a:b]) + a
            spans: list[list[int]] = []
            for i in hit.tolist():
                s, e = int(r["start"][i]), int(r["end"][i])
                if spans and spans[-1][1] >= s:
                    spans[-1][1] = e
                else:
                    spans.append([s, e])
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            out.append((doc_ids[d], b - a, len(hit), ",".join(f"{s}:{e}" for s, e in spans), "".join(kept)))
        columns = list(zip(*out, strict=True))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["doc_id", "n_sentences", "n_removed", "removed", "text"],
        )

    def clean(batches):
        head_row, answers = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(c)[k].as_py() for c, n in enumerate(batch.schema.names)}
                if row["bucket"] < 0:
                    if head_row is not None:
                        yield remove(head_row, answers)
                    head_row, answers = row, {}
                else:
                    answers[row["bucket"]] = row["blob"]
        if head_row is not None:
            yield remove(head_row, answers)

    return (
        doc_text(docs, id_col, text_col)
        .mapInArrow(spread, ROWS)
        .repartition(width, "deal")
        .mapInArrow(settle, ROWS)
        .repartition(width, "block")
        .sortWithinPartitions("block", "bucket")
        .mapInArrow(clean, "doc_id long, n_sentences long, n_removed long, removed string, text string")
    )
