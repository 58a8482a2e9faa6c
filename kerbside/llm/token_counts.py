"""Token counts: each distinct pre-token is counted once, joined to the
documents' pre-token frequencies, and summed without materialising ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbside.llm.common import doc_text, unpack_ints, worker_state
from kerbside.llm.words import blocks, coded, coded_blocks


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) as the tokenizers library counts.

    For byte-level tokenizers whose split pattern is the rank files' one.
    Null and empty texts: 0 bytes, 0 tokens.  A special string inside a text
    is one token (the library's default); it holds no white space, so no unit
    boundary falls inside it.  Repeated rows are counted each.
    """
    import public_tokenizers

    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    # a special string is a unit of its own, also where the pattern cuts the text
    pattern = special_first(tokenizer_path, public_tokenizers.PATTERN)

    def make_encoder():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_path)
        own.no_truncation()
        own.no_padding()
        return lambda units: [
            np.uint32(len(e.ids)).tobytes() for e in own.encode_batch_fast(units, add_special_tokens=False)
        ]

    def total(batches):
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
        )
        for head, starts, _, flat in coded_blocks(batches):
            lens = unpack_ints(head["doc_units"]).astype(np.int64)
            counts = flat[starts].astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(counts[unpack_ints(head["units"])] * unpack_ints(head["freqs"]))])
            ends = np.cumsum(lens)
            tokens = sums[ends] - sums[ends - lens]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(head["doc_ids"], pa.int64()),
                    pa.array(head["doc_bytes"], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(tokens > limit, pa.bool_()),
                ],
                schema=schema,
            )

    rows = blocks(doc_text(docs), pattern, frequencies=True)
    return coded(rows, lambda: worker_state(f"tokenizers:{tokenizer_path}", make_encoder)).mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def special_first(tokenizer_path: str, pattern: str) -> str:
    """The split pattern, cutting out the tokenizer's special strings first."""
    import json
    import re

    with open(tokenizer_path, encoding="utf-8") as f:
        special = [re.escape(t["content"]) for t in json.load(f)["added_tokens"]]
    if not special:
        return pattern
    stop = "(?:" + "|".join(special) + ")"
    # text up to the next special string is cut on its own: white space before
    # one counts as trailing white space
    return f"{stop}|" + pattern.replace(r" ?[^\s\p{L}\p{N}]+", rf" ?(?:(?!{stop})[^\s\p{{L}}\p{{N}}])+").replace(
        r"\s+(?!\S)", rf"\s+(?={stop}|(?!\S))"
    )
