"""The corpus pipeline: documents in, token ids out.

Every stage reads the whole of what its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from kerbside.llm import bpe, decontaminate, jaccard, pii, quality
from kerbside.llm.common import table
from kerbside.plans.stage import materialize


def quality_rules(spark, docs, sf_dir):
    """Lines that fail the line rules are removed; rejected documents go."""
    return quality.clean_documents(docs)


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each near-duplicate class stays: its smallest id."""
    return jaccard.first_of_class(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data is masked."""
    return pii.mask_documents(docs)


def byte_bpe(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

ORACLE_SQL = None  # MinHash, random field and BPE are not expressible; see tests/llm


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
