"""The dealt operators' registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.llm import ann, bpe, decontaminate, filter_audit, jaccard, langid, pii, prefix_trie, quality, substrings, token_counts, token_store, toxicity
from kerbside.llm.common import doc_text, split_of, table


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = split_of(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, F.coalesce(~held_out, F.lit(False)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_store(spark, sf_dir):
    return token_store.store(table(spark, sf_dir, "documents"))


def op3_personal_data(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = doc_text(table(spark, sf_dir, "documents"))
    held_out = split_of(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & ~held_out).select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.measure(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_nearest_vectors(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_store": op2_token_store,
    "op3_personal_data": op3_personal_data,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_nearest_vectors": op11_nearest_vectors,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op9_quality_rules": quality.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
