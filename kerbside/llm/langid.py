"""Language identification: multinomial naive Bayes over hashed character
n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import smallest_hashes, worker_state

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
TRAIN_DOCS_PER_LANGUAGE = 2000  # bound of the training sample; whole texts
SLICE_CHARS = 500_000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, document) of all n-grams of lower-case letter runs; a run is
    set off by one space on its right, and by one at the text's start."""
    letters = worker_state("letters", letter_table)
    lowered = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    is_letter = letters[points]
    # one space after each run of letters, and the one before the first
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    starts = np.ones(len(doc), dtype=bool)
    starts[1:] = doc[1:] != doc[:-1]
    keep |= starts
    c = np.where(is_letter, points, np.uint32(32))[keep].astype(np.uint32)
    doc = doc[keep]
    found, owner = [], []
    h = np.zeros(len(c), dtype=np.uint32)
    for k in range(max(ORDERS)):
        n = len(c) - k
        if n <= 0:
            break
        h = (h[:n] ^ c[k:]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            inside = doc[:n] == doc[k:]
            if k == 0:
                inside = c != 32
            found.append((mixed >> np.uint32(16))[inside])
            owner.append(doc[:n][inside])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner)


def _slices(texts: list):
    """(first row, texts) of about SLICE_CHARS characters each."""
    first, held, chars = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t or "")
        chars += len(held[-1])
        if chars >= SLICE_CHARS:
            yield first, held
            first, held, chars = k + 1, [], 0
    if held:
        yield first, held


def fit(labelled: DataFrame, per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix buckets x languages, log priors)
    from rows (doc_id, text, lang) with a language.

    At most ``per_language`` documents of each language, those with the
    smallest hash of their id; priors are counted over all rows.
    """
    sample = smallest_hashes(labelled, "lang", per_language).select("doc_id", "lang")
    rows = labelled.join(F.broadcast(sample), ["doc_id", "lang"])  # at most per_language ids a language

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in _slices(texts):
                bucket, doc = features(part)
                at = np.array(langs[first : first + len(part)], dtype=object)[doc] if len(doc) else np.zeros(0, object)
                for lang in set(langs[first : first + len(part)]):
                    mine = np.bincount(bucket[at == lang], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + mine
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counts = (
        rows.select("text", "lang")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most BUCKETS rows a language
    )
    priors = labelled.groupBy("lang").count().toPandas().set_index("lang")["count"]
    langs = sorted(priors.index)
    matrix = np.zeros((BUCKETS, len(langs)))
    at = {lang: k for k, lang in enumerate(langs)}
    matrix[counts["bucket"].to_numpy(dtype=np.int64), counts["lang"].map(at).to_numpy(dtype=np.int64)] = counts["n"]
    log_p = np.log((matrix + SMOOTHING) / (matrix.sum(axis=0) + SMOOTHING * BUCKETS))
    prior = np.array([priors[lang] for lang in langs], dtype=np.float64)
    return langs, log_p.astype(np.float32), np.log(prior / prior.sum()) if len(langs) else prior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of rows (doc_id, text).

    ``score`` is the posterior probability of the predicted language.  Null
    texts and texts without a letter are ``und`` with score 0; so is every
    text when the model has no language.  Ties go to the first language by
    name.  Repeated rows are scored each.
    """
    langs, log_p, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((log_p, prior))

    def run(batches):
        log_p, prior = shared.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            picked = np.full(len(texts), len(langs))
            score = np.zeros(len(texts))
            for first, part in _slices(texts) if langs else ():
                bucket, doc = features(part)
                if not len(doc):
                    continue
                total = np.stack(
                    [np.bincount(doc, weights=log_p[:, k][bucket], minlength=len(part)) for k in range(len(langs))], axis=1
                )
                seen = np.bincount(doc, minlength=len(part)) > 0
                total += prior
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                at = np.flatnonzero(seen)
                picked[first + at], score[first + at] = best[at], share[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[picked], pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """Fit on the rows of (doc_id, text, lang) where ``training`` holds and
    the language is known, predict all rows."""
    rows = with_columns(docs)
    return predict(rows, fit(rows.where(training & F.col("lang").isNotNull())))
