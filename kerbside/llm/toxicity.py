"""Toxicity from class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary labelled
documents, over document counts (a bigram that one document repeats counts
once).  Below each lie two orders of continuation counts: in how many distinct
left contexts the class has a word, and, shared by both classes, in how many
the whole corpus has it.  An absolute discount, the same share of either
class's counts, moves the mass of rare expressions to the shared counts: both
models then rest on them, and a rare expression hardly tells the classes apart.
Nothing that the sample holds is left out of the models.

A document's evidence is the difference of its two log-likelihoods, normalised
by length, over the whole text and over its most suspicious stretch of
``STRETCH`` words; a logistic curve fitted on labelled documents that the
models did not see turns both into a probability, and its loss chooses among
``DISCOUNTS``.

Words are held as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import smallest_hashes, worker_state
from kerbside.plans.stage import materialize

TRAIN_DOCS_PER_CLASS = 4000  # bound of the labelled sample; whole texts
CALIBRATION_SHARE = 4  # every fourth sampled document calibrates
STRETCH = 4
DISCOUNTS = ((0.0, 0.0), (1e-5, 1e-4), (3e-5, 3e-4), (6e-5, 6e-4), (2e-4, 2e-3))  # shares of a class's word types, of its bigrams
LEAST_DISCOUNT = 0.75
START = 0  # stands before a text's first word
SLICE_CHARS = 1 << 20
HELD_BIGRAMS = 1 << 21  # distinct bigrams that a task holds before it hands them on
SLOT_TYPES = 64  # distinct bigrams of the sample that make one slot of a word


def _letters() -> np.ndarray:
    """Which code points belong to a word, as the pattern ``\\w`` has it."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ``\\w``, in lower case) of the texts (null:
    none), and each text's number of words.  A hash is a polynomial in the
    word's code points, summed for all words at once."""
    lowered = [(t or "").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = worker_state("toxicity-letters", _letters)[points]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    letter = _mixed((points[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    words = _mixed(np.add.reduceat(letter * power[place], first)).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)))
    lens = np.diff(np.searchsorted(at[first], ends), prepend=0)
    return words, lens


def _before(words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The word before each one, START at a text's first."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    ends = np.cumsum(lens)
    out[(ends - lens)[lens > 0]] = START
    return out


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of a bigram."""
    return _mixed(v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)).view(np.int64)


def _slices(batches):
    """(columns but the first, texts) of about SLICE_CHARS characters each,
    from batches whose first column is the text."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        first, chars = 0, 0
        for k, t in enumerate(texts):
            chars += len(t or "")
            if chars >= SLICE_CHARS or k + 1 == len(texts):
                part = batch.slice(first, k + 1 - first)
                yield part.columns[1:], texts[first : k + 1]
                first, chars = k + 1, 0


def sample(labels: DataFrame, per_class: int = TRAIN_DOCS_PER_CLASS) -> DataFrame:
    """(doc_id, toxic, role): at most ``per_class`` labelled ids of a class,
    those with the smallest hash."""
    role = F.when(F.col("rank") % CALIBRATION_SHARE == 0, "calibrate").otherwise("fit")
    return smallest_hashes(labels, "toxic", per_class).select("doc_id", "toxic", role.alias("role"))


def bigram_counts(rows: DataFrame) -> DataFrame:
    """(v, w, toxic_n, plain_n): documents by class that have the word w after v."""

    def count(batches):
        for (toxic,), texts in _slices(batches):
            words, lens = word_hashes(texts)
            doc = np.repeat(np.arange(len(texts)), lens)
            v = _before(words, lens)
            pair = _pair_key(v, words)
            order = np.lexsort((pair, doc))
            once = order[np.diff(pair[order], prepend=0).astype(bool) | np.diff(doc[order], prepend=-1).astype(bool)]  # a document's repeats once
            is_toxic = np.asarray(toxic.to_pylist(), dtype=bool)[doc[once]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[once]), pa.array(words[once]), pa.array(is_toxic), pa.array(1 - is_toxic)], names=["v", "w", "toxic_n", "plain_n"]
            )

    return (
        rows.select("text", F.col("toxic") == 1)
        .mapInArrow(count, "v long, w long, toxic_n long, plain_n long")
        .groupBy("v", "w")
        .agg(F.sum("toxic_n").alias("toxic_n"), F.sum("plain_n").alias("plain_n"))
    )


def _slots(batches, known: np.ndarray, parts: np.ndarray):
    """(slot, contexts) rows of batches of texts: a known word's contexts, each
    once, as 32 bits of the bigrams' hashes, dealt by these over the word's
    ``parts``; ``slot`` is the word's place and its part."""

    def rows(key):
        word, context = key >> 32, key & 0xFFFFFFFF
        slot = word << 32 | context * parts[word] >> 32
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(context.astype(np.uint32).view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(slot[first]), lists], names=["slot", "contexts"])

    held, size = [], 0
    for _, texts in _slices(batches):
        words, lens = word_hashes(texts)
        at = _index(known, words)
        held.append(np.unique((at << 32 | _pair_key(_before(words, lens), words) & 0xFFFFFFFF)[at < len(known)]))
        size += len(held[-1])
        if size >= HELD_BIGRAMS:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            if size >= HELD_BIGRAMS // 2:  # else few are new, and more may come
                yield rows(held[0])
                held, size = [], 0
    if size:
        yield rows(np.unique(np.concatenate(held)))


def continuations(docs: DataFrame, vocabulary: np.ndarray, types: np.ndarray | None = None) -> np.ndarray:
    """In how many distinct left contexts the corpus has each word of the
    sorted ``vocabulary``; 32 bits of a bigram's hash tell the contexts of one
    word apart.

    The contexts of a word travel together, so that its name is not repeated
    with each.  ``types``, some sample's bigrams by last word, tells which words
    have many: theirs go to several slots, so no task gets all of a word."""
    parts = np.ones(len(vocabulary), dtype=np.int64) if types is None else 1 + types.astype(np.int64) // SLOT_TYPES
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, parts))
    lists = docs.select("text").mapInArrow(lambda batches: _slots(batches, *shared.value), "slot long, contexts array<int>")
    seen = lists.repartition("slot").select("slot", F.explode("contexts").alias("context")).distinct()  # distinct where they are
    counted = seen.groupBy(F.shiftright("slot", 32).alias("word")).count().toArrow()  # a row for each word of the sample
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[counted.column("word").to_numpy()] = counted.column("count").to_numpy()
    return out


def with_others(shared: np.ndarray, vocabulary: np.ndarray, words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``continuations`` with the bigrams that end in any other word as its last
    entry: their share is that among the bigrams of texts that the vocabulary
    was not made from."""
    pair, once = np.unique(_pair_key(_before(words, lens), words), return_index=True)
    other = int((_index(vocabulary, words[once]) == len(vocabulary)).sum())
    return np.append(shared, shared.sum() * other / max(len(pair) - other, 1))


def _index(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known``; its length where there is none."""
    if not len(known):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, len(known))


def kneser_ney(bigrams: tuple, shared: np.ndarray, discounts: tuple[float, float] = DISCOUNTS[0]) -> dict:
    """Probabilities of both classes (0 ordinary, 1 toxic), as plain arrays.

    ``bigrams``: (v, w, (plain, toxic)) with places of words and document
    counts; ``shared``: of ``with_others``, its last place stands for every
    other word; ``discounts``: shares of a class's word types and bigrams, at
    least LEAST_DISCOUNT of one.  ``low`` is the shared order; of each class,
    ``word`` is its continuation order over that, ``left`` the mass that a
    context leaves to it, ``pair`` the interpolated bigrams."""
    v, w, counts = bigrams
    size = len(shared)
    low = (shared + 0.5) / (shared.sum() + 0.5 * size)
    out = {"v": v, "w": w, "low": low, "word": [], "left": [], "pair": []}
    for n in counts:
        types = np.bincount(w[n > 0], minlength=size)
        given = np.minimum(types, max(LEAST_DISCOUNT, discounts[0] * types.sum()))
        word = (types - given + given.sum() * low) / types.sum() if types.any() else low
        given = np.minimum(n, max(LEAST_DISCOUNT, discounts[1] * n.sum()))
        seen = np.bincount(v, weights=n, minlength=size)
        some = np.maximum(seen, 1)
        left = np.where(seen > 0, np.bincount(v, weights=given, minlength=size) / some, 1.0)
        out["word"].append(word)
        out["left"].append(left)
        out["pair"].append((n - given) / some[v] + left[v] * word[w])
    return out


def ratios(vocabulary: np.ndarray, p: dict) -> dict:
    """Log-likelihood ratios (toxic to ordinary) of ``kneser_ney``'s models."""
    keys = _pair_key(vocabulary[p["v"]], vocabulary[p["w"]])
    order = np.argsort(keys)
    log = {k: (np.log(p[k][1]) - np.log(p[k][0])).astype(np.float32) for k in ("word", "left", "pair")}
    return {"vocabulary": vocabulary, "keys": keys[order], "words": log["word"], "contexts": log["left"], "pairs": log["pair"][order]}


def evidence(model: dict, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean ratio, mean ratio of the most suspicious stretch) of each text
    of ``word_hashes``."""
    v = _before(words, lens)
    w = _index(model["vocabulary"], words)
    before = _before(w, lens)
    before[v == START] = _index(model["vocabulary"], np.array([START]))[0]
    r = model["words"][w] + model["contexts"][before]
    at = _index(model["keys"], _pair_key(v, words))
    hit = at < len(model["keys"])
    r[hit] = model["pairs"][at[hit]]
    total = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
    ends = np.cumsum(lens)
    mean = (total[ends] - total[ends - lens]) / np.maximum(lens, 1)
    top = np.zeros(len(lens))
    for k, (n, end) in enumerate(zip(lens, ends, strict=True)):
        if n:
            inside, step = total[end - n : end + 1], min(n, STRETCH)
            top[k] = (inside[step:] - inside[:-step]).max() / STRETCH
    return mean, top


def _hashed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(toxic, words, lens) of sampled rows (text, toxic), on the driver."""

    def run(batches):
        for (toxic,), texts in _slices(batches):
            words, lens = word_hashes(texts)
            parts = [part.tobytes() for part in np.split(words, np.cumsum(lens)[:-1])]
            yield pa.RecordBatch.from_arrays([toxic, pa.array(parts, pa.binary())], names=["toxic", "words"])

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, words binary").toArrow()
    parts = found.column("words").to_pylist()
    lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 8
    return found.column("toxic").to_numpy().astype(np.float64), np.frombuffer(b"".join(parts), dtype=np.int64), lens


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights (last: intercept) of a logistic curve: Newton steps on scaled
    columns, each halved until the penalised loss falls."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.append(np.full(len(scale), penalty), 1e-6)

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2

    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(b - t * step) > loss(b):
            t /= 2
        b = b - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return b / np.append(scale, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS_PER_CLASS) -> tuple[dict | None, np.ndarray]:
    """(model, curve) from the corpus (doc_id, text) and the labels (doc_id,
    toxic 0/1) to learn from.  No label of some class: no model, and the curve
    says the other class always."""
    classes = labels.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).toPandas().set_index("toxic")["n"]
    toxic_n, plain_n = int(classes.get(1, 0)), int(classes.get(0, 0))
    if not toxic_n or not plain_n:
        return None, np.array([0.0, 0.0, 30.0 if toxic_n else -30.0])
    # the sample's ids are at most 2 x per_class: the corpus is not shuffled for them
    rows = materialize(docs.join(F.broadcast(sample(labels, per_class)), "doc_id"), "llm-toxic-sample")
    fitting = rows.where("role = 'fit'")
    sizes = fitting.groupBy("toxic").count().toPandas().set_index("toxic")["count"]
    docs_by_class = int(sizes.get(0, 0)), int(sizes.get(1, 0))
    if not all(docs_by_class):
        return None, np.array([0.0, 0.0, -30.0 if docs_by_class[0] else 30.0])
    seen = bigram_counts(fitting).toArrow()  # bounded by the sample
    v, w, plain, toxic = (seen.column(c).to_numpy() for c in ("v", "w", "plain_n", "toxic_n"))
    vocabulary = np.union1d(v, w)
    bigrams = _index(vocabulary, v).astype(np.int32), _index(vocabulary, w).astype(np.int32), [plain.astype(np.int32), toxic.astype(np.int32)]
    del seen, v, w, plain, toxic
    y, *unseen = _hashed(rows.where("role = 'calibrate'"))  # bounded by the sample
    types = np.bincount(bigrams[1], minlength=len(vocabulary))
    shared = with_others(continuations(docs, vocabulary, types), vocabulary, *unseen)
    if not len(y):
        return ratios(vocabulary, kneser_ney(bigrams, shared)), np.array([0.0, 1.0, -1.0])
    share, rate = (max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)), toxic_n / (toxic_n + plain_n)
    weight = np.where(y == 1, rate / share[0], (1 - rate) / share[1])
    best = None
    for discounts in DISCOUNTS:
        model = ratios(vocabulary, kneser_ney(bigrams, shared, discounts))
        x = np.column_stack(evidence(model, *unseen))
        curve = logistic(x, y, weight)
        z = x @ curve[:2] + curve[2]
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        if best is None or loss < best[0]:
            best = loss, model, curve
    return best[1:]


def score(docs: DataFrame, fitted: tuple[dict | None, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted, mean_ratio, top_ratio) of rows (doc_id, text).

    Null and empty texts have no evidence and get the curve's value at zero.
    Repeated rows are scored each."""
    model, curve = fitted
    if model is None:
        seen = docs.select("doc_id", F.lit(0.0).alias("mean_ratio"), F.lit(0.0).alias("top_ratio"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            model = shared.value
            for (doc_id,), texts in _slices(batches):
                mean, top = evidence(model, *word_hashes(texts))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(mean), pa.array(top)], names=["doc_id", "mean_ratio", "top_ratio"])

        kind = dict(docs.dtypes)["doc_id"]
        seen = docs.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, mean_ratio double, top_ratio double")
    a, b, c = (float(x) for x in curve)
    z = F.col("mean_ratio") * a + F.col("top_ratio") * b + c
    return seen.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), z)))).select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_ratio", "top_ratio"
    )
