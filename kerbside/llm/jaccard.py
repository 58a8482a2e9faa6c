"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Texts become sets of five-word shingles; documents with equal sets form
   one *copy class*, and only its smallest row goes on, with the class size.
2. MinHash signatures, cut into bands, tie documents that may be similar.
   Those that bands connect form a candidate *component*.  A component is one
   group of work; if bands merely chain it together, so that its *buckets*
   (documents that share one band) hold fewer pairs, every bucket is a group.
3. A group is dealt into blocks.  Inside a block, and then between every two
   blocks of a group, signatures are compared 16 values at a time; a pair is
   dropped as soon as the posterior probability of reaching the threshold,
   given the values that agree so far, is below ``TOLERANCE``.  The pairs that
   are left are verified exactly on their shingle sets.  In buckets, a pair
   counts at the first band that it shares.
4. Pairs never become rows.  A block gives each document's number of links and
   its label, the smallest document it is connected to inside the block; two
   blocks give numbers of links, and links between labels.  Texts are read
   once a group, by its blocks; between blocks only signatures and shingle sets
   move.  Labels that links connect are one class.

The band scheme misses a pair at similarity 0.8 with probability 3e-6.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.plans.stage import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
BLOCK = 256  # documents of a block
BLOCK_SHINGLES = 1 << 19  # and their shingles
NO_ID = 2**63 - 1  # stands for a null id in joins and in the order of ids
BLOCKS = "rep long, kind int, grp long, blocks int, mine int, copies long, links long, label long, sig binary, hashes binary"
CROSS = "rep long, links long, u long, v long"
WORDS_KEPT = 150_000  # words whose hash a task remembers

WORD = re.compile(r"\w+")
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64
)


def multipliers(n: int = VALUES) -> np.ndarray:
    """Odd 64-bit multipliers of the MinHash functions, from a fixed seed."""
    return np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a text of one
    to four words is one shingle; no words, none."""
    import xxhash

    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > WORDS_KEPT:
        known.clear()
    codes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(h)
    a = np.array(codes, dtype=np.uint64)
    n = max(1, len(a) - SHINGLE + 1)
    h = np.full(n, len(a) if len(a) < SHINGLE else SHINGLE, dtype=np.uint64)
    for k in range(min(SHINGLE, len(a))):
        h = (h ^ (a[k : k + n] * _MIX[k])) * _MIX[(k + 1) % 5]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray, a: np.ndarray) -> np.ndarray:
    """MinHash values (32-bit) of a non-empty set."""
    best = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 256):
        values = ((h[i : i + 256, None] * a) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, values.min(axis=0), out=best)
    return best


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least matches to go on), for a uniform prior: after m
    of n matches the similarity is Beta(m + 1, n - m + 1), and it exceeds t
    with the probability that Binomial(n + 1, t) is at most m."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, least = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                least = m
                break
        out.append((n, least))
    return out


def survivors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that pass every step of the incremental comparison."""
    rules = least_matches()
    n, least = rules[0]
    matches = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(n):
        matches += left[:, k][:, None] == right[:, k][None, :]
    i, j = np.nonzero(matches >= least)
    m = matches[i, j].astype(np.int32)
    for (a, _), (b, least) in zip(rules[:-1], rules[1:], strict=True):
        m = m + (left[i, a:b] == right[j, a:b]).sum(axis=1)
        on = m >= least
        i, j, m = i[on], j[on], m[on]
    return i, j


def common_counts(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs of sorted sets."""
    if len(i) <= 64:
        return np.array(
            [len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)],
            dtype=np.int64,
        )
    # many pairs of few sets: incidence matrices over slices of the shingles
    used_l, used_r = np.unique(i), np.unique(j)
    flat = np.concatenate([left[a] for a in used_l] + [right[b] for b in used_r])
    owner = np.repeat(
        np.arange(len(used_l) + len(used_r)), [len(left[a]) for a in used_l] + [len(right[b]) for b in used_r]
    )
    vocabulary, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    counts = np.zeros((len(used_l), len(used_r)), dtype=np.float32)
    width = max(512, (1 << 20) // (len(used_l) + len(used_r)))
    for lo in range(0, len(vocabulary), width):
        s, e = np.searchsorted(number, [lo, lo + width])
        m = np.zeros((len(used_l) + len(used_r), width), dtype=np.float32)
        m[owner[s:e], number[s:e] - lo] = 1
        counts += m[: len(used_l)] @ m[len(used_l) :].T
    return counts[np.searchsorted(used_l, i), np.searchsorted(used_r, j)].astype(np.int64)


def links_between(left: list[dict], right: list[dict] | None, threshold: float, band: int = -1) -> tuple[list[int], list[int]]:
    """Linked index pairs of two blocks, or inside one (``right`` is None); in
    a bucket of ``band``, those that share no band before it."""
    same = right is None
    right = left if same else right
    sl = np.stack([r["sig"] for r in left])
    sr = sl if same else np.stack([r["sig"] for r in right])
    i, j = survivors(sl, sr)
    if same:
        i, j = i[i < j], j[i < j]
    for k in range(band):
        if len(i):
            apart = (sl[i, k * ROWS : (k + 1) * ROWS] != sr[j, k * ROWS : (k + 1) * ROWS]).any(axis=1)
            i, j = i[apart], j[apart]
    if not len(i):
        return [], []
    hl, hr = [r["set"] for r in left], [r["set"] for r in right]
    nl, nr = np.array([len(h) for h in hl]), np.array([len(h) for h in hr])
    fits = np.minimum(nl[i], nr[j]) >= threshold * np.maximum(nl[i], nr[j]) - 1e-9
    i, j = i[fits], j[fits]
    if not len(i):
        return [], []
    both = common_counts(hl, hr, i, j)
    linked = both >= threshold * (nl[i] + nr[j] - both) - 1e-9
    return i[linked].tolist(), j[linked].tolist()


def sign(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, set_key, n, sig) of rows (doc, text_hash, text).

    ``set_key`` is a 128-bit digest of the shingle set."""

    def run(batches):
        import xxhash

        a = multipliers()
        known: dict[str, int] = {}
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for t in batch.column(2):
                h = shingles(t.as_py(), known)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                sigs.append(signature(h, a).tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
                names=["doc", "text_hash", "set_key", "n", "sig"],
            )

    return rows.mapInArrow(run, "doc long, text_hash long, set_key binary, n int, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex connected to v, for every vertex of the
    (u, v) edges.  Labels go to neighbours, then to the label's own label,
    until none changes; every round is cut off in the shared folder."""
    both = materialize(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "llm-edges"
    )
    labels = materialize(
        both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "llm-labels"
    )
    while True:
        near = (
            both.join(labels, "v")
            .groupBy("u")
            .agg(F.min("label").alias("near"))
            .select(F.col("u").alias("v"), "near")
        )
        moved = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        # the label is a vertex itself; its own newest label is at least as small
        onward = moved.select(F.col("v").alias("mid"), F.col("mid").alias("far"))
        new = materialize(
            moved.join(onward, "mid", "left").select("v", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")),
            "llm-labels",
        )
        labels = new.select("v", "label")
        if new.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            return labels


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    keep_rows: bool = False,
) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links) of every document.

    ``n_links``: other documents whose shingle sets have Jaccard similarity of
    at least ``threshold`` with this one's, copies included.  ``class_id``:
    smallest doc_id among all documents reached over links (null ids count as
    largest).  ``copy_id``: smallest doc_id with the same shingle set.  Texts
    without a word, and null texts, link with nothing and are their own class;
    texts of one to four words equal only the same words.  Repeated rows are
    copies of each other.  ``keep_rows`` gives (row, is_first) instead: a
    struct of the input's columns for each id and text (of several rows, the one
    whose other columns come first as JSON), and whether it stands for its class.
    """
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialize(sign(rows), "llm-signed")

    # copy classes: one row for each shingle set, named by its smallest row
    who = F.struct("doc", "text_hash")
    copies = materialize(
        signed.where("n > 0")
        .groupBy("set_key")
        .agg(F.count("*").alias("copies"), F.min(who).alias("who"), F.first("sig").alias("sig"), F.first("n").alias("n"))
        # numbers that are stored with the rows: the graph's vertices
        .select(F.monotonically_increasing_id().alias("rep"), "set_key", "copies", "who.doc", "who.text_hash", "sig", "n"),
        "llm-copies",
    )

    # candidate components over shared bands
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * ROWS * 4 + 1, ROWS * 4)) for b in range(BANDS)])
    bands = copies.select("rep", "n", F.posexplode(keys).alias("kind", "band"))
    buckets = (
        bands.groupBy("band")
        .agg(F.min("rep").alias("first"), F.count("*").alias("size"), F.sum("n").alias("shingles"))
        .where("size > 1")
    )
    shared = bands.join(buckets.select("band", "first"), "band").select("rep", "first")
    # a document and the first ones of its bands (at most BANDS) all hang on
    # the smallest of them: as connected, with far fewer different edges
    tied = shared.groupBy("rep").agg(F.collect_set("first").alias("firsts"))
    tied = tied.select(F.array_union("firsts", F.array("rep")).alias("tied"))
    edges = (
        tied.select(F.array_min("tied").alias("v"), F.explode("tied").alias("u")).where("u <> v").select("u", "v").distinct()
    )
    component = components(edges)
    member = _groups(copies, bands, buckets, component)
    placed = (
        rows.join(member.hint("merge"), ["doc", "text_hash"])  # members grow with the corpus: never broadcast
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .select("kind", "grp", "mine", "blocks", "rep", "copies", "text")
    )
    unit = ["kind", "grp", "mine"]
    blocks = materialize(
        placed.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_by_unit(unit, _block(threshold), BLOCKS), BLOCKS), "llm-blocks"
    )
    # block pairs: a document's signature and set go to every pair its block is in
    pair = ["kind", "grp", "a", "b"]
    pairs = (
        blocks.where("blocks > 1")
        .withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine"))))
        .select("kind", "grp", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "rep", "copies", "label", "sig", "hashes")
    )
    cross = materialize(
        pairs.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_by_unit(pair, _block_pair(threshold), CROSS), CROSS), "llm-cross"
    )
    counted = blocks.where("links > 0").select("rep", "links").unionByName(cross.where("rep is not null").select("rep", "links"))
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    # a component of one block is settled; other labels are tied by their links
    alone = (F.col("blocks") == 1) & (F.col("kind") < 0)
    settled = blocks.where(alone).select("rep", "label")
    ties = blocks.where(~alone & (F.col("rep") != F.col("label"))).select(F.col("rep").alias("u"), F.col("label").alias("v"))
    ties = ties.unionByName(cross.where("u is not null").select("u", "v"))
    if ties.limit(1).count():
        settled = settled.unionByName(components(ties).select(F.col("v").alias("rep"), "label"))
    classes = (
        copies.drop("sig", "n")
        .join(settled, "rep", "left")
        .join(links, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    least = classes.groupBy("label").agg(F.min(who).alias("first"))
    by_set = classes.join(least, "label").select(
        "set_key",
        F.col("doc").alias("copy"),
        F.col("first"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    every = signed.select("doc", "text_hash", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(
        by_set, "set_key", "left"
    )

    def shown(c):
        return F.nullif(c, F.lit(NO_ID))

    if not keep_rows:
        return every.select(
            shown(F.col("doc")).alias("doc_id"),
            shown(F.coalesce("first.doc", "doc")).alias("class_id"),
            shown(F.coalesce("copy", "doc")).alias("copy_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    standing = every.select("doc", "text_hash", F.coalesce(F.col("first") == who, F.lit(True)).alias("is_first")).distinct()
    others = [c for c in docs.columns if c != text_col]
    whole = docs.select(
        doc.alias("doc"), F.xxhash64(text).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])).alias("others"),
    )
    # of rows of one id and text, the one whose other columns come first
    first_row = Window.partitionBy("doc", "text_hash").orderBy("others")
    return (
        whole.join(standing, ["doc", "text_hash"])
        .withColumn("place", F.row_number().over(first_row))
        .where("place = 1")
        .select("row", "is_first")
    )


def _groups(copies: DataFrame, bands: DataFrame, buckets: DataFrame, component: DataFrame) -> DataFrame:
    """(rep, kind, grp, blocks, copies, doc, text_hash): the groups of work that
    documents belong to.  A component is one (kind -1), unless its buckets hold
    fewer pairs than it; then each of them is (kind: its band's place)."""
    known = copies.select("rep", "n")
    sizes = (
        component.join(known, F.col("v") == F.col("rep"))
        .groupBy("label")
        .agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    )
    pairs = F.sum(F.col("size").cast("double") * F.col("size")).alias("pairs")
    in_buckets = buckets.join(component, F.col("first") == F.col("v")).groupBy("label").agg(pairs)

    def blocks(size: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int").alias("blocks")

    parted = materialize(
        sizes.join(in_buckets, "label").select(
            "label",
            blocks(F.col("size"), F.col("shingles")),
            ((F.col("size") > BLOCK) & (F.col("pairs") < F.col("size").cast("double") * F.col("size"))).alias("chained"),
        ),
        "llm-components",
    )
    placed = component.join(parted, "label")
    groups = placed.where("not chained").select(F.col("v").alias("rep"), F.lit(-1).alias("kind"), F.col("label").alias("grp"), "blocks")
    if parted.where("chained").limit(1).count():
        chained = placed.where("chained").select(F.col("v").alias("rep"))
        sized = buckets.select("band", blocks(F.col("size"), F.col("shingles")))
        groups = groups.unionByName(
            bands.join(chained, "rep").join(sized, "band").select("rep", "kind", F.col("band").alias("grp"), "blocks")
        )
    return materialize(groups.join(copies.select("rep", "copies", "doc", "text_hash"), "rep"), "llm-members")


class _Labels:
    """Union-find: everything is labelled by the smallest it is connected to."""

    def __init__(self, items):
        self.root = {x: x for x in items}

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def tie(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _count_links(left: list[dict], right: list[dict], i: list[int], j: list[int]) -> dict[int, int]:
    links: dict[int, int] = {}
    for x, y in zip(i, j, strict=True):
        p, q = left[x], right[y]
        links[p["rep"]] = links.get(p["rep"], 0) + q["copies"]
        links[q["rep"]] = links.get(q["rep"], 0) + p["copies"]
    return links


def _block(threshold: float):
    """One block of a group: (BLOCKS) rows, sets kept where other blocks ask."""
    factors = multipliers()
    known: dict[str, int] = {}

    def unit(rows: list[dict]) -> list[tuple]:
        rows = list({r["rep"]: r for r in rows}.values())  # repeated rows came twice
        for r in rows:
            r["set"] = shingles(r.pop("text"), known)
            r["sig"] = signature(r["set"], factors)
        i, j = links_between(rows, None, threshold, rows[0]["kind"])
        links, labels = _count_links(rows, rows, i, j), _Labels(r["rep"] for r in rows)
        for x, y in zip(i, j, strict=True):
            labels.tie(rows[x]["rep"], rows[y]["rep"])
        out = []
        for r in rows:
            kept = (r["sig"].tobytes(), r["set"].tobytes()) if r["blocks"] > 1 else (None, None)
            out.append((r["rep"], r["kind"], r["grp"], r["blocks"], r["mine"], r["copies"], links.get(r["rep"], 0), labels.find(r["rep"]), *kept))
        return out

    return unit


def _block_pair(threshold: float):
    """Two blocks of a group: (CROSS) rows, links of documents and of labels."""

    def unit(rows: list[dict]) -> list[tuple]:
        for r in rows:
            r["sig"], r["set"] = np.frombuffer(r["sig"], np.uint32), np.frombuffer(r["hashes"], np.uint64)
        left, right = [r for r in rows if r["mine"] == r["a"]], [r for r in rows if r["mine"] == r["b"]]
        if not left or not right:
            return []
        i, j = links_between(left, right, threshold, rows[0]["kind"])
        labels, ties = _Labels({r["label"] for r in rows}), []
        for x, y in zip(i, j, strict=True):
            u, v = left[x]["label"], right[y]["label"]
            if labels.tie(u, v):
                ties.append((None, None, u, v))
        return [(k, n, None, None) for k, n in _count_links(left, right, i, j).items()] + ties

    return unit


def _by_unit(key_columns: list[str], work, result: str):
    """Streams rows sorted by unit; one unit is held at a time."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in result.split(", ")])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )

    def run(batches):
        key, held, ready = None, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(c)[k].as_py() for c, n in enumerate(batch.schema.names)}
                at = tuple(row[c] for c in key_columns)
                if at != key:
                    if held:
                        ready += work(held)
                    key, held = at, []
                    if len(ready) > 1000:
                        yield batch_of(ready)
                        ready = []
                held.append(row)
        if held:
            ready += work(held)
        if ready:
            yield batch_of(ready)

    return run


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class (its smallest id); columns of ``docs``."""
    return join(docs, id_col, text_col, keep_rows=True).where("is_first").select("row.*")
