"""Nearest neighbours by largest inner product over balanced posting lists.

1. Equal vectors become one *group* with its smallest ids (no more than a
   result can show), so a vector that a third of all rows share is one row.
2. Norms fall into bands of a factor of two.  Inside a band every vector is
   divided by the band's largest norm and given one more component that makes
   it a unit vector; for a query (that component 0) the order of inner products
   is then the order of distances on the sphere.
3. Balanced lists are fitted on a bounded sample: the sample is halved at the
   median between two means until parts are small, and the parts' means are
   the centroids.  They lie in memory as a graph of neighbours.
4. Every group goes to its nearest list, a boundary vector to every list that
   is nearly as near (``BOUNDARY``).  Centroids are found by walking the graph.
5. A query selects every list whose centroid is at most ``ratio`` times as far
   as the nearest one (or as a nearest one usually is, if that is more), and
   then the next ones until they hold enough vectors.  The ratio is the one that
   the sample's own queries need to find ``TARGET`` of their neighbours.
6. Lists are dealt into units of about ``UNIT`` vectors; longer lists and more
   queries than ``UNIT`` are split over several.  A unit's best go to one
   top-k per query.  Nothing is capped: whatever a selected list holds is
   compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.plans.stage import materialize

K = 20
LIST = 64  # vectors of a list that the fit aims at
MAX_LISTS = 8192  # of all bands together; beyond LIST * MAX_LISTS vectors the lists grow
SAMPLE_ROWS = 65_536  # vectors that the lists are fitted on
SAMPLE_VALUES = 1 << 23  # components of those vectors (64 MiB)
BOUNDARY = 0.02
COPIES = 4  # lists that a boundary vector is put into, the nearest first
TARGET = 0.97
ASKED = 512  # sample vectors that ask for the ratio
UNIT = 4096
NEAR, BEAM = 12, 8  # graph: links of a centroid, nodes kept while walking
BATCH = 512


# --- fitting, on the driver, over the bounded sample -------------------------
def halve(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of balanced parts of at most ``size`` rows, neighbours in
    the tree next to each other."""
    rng = np.random.default_rng(7)

    def part(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= size:
            return [rows]
        p = x[rows]
        a, b = p[rng.choice(len(rows), 2, replace=False)]
        for _ in range(8):
            far = p @ (a - b)
            upper = far > np.median(far)
            if not upper.any() or upper.all():
                break
            a, b = p[upper].mean(axis=0), p[~upper].mean(axis=0)
        order = np.argsort(p @ (a - b), kind="stable")
        return part(rows[order[: len(rows) // 2]]) + part(rows[order[len(rows) // 2 :]])

    return part(np.arange(len(x)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Lists:
    """Centroids of one band, their graph, and the ratio that prunes lists."""

    def __init__(self, x: np.ndarray, lists: int):
        """``x``: lifted sample vectors of the band (may be none)."""
        if lists < 2 or len(x) < 2:
            self.centroids = unit_rows(x.mean(axis=0, keepdims=True)) if len(x) else np.zeros((1, x.shape[1]))
        else:
            parts = halve(x, max(1, -(-len(x) // lists)))
            c = unit_rows(np.stack([x[p].mean(axis=0) for p in parts]))
            for _ in range(3):  # a few rounds of means; parts were balanced, so lists stay about even
                own = np.concatenate([(x[i : i + BATCH] @ c.T).argmax(axis=1) for i in range(0, len(x), BATCH)])
                total = np.zeros_like(c)
                np.add.at(total, own, x)
                filled = np.bincount(own, minlength=len(c)) > 0
                c[filled] = unit_rows(total[filled])
            self.centroids = c
        n = len(self.centroids)
        near = min(NEAR, n - 1)
        self.entries = np.arange(0, n, max(1, int(np.sqrt(n))))
        links: list[set[int]] = [{(i + 1) % n, (i - 1) % n} - {i} for i in range(n)]
        for i in range(0, n if near else 0, BATCH):
            d = spread(self.centroids[i : i + BATCH], self.centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            for k, row in enumerate(np.argpartition(d, near - 1, axis=1)[:, :near]):
                links[i + k].update(row.tolist())
                for j in row[: near // 2].tolist():  # links both ways
                    links[j].add(i + k)
        self.starts = np.cumsum([0] + [len(s) for s in links])
        self.links = np.array([j for s in links for j in sorted(s)], dtype=np.int64)
        self.ratio, self.usual = 1.0, 0.0

    def reach(self, d: np.ndarray, ratio: float, usual: float = 0.0) -> np.ndarray:
        """How far from each query lists are selected."""
        return ratio * np.maximum(d.min(axis=1, keepdims=True), usual) + 1e-12

    def _expand(self, q: np.ndarray, d: np.ndarray, done: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Measures the neighbours of (row, node) pairs that are not known yet."""
        done[rows, nodes] = True
        many = self.starts[nodes + 1] - self.starts[nodes]
        at = np.repeat(self.starts[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs = np.unique(np.repeat(rows, many) * d.shape[1] + self.links[at])
        r, c = pairs // d.shape[1], pairs % d.shape[1]
        new = np.isinf(d[r, c])
        r, c = r[new], c[new]
        for i in range(0, len(r), 1 << 16):
            a, b = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
            d[a, b] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", q[a], self.centroids[b]), 0))

    def walk(self, q: np.ndarray, ratio: float, usual: float = 0.0) -> np.ndarray:
        """Distances from queries to the centroids met on the graph (others
        infinite): the nearest ones, and all within reach."""
        n = len(self.centroids)
        d, done = np.full((len(q), n), np.inf), np.zeros((len(q), n), dtype=bool)
        d[:, self.entries] = spread(q, self.centroids[self.entries])
        beam = min(BEAM, n)
        while True:  # towards the nearest: the best few that were not expanded
            top = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            rows = np.repeat(np.arange(len(q)), beam)
            nodes = top.ravel()
            fresh = ~done[rows, nodes] & np.isfinite(d[rows, nodes])
            if not fresh.any():
                break
            self._expand(q, d, done, rows[fresh], nodes[fresh])
        while True:  # all around it
            rows, nodes = np.nonzero((d <= self.reach(d, ratio, usual)) & ~done)
            if not len(rows):
                return d
            self._expand(q, d, done, rows, nodes)

    def homes(self, x: np.ndarray) -> list[list[int]]:
        """Lists of vectors: the nearest, and those nearly as near."""
        d = self.walk(x, 1 + BOUNDARY)
        order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
        dist = np.take_along_axis(d, order, axis=1)
        keep = dist <= (1 + BOUNDARY) * dist[:, :1] + 1e-12
        return [o[k].tolist() for o, k in zip(order, keep, strict=True)]

    def selected(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[list[int]]:
        """Lists that queries look into: those within reach, and the next ones
        until the ``sizes`` add up to ``least`` (or to all there is)."""
        d = self.walk(q, self.ratio, self.usual)
        near = d <= self.reach(d, self.ratio, self.usual)
        short = np.nonzero(near @ sizes < min(least, sizes.sum()))[0]
        if len(short):
            order = np.argsort(spread(q[short], self.centroids), axis=1, kind="stable")
            many = (np.cumsum(sizes[order], axis=1) < min(least, sizes.sum())).sum(axis=1) + 1
            for r, o, n in zip(short, order, many, strict=True):
                near[r, o[:n]] = True
        return [np.nonzero(row)[0].tolist() for row in near]

    def calibrate(self, q: np.ndarray, x: np.ndarray, k: int) -> None:
        """Sets the ratio that finds ``TARGET`` of the ``k`` nearest sample
        vectors ``x`` of the queries ``q``."""
        if len(self.centroids) < 2:
            return
        homes = [h for i in range(0, len(x), BATCH) for h in self.homes(x[i : i + BATCH])]
        needed = []
        self.usual = float(np.median([spread(q[i : i + 64], self.centroids).min(axis=1) for i in range(0, len(q) - 63, 64)] or [0.0]))
        for i in range(0, len(q), 64):
            part = q[i : i + 64]
            best = np.argpartition(-(part @ x.T), min(k, len(x) - 1), axis=1)[:, : min(k + 1, len(x))]
            d = spread(part, self.centroids)
            least = np.maximum(d.min(axis=1), max(self.usual, 1e-12))
            needed += [min(d[r, c] for c in homes[j]) / least[r] for r in range(len(part)) for j in best[r]]
        self.ratio = max(1.0, float(np.quantile(needed, TARGET)))


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Packed float64 vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Unit vectors of one more component, in the band of that largest norm."""
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(1 - (y * y).sum(axis=1, keepdims=True), 0))])


def directed(x: np.ndarray) -> np.ndarray:
    """Queries among lifted vectors."""
    return np.hstack([unit_rows(x / np.abs(x).max(axis=1, keepdims=True)), np.zeros((len(x), 1))])


def fit(sample: np.ndarray, sample_band: np.ndarray, bands: dict[int, tuple[int, float]], k: int) -> list[tuple[int, float, Lists, int]]:
    """(band, largest norm, lists, number of its first list) of every band;
    ``bands``: how many vectors it has, and their largest norm."""
    total = sum(n for n, _ in bands.values())
    room = min(MAX_LISTS, max(1, SAMPLE_VALUES // sample.shape[1]))
    model, first = [], 0
    for band, (n, largest) in sorted(bands.items()):
        x = lifted(sample[sample_band == band], largest)
        lists = Lists(x, min(-(-n // LIST), -(-room * n // total)))
        if len(x):
            step = max(1, len(sample) // ASKED)
            lists.calibrate(directed(sample[::step]), x, k)
        model.append((band, largest, lists, first))
        first += len(lists.centroids)
    return model


# --- the jobs ----------------------------------------------------------------
def _norm(v: Column) -> Column:
    """Euclidean norm, without overflow."""
    top = F.array_max(F.transform(v, F.abs))
    return top * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, as doubles."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    valid = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    known = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    return known.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & valid)


def _packed(groups: DataFrame) -> DataFrame:
    """(gid, band, least, vec): vectors as packed float64 values."""

    def run(batches):
        for b in batches:
            flat = b.column(3)
            values = np.asarray(flat.flatten(), dtype="<f8")
            starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(flat)))])
            blobs = [values[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(blobs, pa.binary())], names=["gid", "band", "least", "vec"])

    return groups.select("gid", "band", "least", "v").mapInArrow(run, "gid long, band int, least long, vec binary")


def search(
    rows: DataFrame,
    asks: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for
    which ``asks`` (over ``vec_id``) holds, among all rows but those of its own
    id, nearest first, ties to the smaller id; ``score`` is the inner product
    of the original vectors in double precision.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part; nor do vectors whose length is not the
    commonest one (ties: the shorter).  Equal rows count once; rows of one id
    with several vectors are several candidates, and its queries are answered
    for each vector.  Other columns are not looked at.  An empty table gives no
    rows.  Fitted on at most ``SAMPLE_ROWS`` different vectors (and
    ``SAMPLE_VALUES`` components); every vector is indexed.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = vectors(rows, id_col, vector_col)
    sizes = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim = sizes[0].dim
    every = every.where(F.size("v") == dim)
    smallest = Window.partitionBy("v").orderBy("vec_id")
    shown = every.withColumn("rn", F.dense_rank().over(smallest)).where(F.col("rn") <= k + 1)
    norm = _norm(F.col("v"))
    groups = materialize(
        shown.groupBy("v")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
        .select(
            F.monotonically_increasing_id().alias("gid"),
            "v",
            "ids",
            F.get("ids", F.lit(0)).alias("least"),
            norm.alias("norm"),
            F.floor(F.log2(norm) + 0.5).cast("int").alias("band"),
        ),
        "llm-vectors",
    )
    packed = materialize(_packed(groups), "llm-packed")
    bands = {r.band: (r.n, r.largest) for r in groups.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("largest")).collect()}
    total = sum(n for n, _ in bands.values())

    # a sample bounded in rows and in values, picked by a hash
    want = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))
    picked = packed if total <= want else packed.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * want / total)).limit(2 * want)
    sample = picked.select("band", "vec").toArrow()
    model = fit(matrix_of(sample.column("vec"), dim), np.asarray(sample.column("band")), bands, k)
    shared = spark.sparkContext.broadcast(model)

    def post(batches):
        for b in batches:
            x, band = matrix_of(b.column(3), dim), np.asarray(b.column(1))
            homes: list[list[int]] = [[] for _ in range(len(x))]
            for one, largest, lists, first in shared.value:
                at = np.nonzero(band == one)[0]
                for i in range(0, len(at), BATCH):
                    for r, h in zip(at[i : i + BATCH].tolist(), lists.homes(lifted(x[at[i : i + BATCH]], largest)), strict=True):
                        homes[r] = [first + c for c in h]
            many = [len(h) for h in homes]
            taken = pa.array(np.repeat(np.arange(len(x)), many))
            out = b.take(taken)
            placed = [(c, i == 0) for h in homes for i, c in enumerate(h)]
            added = [pa.array([c for c, _ in placed], pa.int32()), pa.array([nearest for _, nearest in placed], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*out.columns, *added], names=[*b.schema.names, "list", "home"])

    postings = materialize(packed.mapInArrow(post, "gid long, band int, least long, vec binary, list int, home boolean"), "llm-postings")

    # lists in tree order are dealt into units: one row per list comes back
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).orderBy("list").collect()
    at_home = np.zeros(sum(len(lists.centroids) for _, _, lists, _ in model), dtype=np.int64)
    unit_of, splits, filled, unit = {}, {}, 0, 0
    for r in counts:
        at_home[r.list] = r.homes
        if filled and filled + r.n > UNIT:
            unit, filled = unit + 1, 0
        filled += r.n
        unit_of[r.list] = unit
        splits[unit] = max(1, -(-filled // UNIT))
    dealt = spark.sparkContext.broadcast((unit_of, at_home))

    def select(batches):
        for b in batches:
            x = matrix_of(b.column(1), dim)
            gids, at, lists_of = [], [], []
            unit_of, at_home = dealt.value
            for _, _, lists, first in shared.value:
                sizes = at_home[first : first + len(lists.centroids)]
                for i in range(0, len(x), BATCH):
                    for r, chosen in enumerate(lists.selected(directed(x[i : i + BATCH]), sizes, k + 1), i):
                        by: dict[int, list[int]] = {}
                        for c in chosen:
                            c += first
                            u = unit_of.get(c)
                            if u is not None:  # a list that nothing came to
                                by.setdefault(u, []).append(c)
                        for u, cs in by.items():
                            gids.append(r)
                            at.append(u)
                            lists_of.append(cs)
            out = b.take(pa.array(gids, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at, pa.int32()), pa.array(lists_of, pa.list_(pa.int32()))], names=["gid", "vec", "unit", "lists"])

    queries = every.where(asks).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = materialize(queries.join(groups.select("gid", "v"), "v").select("query_id", "gid"), "llm-queries")
    probes = materialize(
        packed.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "vec").mapInArrow(select, "gid long, vec binary, unit int, lists array<int>"),
        "llm-probes",
    )
    askers = {r.unit: -(-r["count"] // UNIT) for r in probes.groupBy("unit").count().collect()}

    def numbers(of: dict[int, int]) -> Column:
        """How many parts a unit has: a map of one entry a unit, at most one a list."""
        return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in of.items() for v in p]), F.col("unit")), F.lit(1))

    more_splits, more_askers = {u: n for u, n in splits.items() if n > 1}, {u: n for u, n in askers.items() if n > 1}
    parts = numbers(more_splits) if more_splits else F.lit(1)
    turns = numbers(more_askers) if more_askers else F.lit(1)
    numbered = spark.createDataFrame(list(unit_of.items()), "list int, unit int")
    left = (
        probes.withColumn("turn", F.pmod(F.xxhash64("gid"), turns).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("unit", "part", "turn", "gid", "vec", "lists")
    )
    right = (
        postings.join(F.broadcast(numbered), "list")  # a row for each list: at most MAX_LISTS and the bands
        .withColumn("part", F.pmod(F.xxhash64("gid"), parts).cast("int"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
        .select("unit", "part", "turn", "gid", "least", "vec", "list")
    )
    keep = k + 1
    unit_key = ["unit", "part", "turn"]
    found = left.groupBy(*unit_key).cogroup(right.groupBy(*unit_key)).applyInArrow(
        lambda q, p: best_of_unit(q, p, dim, keep), "query long, gid long, least long, score double"
    )
    order = [F.desc("score"), F.asc("least")]
    per_query = Window.partitionBy("query")
    top = (
        found.groupBy("query", "gid")
        .agg(F.first("least").alias("least"), F.first("score").alias("score"))
        .withColumn("rn", F.row_number().over(per_query.orderBy(*order)))
        .where(F.col("rn") <= keep)
    )
    ids = top.join(groups.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = (
        ids.withColumn("rn", F.row_number().over(per_query.orderBy(F.desc("score"), F.asc("vec_id"))))
        .where(F.col("rn") <= keep)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("found"))
    )
    answers = asked.join(listed, F.col("gid") == F.col("query")).select(
        "query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found")
    )
    return answers.select("query_id", F.posexplode("found").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", "one.score"
    )


def best_of_unit(queries: pa.Table, postings: pa.Table, dim: int, keep: int) -> pa.Table:
    """The ``keep`` best groups of a unit's lists for each query: at most
    ``UNIT`` queries (expected) against at most that many vectors."""
    out: list[tuple] = []
    if queries.num_rows and postings.num_rows:
        gid, first, home = np.unique(np.asarray(postings.column("gid")), return_index=True, return_inverse=True)
        x, least = matrix_of(postings.column("vec"), dim)[first], np.asarray(postings.column("least"))[first]
        names, number = np.unique(np.asarray(postings.column("list")), return_inverse=True)
        held = np.zeros((len(names), len(gid)), dtype=np.float32)
        held[number, home] = 1
        place = {c: i for i, c in enumerate(names.tolist())}
        q, qid, chosen = matrix_of(queries.column("vec"), dim), np.asarray(queries.column("gid")), queries.column("lists").to_pylist()
        scale = np.linalg.norm(x, axis=1).max()
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            open_ = np.zeros((len(part), len(names)), dtype=np.float32)
            for r, lists in enumerate(chosen[i : i + 256]):
                open_[r, [place[c] for c in lists if c in place]] = 1
            scores = np.where(open_ @ held > 0, part @ x.T, -np.inf)
            n = min(keep, len(gid))
            last = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
            margin = 1e-9 * scale * np.linalg.norm(part, axis=1)
            for r in range(len(part)):
                at = np.nonzero(np.isfinite(scores[r]) & (scores[r] >= last[r] - margin[r]))[0]
                exact = (x[at] * part[r]).sum(axis=1)  # one order of addition for each pair, wherever it is met
                best = np.lexsort((least[at], -exact))[:keep]
                out.append((np.full(len(best), qid[i + r]), gid[at[best]], least[at[best]], exact[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table([pa.array(c.astype("f8" if t == pa.float64() else "i8"), t) for c, t in zip(columns, kinds, strict=True)], names=["query", "gid", "least", "score"])
