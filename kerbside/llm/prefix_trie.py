"""The trie of conversation prefixes, from sorted neighbours.

1. A turn becomes a digest and a number of words where it is read; a
   conversation is the row of its turns' digests.  Equal conversations are one
   *sequence* with its count and smallest id.
2. Sequences are range-partitioned and sorted; a partition is cut into chunks
   of ``CHUNK`` neighbours, and every chunk knows the last sequence before it
   and the first one after it.
3. In a chunk, neighbours are edges as deep as their common prefix.  They are
   taken in descending depth by union-find: every merge of two components makes
   (or joins) a branching node, and the nodes between it and the component
   below form a chain.  All of a node's numbers are sums over its sequences.
4. Nodes that a boundary cuts (prefixes that the chunk shares with the sequence
   before or after it) are *open*: the chunk's forest contracted to its two
   spines.  Their sums are added up across chunks by the prefix's digest; all
   other nodes are final.
5. The ids of the conversations that end at a node are joined to blocks of text
   by sorted partitions; one pass over a node's blocks hashes them, in constant
   memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.plans.ordering import tag_sorted
from kerbside.plans.stage import materialize

CHUNK = 8192  # sequences of a chunk
SHARED, HEAD_OF = 4, 20  # fixed values of the rebuilding rule
DIGEST = 16  # bytes of a turn
TEXT_BLOCK = 1 << 16  # ids are joined to texts of about this many characters
NOBODY = hashlib.sha256(b"").hexdigest()
NODES = (
    "part int, chunk long, depth long, node binary, open boolean, n_convs long, first long, n_children long,"
    " n_leaves long, saved long, ends string, parent_first long, parent_node binary"
)


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, own): every conversation's turns, as structs (digest, words) in
    the order of the turn numbers.

    A null turn comes first; equal turn numbers are taken in the order of their
    digests; null role and text are empty.  Rows with a null id take no part.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").isNotNull().alias("numbered"),
            F.col(f"`{turn_col}`").alias("turn"),
            F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
            F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long").alias("words"),
        ).alias("one"),
    )
    return (
        turns.where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("own"))
        .select("conv_id", F.transform("own", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("own"))
    )


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, key, words): conversation c begins with the first h turns of
    conversation c - c % 20 (h: crc32 of the id, modulo 4) in place of its own
    first h.  ``key``: the turns' digests joined; ``words``: their words."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    heads = convs.where(F.col("conv_id") % HEAD_OF == 0).select(F.col("conv_id").alias("head_id"), F.slice("own", 1, SHARED - 1).alias("head"))
    none = F.slice("own", 1, 0)
    joined = convs.join(heads, F.col("conv_id") - F.col("conv_id") % HEAD_OF == F.col("head_id"), "left")
    h = shared.cast("int")
    turns = joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own") + 1)).alias("s"))
    return turns.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["digest"])), "")).alias("key"),
        F.transform("s", lambda x: x["words"]).alias("words"),
    )


def _id_blocks(batches):
    """Runs of one ``node`` among sorted (node, conv_id) rows, as joined texts."""
    for b in batches:
        if not b.num_rows:
            continue
        nodes, ids = b.column(0).to_pylist(), np.asarray(b.column(1))
        change = [0] + [i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]] + [len(nodes)]
        out = []
        step = TEXT_BLOCK // 20
        for s, e in zip(change[:-1], change[1:], strict=True):
            out += [(nodes[s], int(ids[i]), ",".join(map(str, ids[i : min(i + step, e)].tolist()))) for i in range(s, e, step)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])


def _hashes(batches):
    """SHA-256 of each node's sorted blocks, joined by commas."""
    node, state = None, None
    for b in batches:
        out = []
        for n, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if n != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(t.encode())
            else:
                state.update(b"," + t.encode())
        if out:
            yield _ended(out)
    if state is not None:
        yield _ended([(node, state.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    nodes, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(ends, pa.string())], names=["node", "ends"])


def ends_of(convs: DataFrame) -> DataFrame:
    """(node, ends): for each sequence's digest, the SHA-256 of its
    conversations' ids, ascending and joined by commas."""
    rows = convs.select(F.unhex(F.md5("key")).alias("node"), "conv_id")
    blocks = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_id_blocks, "node binary, first long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


def merge(lcp: np.ndarray, length: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The compact trie of sorted, different sequences: ``lcp[i]`` is the
    common prefix of sequences i - 1 and i (``lcp[0]`` is not used).

    Nodes 0..m-1 are the sequences, later ones the branching nodes; for each:
    the sequences ``low`` to ``high`` below it, its ``depth``, its ``parent``
    node (-1: none), how many ``merges`` made it, and the smallest id below.
    """
    m = len(length)
    low, high, depth = list(range(m)), list(range(m)), length.tolist()
    parent, merges, least = [-1] * m, [0] * m, first.tolist()
    root = list(range(m))  # union-find over sequences
    top = list(range(m))  # the topmost node of a component, at its root

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # descending depth; of equal ones the left first, so a right component is never yet as shallow
    for e in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
        d = int(lcp[e])
        a, b = find(e - 1), find(e)
        x, y = top[a], top[b]
        if depth[x] > d:
            node = len(low)
            low.append(low[x])
            high.append(high[x])
            depth.append(d)
            parent.append(-1)
            merges.append(0)
            least.append(least[x])
            parent[x] = node
        else:
            node = x
        parent[y] = node
        high[node] = high[y]
        merges[node] += 1
        least[node] = min(least[node], least[y])
        root[b] = a
        top[a] = node
    names = ("low", "high", "depth", "parent", "merges", "least")
    return {n: np.array(v, dtype=np.int64) for n, v in zip(names, (low, high, depth, parent, merges, least), strict=True)}


def _prefix_digests(key: bytes, depth: int) -> list[bytes]:
    """Digests of a sequence's first 0..depth turns."""
    import xxhash

    state = xxhash.xxh3_128()
    out = [state.digest()]
    for d in range(depth):
        state.update(key[d * DIGEST : (d + 1) * DIGEST])
        out.append(state.digest())
    return out


def forest(group: tuple, rows: pa.Table) -> pa.Table:
    """All nodes of a chunk: sorted sequences and, at positions before and after
    them, the neighbours across its boundaries (``n`` null)."""
    rows = rows.sort_by("pos")
    keys, counted = rows.column("key").to_pylist(), np.asarray(rows.column("n").is_valid())
    inner = np.nonzero(counted)[0]
    s, m = int(inner[0]), len(inner)
    own = keys[s : s + m]
    lcp = np.array([common_turns(a, b) for a, b in zip([b"", *own[:-1]], own, strict=True)], dtype=np.int64)
    before = common_turns(keys[s - 1], own[0]) if s else -1
    after = common_turns(own[-1], keys[s + m]) if s + m < len(keys) else -1
    lcp[0] = before
    length = np.array([len(k) // DIGEST for k in own], dtype=np.int64)
    inside = rows.slice(s, m)
    n, first = np.asarray(inside.column("n")), np.asarray(inside.column("first"))
    ends = inside.column("ends").to_pylist()
    words = np.concatenate([[0], *(np.asarray(w, dtype=np.int64) for w in inside.column("words").to_pylist())]).cumsum()
    start = np.concatenate([[0], np.cumsum(length)])

    def up_to(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Words of the first d turns of sequences i."""
        return words[start[i] + np.maximum(d, 0)] - words[start[i]]

    every = np.arange(m)
    whole = up_to(every, length)
    sums = {
        "n": n,
        "spoken": n * whole,
        "new": whole - up_to(every, lcp),  # words of the nodes that a sequence is the first to reach
        "leaf": (np.append(lcp[1:], after) < length).astype(np.int64),
    }
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in sums.items()}
    tree = merge(lcp, length, first)

    # chains: from every node up to just below its parent
    bottom = np.where(tree["parent"] >= 0, tree["depth"][tree["parent"]] + 1, 0)
    many = tree["depth"] - bottom + 1
    at = np.repeat(np.arange(len(many)), many)
    depth = np.repeat(bottom, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    low, high, top = tree["low"][at], tree["high"][at], depth == tree["depth"][at]

    def over(what: str) -> np.ndarray:
        return sums[what][high + 1] - sums[what][low]

    above = up_to(low, depth - 1)
    new = over("new") - (sums["new"][low + 1] - sums["new"][low]) + whole[low] - up_to(low, np.maximum(lcp[low], depth - 1))
    children = (lcp[low] <= depth) & (depth < length[low])
    # which boundary cuts a node: how far its first sequence goes with the chunk's first and last, and those beyond
    with_first = np.minimum(np.minimum.accumulate(np.append(length[0], lcp[1:])), before)
    with_last = np.minimum(np.minimum.accumulate(np.append(lcp[1:], length[-1])[::-1])[::-1], after)
    left, right = _prefix_digests(own[0], max(before, 0)), _prefix_digests(own[-1], max(after, 0))
    wl, wr = with_first[low], with_last[low]

    def digest(d: np.ndarray) -> list[bytes | None]:
        return [left[k] if 0 <= k <= a else right[k] if 0 <= k <= b else None for k, a, b in zip(d.tolist(), wl.tolist(), wr.tolist(), strict=True)]

    node, parent_node = digest(depth), digest(depth - 1)
    parent = np.where(depth > bottom[at], tree["least"][at], tree["least"][tree["parent"][at]])
    columns = [
        np.full(len(at), group[0].as_py()),
        np.full(len(at), group[1].as_py()),
        depth,
        node,
        [x is not None for x in node],
        over("n"),
        tree["least"][at],
        children + np.where(top, tree["merges"][at], 0),
        over("leaf"),
        over("spoken") - over("n") * above - new,
        [ends[i] if t and length[i] == d else None for i, t, d in zip(low.tolist(), top.tolist(), depth.tolist(), strict=True)],
        pa.array(parent, pa.int64(), mask=depth == 0),
        parent_node,
    ]
    names = [c.split()[0] for c in NODES.split(",")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.binary()]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def trie(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (the
    smallest that starts with it), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    See ``conversations`` for nulls, ties and repeated rows.  A conversation
    without turns counts at the root.  An empty table has no root.  A
    conversation's digests (16 bytes and a number a turn) are one row.
    """
    convs = materialize(rebuilt(conversations(rows, id_col, turn_col, role_col, text_col)), "llm-conversations")
    distinct = convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("words").alias("words"))
    ends = ends_of(convs)
    sequences = distinct.join(ends, F.unhex(F.md5("key")) == F.col("node")).drop("node")
    tagged, _ = tag_sorted(sequences, [F.col("key").asc()])
    placed = tagged.select(
        F.col("_kb_part").alias("part"),
        F.floor(F.col("_kb_pos") / CHUNK).alias("chunk"),
        F.col("_kb_pos").alias("pos"),
        "key", "n", "first", "words", "ends",
    )
    # a row per chunk: its first and last sequence, for its neighbours
    in_order = Window.orderBy("part", "chunk")
    borders = placed.groupBy("part", "chunk").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    beside = borders.select(
        "part", "chunk", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after")
    )
    ends_at = [F.struct(F.lit(p).cast("long").alias("pos"), F.col(c).alias("key")) for p, c in ((-1, "before"), (1 << 62, "after"))]
    around = beside.select("part", "chunk", F.inline(F.array(*ends_at))).where("key is not null")
    chunks = placed.unionByName(around, allowMissingColumns=True)
    nodes = materialize(chunks.groupBy("part", "chunk").applyInArrow(forest, NODES), "llm-forest")

    # open nodes: sums over the chunks that a prefix reaches into
    cut = nodes.where("open")
    whole = materialize(
        cut.groupBy("node").agg(
            F.min("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.min("first").alias("first"),
            F.max("ends").alias("ends"),
            F.min("parent_node").alias("parent_node"),
        ),
        "llm-spines",
    )
    named = whole.select(F.col("node").alias("parent_node"), F.col("first").alias("above"))
    shown = ["first", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    joined = whole.join(named, "parent_node", "left").withColumn("parent", F.col("above")).select(*shown)
    # a closed node's open parent is on its own chunk's spine: joined by chunk, so a common turn is no hot key
    spine = cut.select("part", "chunk", "node").join(whole.select("node", F.col("first").alias("above")), "node")
    spine = spine.withColumnRenamed("node", "parent_node")
    closed = nodes.where("not open")
    inner = closed.where("parent_node is null").withColumn("parent", F.col("parent_first")).select(*shown)
    hung = closed.where("parent_node is not null").join(spine, ["part", "chunk", "parent_node"]).withColumn("parent", F.col("above")).select(*shown)
    return joined.unionByName(inner).unionByName(hung).select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )


ORACLE = """
WITH t AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
    SELECT conv_id, own, xor(list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
            lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END
    ), 4294967295) % 4 AS h
    FROM t
), r AS (
    SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS s
    FROM c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20
), m AS (
    SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r
), n AS (
    SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CASE WHEN len(s) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM m GROUP BY s[1:d], d
), k AS (
    SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY p[1:d - 1], d - 1
), w AS (
    SELECT n.p, n.d, n_convs, coalesce(n_children, 0) AS n_children,
           CASE WHEN n.d = 0 THEN 0
                ELSE len(list_filter(regexp_split_to_array(n.p[n.d].text, '[ \t-\r]+'), lambda x: x <> '')) END AS words
    FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d
), a AS (
    SELECT p[1:x] AS p, x AS d, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM w) GROUP BY p[1:x], x
)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, w.n_children::BIGINT AS n_children,
       a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN w ON w.p = n.p AND w.d = n.d JOIN a ON a.p = n.p AND a.d = n.d
LEFT JOIN n o ON n.d > 0 AND o.p = n.p[1:n.d - 1] AND o.d = n.d - 1
"""
