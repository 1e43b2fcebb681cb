"""Near-duplicate documents by a Chosen Path set similarity join.

A document's set is its distinct five-word shingles; equal sets share one representative. Every representative
enters the root of each tree and follows, at each node, the branches of two selected minwise tokens. Two sets of
similarity J select the same token with probability J, so they stay together along some path of a tree with a
probability of about 0.89 at J = 0.75 whatever the depth. Five trees would keep all but one in 10,000 such pairs if they were
independent; deep levels share their hashes, so the recall is measured in the tests.

Nodes of at most `leaf` members are compared exhaustively, on the full sets. The first tree's links are joined
into components before the other trees grow: links within a component add nothing, so a node with one component is
dropped, and a large node that one component holds most of is compared exactly there and then, its other members
against blocks of all of it. So is, in the end, every node that the last level leaves too large; nothing is capped.
Components come from alternating large and small stars.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbasis.llm.common import Words, _splitmix, attach, chunks, hash_whole, keep_ids, ready, release, windows, written

SHINGLE = 5
PERCENT = 75
TREES = 5
BRANCHES = 2
ROOTS = TREES * BRANCHES
LEVELS = 4  # of a tree at least; large inputs have more
LEAF = 1024
FEW_BLOCKS = 4  # blocks of members outside a node's largest component that may meet all its blocks before it is branched
SIGNATURE = 48  # minwise tokens of a set: one for each branch of the roots, the others shared by all deeper nodes
NULL_ID = (1 << 63) - 1

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"
_FEATURES = "id long, n_shingles long, set_key string, signature array<int>"
_SEEDS = _splitmix(SIGNATURE, 4242)


def shingle_sets(texts: list, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: runs of k words with A-Z lower-cased, or the whole
    sequence if there are fewer; empty without words."""
    for a, b in chunks(texts, 1 << 20):
        words = Words(texts[a:b], lower=True)
        hashes = words.hashes()
        all_windows = windows(hashes, k)
        for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if end - first >= k:
                yield np.unique(all_windows[first : end - k + 1])
            elif end > first:
                yield np.array([hash_whole(hashes[first:end], 1 + end - first)], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The minwise token of a set under each of SIGNATURE hashes, by 32 bits."""
    out = np.empty(SIGNATURE, dtype=np.uint64)
    for i, seed in enumerate(_SEEDS):
        out[i] = (tokens * seed).min()
    return (out >> np.uint64(13)).astype(np.uint32).view(np.int32)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sizes, keys, signatures = [], [], []
            for tokens in shingle_sets(texts, k):
                sizes.append(len(tokens))
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest() if len(tokens) else None)
                signatures.append(signature(tokens) if len(tokens) else np.zeros(SIGNATURE, dtype=np.int32))
            flat = pa.array(np.concatenate(signatures) if signatures else np.zeros(0, dtype=np.int32), type=pa.int32())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SIGNATURE), flat)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, type=pa.int64()), pa.array(keys, type=pa.string()), listed], names=["id", "n_shingles", "set_key", "signature"])

    return run


def _common(number: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of n sets share, from (token number, owner) sorted by token: by a matrix product where many
    sets share each token, else by counting pairs token by token; in slices of bounded size either way."""
    out = np.zeros((n, n))
    if not len(number):
        return out
    held = np.bincount(number)
    pairs = held.astype(np.int64) ** 2
    if n * n * len(held) < 40 * int(pairs.sum()):
        wide = max(256, (4 << 20) // n)
        for first in range(0, len(held), wide):
            a, b = np.searchsorted(number, [first, first + wide])
            part = np.zeros((n, min(wide, len(held) - first)), dtype=np.float32)
            part[owner[a:b], number[a:b] - first] = 1
            out += part @ part.T
        return out
    ends = np.cumsum(held)
    done = np.cumsum(pairs)
    first = 0
    while first < len(held):
        last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + (4 << 20), side="right")))
        a, b = int(ends[first] - held[first]), int(ends[last - 1])
        times = held[number[a:b]]  # each member of a token meets all its members
        left = np.repeat(owner[a:b], times)
        begin = np.repeat(ends[number[a:b]] - times, times)
        right = owner[begin + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)]
        out += np.bincount(left * n + right, minlength=n * n).reshape(n, n)
        first = last
    return out


def linked(sets: list[np.ndarray], percent: int, query: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of `sets` have 100 * intersection >= percent * union, from full sets; with `query`, only pairs with one."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, dtype=bool)
    number, owner = np.cumsum(new[shared]) - 1, owner[shared]
    common = _common(number, owner, n)
    out = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    if query is not None:
        out &= query[:, None] | query[None, :]
    np.fill_diagonal(out, False)
    return out


def stars(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """For each connected part of a leaf, its members linked to its smallest id."""
    out, left = [], pairs.any(axis=1)
    while left.any():
        front = np.zeros(len(ids), dtype=bool)
        front[int(np.flatnonzero(left)[0])] = True
        part = front.copy()
        while front.any():
            front = pairs[front].any(axis=0) & ~part
            part |= front
        left &= ~part
        mine = ids[part]
        least = int(mine.min())
        out += [(int(i), least) for i in np.unique(mine) if i != least]
    return out


def _leaf(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
        query = table.column("query").to_numpy()
        found = stars(ids, linked(sets, percent, query if query.any() else None)) if len(ids) > 1 else []
        return pa.table({"a": pa.array([x[0] for x in found], type=pa.int64()), "b": pa.array([x[1] for x in found], type=pa.int64())})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


def _compare(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The links found in groups `node` of `rows` (node, id, query), whose sets are made anew from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            size = 0
            for i, tokens, mine in zip(ids, shingle_sets(texts, k), nodes, strict=True):
                data = tokens.tobytes()
                for node in mine:
                    out.append((node["node"], i, node["query"], data))
                    size += len(data)
                if size > 8 << 20:
                    yield _set_batch(out)
                    out, size = [], 0
            yield _set_batch(out)

    by_id = rows.groupBy("id").agg(F.collect_list(F.struct("node", "query")).alias("nodes"))
    # merged at every size: how many documents are in some node is not known beforehand, and may be most
    texts = docs.join(by_id.hint("merge"), "id").select("id", "text", "nodes")
    shipped = texts.mapInArrow(sets, "node long, id long, query boolean, tokens binary")
    return written(shipped.groupBy("node").applyInArrow(_leaf(percent), "a long, b long").distinct(), "links")


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["node", "id", "query", "tokens"])


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (node, id, component) of nodes with members of more than one component, with the node's number of rows as n."""
    total = rows.count()
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("__a"), F.max("component").alias("__b"))
    sizes = written(sizes.where("__a != __b").select("node", "n"), f"{name}-sizes")
    return written(attach(rows, sizes, "node", "n", total, F.col("id")).where("n is not null"), name)


def _grow(reps: DataFrame, roots: range, levels: int, leaf: int, joined: bool) -> tuple[DataFrame, DataFrame]:
    """Follow the branches of some roots of `reps` (id, signature, component): the rows (node, id, n, component) of leaves, and
    those of larger nodes to be compared in blocks.

    Nodes whose members are of one component are dropped where they appear. Where components have been `joined` before, a
    node goes to the blocks as soon as few enough members are outside its largest component for that to cost no
    more than a few copies of the node; all that are still too large after the last level go there.
    """
    chosen = [F.struct(F.xxhash64(F.lit(i), F.element_at("signature", i + 1)).alias("node")) for i in roots]
    rows = reps.select("id", "component", F.explode(F.array(*chosen)).alias("c")).select(F.col("c.node").alias("node"), "id", "component")
    columns = ["node", "id", "n", "component"]
    leaves, dense, current = [], [], _sized(rows, "nodes")
    for level in range(2, levels + 2):
        leaves.append(current.where(F.col("n") <= leaf).select(*columns))
        current = current.where(F.col("n") > leaf)
        if level > levels or current.isEmpty():
            dense.append(current.select(*columns))
            break
        if joined:
            marked = _with_shares(current, max(1, leaf // 2))
            few = F.col("outside") <= FEW_BLOCKS * (leaf // 2)
            dense.append(marked.where(few).select(*columns))
            current = marked.where(~few).select(*columns)
        place = lambda j: (F.lit(ROOTS + 1) + F.pmod(F.xxhash64("node", F.lit(j)), F.lit(SIGNATURE - ROOTS))).cast("int")
        steps = [F.xxhash64("node", F.lit(j), F.element_at("signature", place(j))) for j in range(BRANCHES)]
        branched = current.join(reps.select("id", "signature"), "id").select("id", "component", F.explode(F.array(*steps)).alias("node"))
        current = _sized(written(branched, f"level-{level}"), f"level-{level}")
    return _all(leaves), _all(dense)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b): alternating large and small stars until nothing changes."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # large star: each larger neighbour moves to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each smaller neighbour and the node itself do
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _with_shares(rows: DataFrame, half: int) -> DataFrame:
    """`rows` (node, component, ...) with the component that holds most of each node (the smallest of equals), the number of
    members outside it, and the blocks that these make."""
    shares = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("size"))
    nodes = shares.groupBy("node").agg(F.max_by("component", F.struct(F.col("size"), -F.col("component"))).alias("most"), F.sum("size").alias("m"), F.max("size").alias("top"))
    nodes = nodes.select("node", "most", "m", (F.col("m") - F.col("top")).alias("outside"), F.ceil((F.col("m") - F.col("top")) / half).cast("int").alias("parts"))
    return attach(rows, written(nodes, "shares"), "node", "m", rows.count(), F.col("id")).drop("m")


def _in_blocks(rows: DataFrame, half: int) -> DataFrame:
    """`rows` (node, id, n) dealt into blocks of about `half` members."""
    blocks = F.ceil(F.col("n") / half).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), blocks).cast("int"))


def _block_groups(rows: DataFrame, half: int) -> DataFrame:
    """Groups (node, id, query) that compare within blocks of large nodes, each block with the node's pivots: most of a dense
    node is joined by these."""
    picks = F.array_distinct(F.array(F.min("id"), F.max("id"), F.min_by("id", F.xxhash64("id")), F.max_by("id", F.xxhash64("id"))))
    pivots = rows.groupBy("node").agg(F.max("n").alias("n"), picks.alias("ids")).withColumn("blocks", F.ceil(F.col("n") / half).cast("int"))
    pivots = pivots.select("node", "blocks", F.explode("ids").alias("id")).select("node", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    here = _in_blocks(rows, half).select("node", "id", "block").unionByName(pivots).distinct()
    return here.select(F.xxhash64("node", "block").alias("node"), "id", F.lit(False).alias("query"))


def _outside_groups(rows: DataFrame, half: int) -> DataFrame:
    """Groups (node, id, query) that find all links of large nodes (node, id, n, component) between members of different
    components, exactly: the members outside the component that holds most of a node are compared with every block of it."""
    placed = _in_blocks(_with_shares(rows, half), half)
    outside = written(placed.where("component != most").select("node", "id", "blocks", "parts"), "outside")
    asked = outside.withColumn("part", F.pmod(F.xxhash64("node", "id", F.lit(1)), F.col("parts")).cast("int"))
    asked = asked.select("node", "id", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = placed.where("parts > 0").select("node", "id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    cell = F.xxhash64("node", "block", "part", F.lit(2)).alias("node")
    cells = asked.select(cell, "id", F.lit(True).alias("query")).unionByName(others.select(cell, "id", F.lit(False).alias("query")))
    return cells.groupBy("node", "id").agg(F.max("query").alias("query"))


def _once(rows: DataFrame) -> DataFrame:
    """`rows` (node, id, ...) as (node, id, query) without nodes that have the same members as another."""
    prints = rows.groupBy("node").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print"), F.count(F.lit(1)).alias("n"))
    once = prints.groupBy("print", "n").agg(F.min("node").alias("node")).select("node")
    return rows.join(once, "node", "left_semi").select("node", "id", F.lit(False).alias("query"))


def depth(sets: int, leaf: int) -> int:
    """Levels of a tree over so many sets: half as many as halvings bring them to a leaf. A level splits a node far more than in
    two, but for texts that share most of their shingles."""
    return max(LEVELS, math.ceil(math.log2(max(1, sets / leaf)) / 2))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, trees: int = TREES, levels: int | None = None, leaf: int = LEAF) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (the smallest id reachable by links), kept.

    `trees` is from 2 to TREES, for which the signatures have room. `levels` follows the number of rows where it is not given.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Null texts and texts without words
    have empty sets and no links. A null id ranks behind every id (rows with null ids count as one document, whose
    component is null unless it has a smaller id). Rows that share an id count as one document with the links of all its
    texts; repeated rows give repeated rows. An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    ready(spark)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = written(plain.mapInArrow(_features(shingle), _FEATURES), "features")
    # equal sets: one representative, the smallest id
    same = made.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = made.count()
    levels = depth(total, leaf) if levels is None else levels
    members = attach(made, written(same, "equal-sets"), "set_key", "n", total, F.col("id"))
    members = members.withColumn("rep", F.coalesce("rep", "id"))
    members = written(members.select("id", "n_shingles", "rep", F.when(F.col("id") == F.col("rep"), F.col("signature")).alias("signature")), "members")
    reps = members.where("signature is not null and n_shingles > 0").select("id", "signature")

    # the first tree alone, then the others over what it has joined: texts are read and dealt out once for each
    half = max(1, leaf // 2)
    leaves, crowded = _grow(reps.withColumn("component", F.col("id")), range(BRANCHES), levels, leaf, False)
    release(spark)
    found = components(_compare(plain, _once(leaves).unionByName(_block_groups(crowded, half)), shingle, percent))
    label = lambda rows: rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    release(spark)
    leaves, dense = _grow(written(label(reps), "labelled"), range(BRANCHES, trees * BRANCHES), levels, leaf, True)
    release(spark)
    dense = dense.unionByName(label(crowded.drop("component")).select(*dense.columns))
    links = _compare(plain, _once(leaves).unionByName(_outside_groups(dense, half)), shingle, percent)
    release(spark)
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    groups = written(found.join(sizes, found["id"] == sizes["rep"]).select("rep", "component", "size"), "components")
    out = attach(members.select("id", "n_shingles", "rep"), groups, "rep", "size", members.count(), F.col("id"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = out.withColumn("component", F.coalesce("component", "rep"))
    return out.select(null("id").alias("doc_id"), "n_shingles", null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def representatives_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns."""
    return keep_ids(docs, id_col, near_dedup(docs, id_col, text_col).where("kept").select("doc_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.common >= 75 * (x.n + y.n - i.common)),
r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(c.least, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
