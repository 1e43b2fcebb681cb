"""Substring dedup by relative Lempel-Ziv parsing against an indexed reference of all documents.

The reference is cut into blocks by a hash of the parse's unit, the seed of `window` words; each block indexes, for every seed
that falls to it, where the seed starts first: in the document of smallest id. Documents travel in batches. A batch asks every
block once for all its distinct seeds, and a block answers with the earlier places. Then each document is factored greedily,
left to right: a factor starts at a seed that an earlier document has and grows word by word as long as the next seed
stands next in that document. As every seed at a factor's boundary has been asked for too, the words that factors cover are
exactly those covered by any window that occurs in an earlier document, also where it straddles two factors of different
references.

Batches and blocks have a fixed size, whatever the input's; only their number grows. Up to BLOCKS_A_ROUND blocks batches ask
them directly. Beyond it they ask in two rounds: slices of the batches first settle among themselves which is the
earliest place of a seed, in super-blocks, and only that one is asked of the block. So a seed that a third of all documents
share is asked for once a batch, and reaches its block once a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import Words, chunks, ready, windows, written

WINDOW = 13
BLOCK_BYTES = 4 << 20  # text for one block of the reference
BATCH_BYTES = 4 << 20  # text in one batch
BLOCKS_A_ROUND = 1 << 14
MOST_PARTITIONS = 1 << 16  # of a shuffle: beyond it a task has several groups, one after the other
NULL_ID = (1 << 63) - 1  # a null id ranks behind every id

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string"
#: Seeds on their way to a block or super-block (`key`): by each its block, its hash, the document, its place in its batch, its batch.
_ASKED = "key long, blocks binary, seeds binary, docs binary, places binary, batches binary"
#: What a batch is told: by its own place of a seed the earlier document and the seed's place in that one's batch. `key` -1.
_SETTLED = _ASKED + ", batch long, own binary"


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers of 64 bits that mostly ascend, as differences, all their lowest bytes first: most of the others are zeros."""
    planes = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64)[:, 0], dtype=np.int64)


class Batch:
    """Seeds of a batch of documents, in an order that depends on its rows alone: for each distinct one its block, the first
    document of the batch with it and its place, counted over all windows of the batch."""

    def __init__(self, ids: list, texts: list, window: int, blocks: int):
        rank = [NULL_ID if i is None else i for i in ids]
        order = sorted(range(len(ids)), key=lambda k: (rank[k], texts[k] is not None, texts[k] or ""))
        self.given = [ids[k] for k in order]
        self.texts = texts = [texts[k] for k in order]
        self.ids = np.array([rank[k] for k in order], dtype=np.int64)
        seeds, owner, self.n_words = [np.zeros((2, 0), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], np.zeros(len(ids), dtype=np.int64)
        for a, b in chunks(texts, 1 << 20):
            words = Words(texts[a:b], lower=False)
            h, g = windows(words.hashes(0), window), windows(words.hashes(1), window, 1)
            self.n_words[a:b] = np.diff(words.first)
            # windows that lie in one document
            doc = np.repeat(np.arange(b - a), np.diff(words.first))
            at = np.flatnonzero(doc[: len(h)] == doc[window - 1 :]) if len(h) else np.zeros(0, dtype=np.int64)
            seeds.append(np.stack([h[at], g[at] % np.uint64(blocks)]))
            owner.append(doc[at] + a)
        h, g = np.concatenate(seeds, axis=1)
        self.owner = np.concatenate(owner)
        self.edge = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        order = np.lexsort((h, g))  # of equal seeds the first in the batch comes first, which has the smallest id
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        first = order[new]
        again = np.lexsort((first, g[first]))
        self.seed, self.block, self.place = h[first][again], g[first][again].astype(np.int64), first[again]
        self.doc = self.ids[self.owner[self.place]]
        #: the batch's first place of each window's seed
        self.same = np.empty(len(order), dtype=np.int64)
        self.same[order] = first[np.cumsum(new) - 1]


def _cuts(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal `keys`."""
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(keys)][: len(edges)], strict=True):
        yield int(keys[a]), slice(a, b)


def settle(blocks: np.ndarray, seeds: np.ndarray, docs: np.ndarray, batches: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the first one with the same seed, by document, and whether that is of a smaller document."""
    order = np.lexsort((places, batches, docs, seeds, blocks))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (seeds[order[1:]] != seeds[order[:-1]]) | (blocks[order[1:]] != blocks[order[:-1]])
    first = np.empty(len(order), dtype=np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return first, docs[first] < docs


def factors(docs: np.ndarray, places: np.ndarray, own: int, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, end, earlier document) of one document from the first document and place of each of its seeds."""
    at = np.flatnonzero(docs < own)
    if not len(at):
        return []
    d, p = docs[at], places[at]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (d[1:] != d[:-1]) | (np.diff(p) != 1)]))
    ends = np.concatenate([starts[1:], [len(at)]]) - 1
    return [(int(at[a]), int(at[b]) + window, int(d[a])) for a, b in zip(starts, ends, strict=True)]


def _asked_rows(keys: np.ndarray, blocks, seeds, docs, places, batches) -> dict[str, list]:
    """Entries in order of `keys` as one row a key."""
    parts = list(_cuts(keys))
    return {
        "key": [k for k, _ in parts], "blocks": [_pack(blocks[s]) for _, s in parts], "seeds": [seeds[s].tobytes() for _, s in parts], "docs": [_pack(docs[s]) for _, s in parts],
        "places": [_pack(places[s]) for _, s in parts], "batches": [_pack(batches[s]) for _, s in parts],
    }


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    n = len(next(iter(columns.values())))
    return pa.table({c: pa.array(columns.get(c, [None] * n), type=kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def plan(total: int, block_bytes: int, batch_bytes: int, blocks_a_round: int) -> tuple[int, int, int, int]:
    """For so many bytes of text: blocks, batches, blocks in a super-block (1: one round), and slices of the batches. A group of any
    stage holds the seeds of about one block's or one batch's text, whatever the total."""
    blocks, batches = max(1, -(-total // block_bytes)), max(1, -(-total // batch_bytes))
    if blocks <= blocks_a_round:
        return blocks, batches, 1, 1
    supers = min(blocks, blocks_a_round)
    wide = -(-blocks // supers)
    return blocks, batches, wide, wide


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES, blocks_a_round: int = BLOCKS_A_ROUND,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_sha256, spans.

    A word is removed if a window of `window` words of its document covers it whose words also start, in this order,
    in a document with a smaller id; windows are judged on the input. `spans` lists the factors as
    first:end:document in words. Null and empty texts have no words, texts shorter than the window lose none. A null id
    ranks behind every id. Rows that share an id never remove from each other; repeated rows give repeated rows. An
    empty table gives an empty result; other columns are ignored. Seeds are compared by 64 bits and by the block,
    which an independent hash chooses, so the odds of a false match stay level as blocks are added.
    """
    spark = docs.sparkSession
    ready(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, batches, wide, slices = plan(total, block_bytes, batch_bytes, blocks_a_round)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda groups: max(least, min(groups, MOST_PARTITIONS))
    dealt = plain.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(batches))).repartition(parts(batches), "batch")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Batch(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), window, blocks)
        me = key[0].as_py()
        keys = b.block if wide == 1 else b.block // wide * slices + me % slices
        return _table(_asked_rows(keys, b.block, b.seed, b.doc, b.place, np.full(len(b.seed), me, dtype=np.int64)), _ASKED)

    def answer(last: bool):
        def run(table: pa.Table) -> pa.Table:
            lists = {c: table.column(c).to_pylist() for c in ("blocks", "docs", "places", "batches")}
            at = {c: np.concatenate([_unpack(x) for x in v]) for c, v in lists.items()}
            seeds = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("seeds").to_pylist()])
            first, known = settle(at["blocks"], seeds, at["docs"], at["batches"], at["places"])
            k = np.flatnonzero(known)
            k = k[np.lexsort((at["places"][k], at["batches"][k]))]
            told = list(_cuts(at["batches"][k]))
            out = {
                "key": [-1] * len(told), "docs": [_pack(at["docs"][first[k[s]]]) for _, s in told], "places": [_pack(at["places"][first[k[s]]]) for _, s in told],
                "batch": [b for b, _ in told], "own": [_pack(at["places"][k[s]]) for _, s in told],
            }
            settled = _table(out, _SETTLED)
            if last:
                return settled
            # of each seed only the first document's entries go on: the others have been told of an earlier one
            on = np.flatnonzero(at["docs"] == at["docs"][first])
            on = on[np.lexsort((at["places"][on], at["docs"][on], at["blocks"][on]))]
            more = _asked_rows(at["blocks"][on], at["blocks"][on], seeds[on], at["docs"][on], at["places"][on], at["batches"][on])
            return pa.concat_tables([settled, _table(more, _SETTLED)])

        run.__annotations__ = {"table": pa.Table, "return": pa.Table}
        return run

    def parse(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), window, blocks)
        # by place of the batch: the first document known, and the place there
        docs_, places = np.full(len(b.owner), NULL_ID, dtype=np.int64), np.zeros(len(b.owner), dtype=np.int64)
        docs_[b.place], places[b.place] = b.doc, b.place
        for own, d, p in zip(*(right.column(c).to_pylist() for c in ("own", "docs", "places")), strict=True):
            own, d, p = (_unpack(x) for x in (own, d, p))
            better = d < docs_[own]  # of two rounds' answers the later one is earlier
            docs_[own[better]], places[own[better]] = d[better], p[better]
        docs_, places = docs_[b.same], places[b.same]
        rows = []
        for i, (doc_id, text) in enumerate(zip(b.given, b.texts, strict=True)):
            words = text.encode("utf-8").split() if text else []
            mine = slice(b.edge[i], b.edge[i + 1])
            spans = factors(docs_[mine], places[mine], int(b.ids[i]), window)
            removed = 0
            if spans:
                keep = np.ones(len(words), dtype=bool)
                for first, end, _ in spans:
                    keep[first:end] = False
                removed = int(len(words) - keep.sum())
                words = list(compress(words, keep.tolist()))
            said = ",".join(f"{first}:{end}:{d}" for first, end, d in spans)
            rows.append((doc_id, int(b.n_words[i]), removed, hashlib.sha256(b" ".join(words)).hexdigest(), said))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return _table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}, SCHEMA)

    asked = dealt.groupBy("batch").applyInArrow(ask, _ASKED)
    told = ["batch", "own", "docs", "places"]
    if wide > 1:
        once = written(asked.repartition(parts(-(-blocks // wide) * slices), "key").groupBy("key").applyInArrow(answer(False), _SETTLED), "settled")
        asked = once.where("key >= 0").drop("batch", "own")
        answers = once.where("key < 0").select(told)
    final = asked.repartition(parts(2 * blocks), "key").groupBy("key").applyInArrow(answer(True), _SETTLED).select(told)
    answers = final if wide == 1 else answers.unionByName(final)
    return dealt.groupBy("batch").cogroup(answers.repartition(parts(batches), "batch").groupBy("batch")).applyInArrow(parse, SCHEMA)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
dup AS (SELECT s.doc_id, s.k FROM s JOIN f USING (win) WHERE f.first < s.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM dup),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS body, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) w
  LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
