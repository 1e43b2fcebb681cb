"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, each text scanned once.

Executors build the automaton and write it to the shared folder. An item table beyond MAX_ITEM_BYTES has an automaton for each
such part of it; a task scans a bounded buffer of its texts with one after the other and unites the hits, so the corpus is read
once and nothing of it is shuffled, whatever the items' size, and a task holds one automaton and one buffer.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import chunks, file_system, new_path, ready
from cellbasis.llm.wordautomaton import Automaton

WINDOW = 10
#: Bytes of item text in one automaton, which takes some 15 times as many in memory.
MAX_ITEM_BYTES = 16 << 20
BUFFER_CHARS = 32 << 20  # of texts that are scanned with each of several automata before the next is loaded

#: A word: bytes of UTF-8 after A-Z became a-z. Bytes from \x80 are parts of other characters, which all count.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_IN_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8").lower()) if text else []


def build(items: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> tuple[str, list[str]]:
    """Build the automata of `items` (item_id, text) on the executors: the folder and the names of their files."""
    spark = items.sparkSession
    folder = new_path(spark, "automata")
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // max_item_bytes))

    def make(table: pa.Table) -> pa.Table:
        rows = zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)
        automaton = Automaton([(i, words_of(t)) for i, t in rows], window)
        names = []
        if automaton.sizes:
            fs, path = file_system(folder)
            fs.create_dir(path, recursive=True)
            names.append(f"{uuid.uuid4().hex}.automaton")  # made anew by each attempt; a lost attempt's file is never listed
            with fs.open_output_stream(f"{path}/{names[0]}", compression=None) as out:
                out.write(pickle.dumps(automaton, protocol=5))
        return pa.table({"name": pa.array(names, type=pa.string())})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    return folder, sorted(r.name for r in dealt.groupBy("part").applyInArrow(make, "name string").collect())


def spans_of(text: str, hit: np.ndarray) -> str:
    """The hit words' runs as start:end in code points of the original text, comma-joined."""
    out: list[list[int]] = []
    last = -2
    for i, m in enumerate(_WORD_IN_TEXT.finditer(text)):
        if hit[i]:
            if last == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in out)


class Hits:
    """What the windows found in one text: its number of words, stretches of hit words, ids of items."""

    def __init__(self, n_words: int):
        self.n_words, self.stretches, self.items = n_words, [], set()

    def mask(self) -> np.ndarray:
        edge = np.zeros(self.n_words + 1, dtype=np.int64)
        for first, size in self.stretches:
            edge += np.bincount(first, minlength=self.n_words + 1) - np.bincount(first + size, minlength=self.n_words + 1)
        return np.cumsum(edge[:-1]) > 0


def scan(texts: list[str | None], automata: Iterator[Automaton]) -> list[Hits]:
    """The hits of each text with all `automata`, which are taken one after the other."""
    out: list[Hits] = []
    for automaton in automata:
        new = not out
        for a, b in chunks(texts, 1 << 20):
            words = [words_of(t) for t in texts[a:b]]
            if new:
                out += [Hits(len(w)) for w in words]
            numbers: list[int] = []
            for w in words:
                numbers += automaton.numbered(w)
                numbers.append(-1)
            first, size, code = automaton.scan(np.array(numbers, dtype=np.int32))
            if not len(first):
                continue
            begins = np.cumsum([0] + [len(w) + 1 for w in words])
            text = np.searchsorted(begins, first, side="right") - 1
            order = np.argsort(text, kind="stable")
            cuts = np.flatnonzero(np.diff(text[order], prepend=-1))
            for mine in np.split(order, cuts[1:]):
                hits, start = out[a + int(text[mine[0]])], begins[text[mine[0]]]
                hits.stretches.append((first[mine] - start, size[mine]))
                for c in np.unique(code[mine]).tolist():
                    hits.items.update(automaton.items_of(c))
    return out or [Hits(len(words_of(t))) for t in texts]


def _loader(folder: str, names: list[str]) -> Callable[[], Iterator[Automaton]]:
    """A function that yields the automata one after the other; a single one is loaded once and kept."""
    kept: list[Automaton] = []

    def load() -> Iterator[Automaton]:
        if kept:
            yield kept[0]
            return
        for name in names:
            fs, path = file_system(folder)
            with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                automaton = pickle.loads(f.read())
            if len(names) == 1:
                kept.append(automaton)
            yield automaton

    return load


def _buffered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive batches with up to about `limit` bytes of text in all, one at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = batch.column(column).nbytes
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield held


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())]
)


def _row(doc_id, text: str | None, hits: Hits) -> tuple:
    listed = hashlib.sha256(",".join(sorted(hits.items)).encode("utf-8")).hexdigest()
    if not hits.items:
        return doc_id, hits.n_words, 0, 0, listed, False, ""
    mask = hits.mask()
    return doc_id, hits.n_words, int(mask.sum()), len(hits.items), listed, True, spans_of(text, mask)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs` with the words that any window of `items` (item_id, text) covers.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Texts without
    words, null included, have n_words 0 and are clean; items without words have no window; without items every
    document is clean. Item ids are compared as strings (null: ''); an id that comes twice counts once. Rows repeated in
    `docs` give repeated rows. Other columns are ignored. `spans` gives the hit runs' offsets in the original text.
    """
    ready(docs.sparkSession)
    folder, names = build(items, window, max_item_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(folder, names)
        for held in _buffered(batches, 1, BUFFER_CHARS if len(names) > 1 else 0):
            texts = [t for b in held for t in b.column(1).to_pylist()]
            ids = [i for b in held for i in b.column(0).to_pylist()]
            rows = [_row(i, t, h) for i, t, h in zip(ids, texts, scan(texts, load()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean_only(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of `items` occurs. Null texts and texts without words stay,
    as do all rows where no item has words; repeated rows stay repeated, and an empty table is an empty result."""
    ready(docs.sparkSession)
    folder, names = build(items, window, max_item_bytes)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(folder, names)
        for held in _buffered(batches, at, BUFFER_CHARS if len(names) > 1 else 0):
            hits = scan([t for b in held for t in b.column(at).to_pylist()], load())
            clean = pa.array([not h.items for h in hits], type=pa.bool_())
            first = 0
            for batch in held:
                yield batch.filter(clean.slice(first, len(batch)))
                first += len(batch)

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s.n AS n, k, array_to_string(list_slice(w, k, k + s.n - 1), ' ') AS win
  FROM (SELECT doc_id, w, sizes.n AS n, unnest(range(1, len(w) - sizes.n + 2)) AS k FROM d, sizes) s),
m AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
