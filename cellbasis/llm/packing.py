"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by large-item matching.

What matters for packing is how many pieces there are of each length, and there are at most `capacity` lengths. So the
plan is made on the driver from that histogram alone, whatever the input's size, as ranges: "pieces number r to
r + n of length l go to sequences b to b + n at offset o". A piece's number among those of its length comes from
counts by written partition. Nothing is sorted or gathered globally.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellbasis.llm.common import chunks, ready, written

CAPACITY = 2048
END = 0  # the id that follows each document

#: Characters for which the two libraries' word patterns agree in every Unicode version are the others.
_PLAIN = re.compile("[^\t\n\r -~\xa0-ɏ‐-‟]")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes, in order, have the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, equal to those of the tokenizer file in the `tokenizers` library.

    A byte-level BPE whose ids follow the order of its merges gives the same ids in tiktoken, in a third of the time; this is
    read off the file. Other files, and texts with special tokens or with characters that the two libraries' word
    patterns may take differently, go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, words = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] == "BPE" and not spec.get("normalizer") and words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space") and not model.get("dropout"):
            byte, vocab = _byte_of(), {k: v for k, v in model["vocab"].items() if k not in self.special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            merged = [vocab.get("".join(m)) for m in merges]
            if all(c in byte for k in vocab for c in k) and merged == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges):
                ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
                self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.fast is None or _PLAIN.search(t) or any(s in t for s in self.special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                out.append(self.fast.encode_to_numpy(t).astype("<u4", copy=False).tobytes())
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of `size` tokens; the first may be shorter."""
    head = (size - 1) % capacity + 1
    return [(0, head), *((at, capacity) for at in range(head, size, capacity))]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, number, n, sequence, offset): pieces number .. number + n of that length go to sequences
    sequence .. sequence + n at that offset. Sequences are numbered from 0."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    number = np.zeros(capacity + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # sequences (first, n) by room left
    bins = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, int(number[length]), n, sequence, offset))
        number[length] += n
        left[length] -= n

    # above a third of the capacity two fit at most: match each, longest first, with the longest that fits beside it
    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            b = next((b for b in range(min(a, capacity - a), third, -1) if left[b] - (b == a) > 0), 0)
            n = int(left[a]) if not b else int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
            put(a, n, bins, 0)
            if b:
                put(b, n, bins, a)
            if a + b < capacity:
                gaps[capacity - a - b].append((bins, n))
            bins += n
    # the others, longest first, each to the least room that holds it
    for s in range(third, 0, -1):
        while left[s]:
            g = min((g for g, some in gaps.items() if g >= s and some), default=0)
            each = (g or capacity) // s
            if g:
                first, n = gaps[g].pop()
                if not gaps[g]:
                    del gaps[g]
            else:
                g, first, n = capacity, bins, max(1, int(left[s]) // each)
                bins += n
            full = min(n, int(left[s]) // each)
            if full:
                for t in range(each):
                    put(s, full, first, capacity - g + t * s)
                if g > each * s:
                    gaps[g - each * s].append((first, full))
            if full < n:
                some = min(each, int(left[s]))
                for t in range(some):
                    put(s, 1, first + full, capacity - g + t * s)
                if g > some * s:
                    gaps[g - some * s].append((first + full, 1))
                if n - full > 1:
                    gaps[g].append((first + full + 1, n - full - 1))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def place(length: np.ndarray, number: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and numbers; `rows` sorted by length and number."""
    key = (rows[:, 0] << np.int64(48)) + rows[:, 1]
    at = np.searchsorted(key, (length << np.int64(48)) + number, side="right") - 1
    return rows[at, 3] + number - rows[at, 1], rows[at, 4]


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The pieces of every document, numbered among those of the same length in the same partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = tokens(path).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, b in chunks(texts, 1 << 19):
                for doc_id, data in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    data += end
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, int(seen[length])))
                        seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids without special tokens, then id 0; null and empty texts are that id alone. Documents of more
    than `capacity` tokens are cut into pieces of `capacity`, the first of which may be shorter; others stay whole.
    Each sequence is filled without gaps from offset 0. Rows repeated in `docs`, null ids included, are packed
    each for itself. An empty table gives an empty result; other columns are ignored. `tokenizer` is the file's path.
    """
    spark = docs.sparkSession
    ready(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(pieces(plain, tokenizer, capacity), "pieces")
    # one row for each partition and length that occurs
    counts = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = place(length, number, rows)
            columns = [*(batch.column(i) for i in range(5)), pa.array(sequence, type=pa.int64()), pa.array(offset, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = table.join(base, (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number")).mapInArrow(run, SCHEMA)
