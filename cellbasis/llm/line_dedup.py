"""Line dedup by pairwise alignment: documents that share lines are aligned, common blocks leave the later one.

Every line two documents share leads to a pair with its first holder (smallest id): rare lines and lines that a third of
all documents have alike give at most one pair a document. Where that pair doesn't align the line, as the holder has it
twice or in another order, `every_pair` goes on to the first holder that has it once, and what is left then to all earlier
holders, eight of them first and 32 times as many whenever something is still left. These are told apart by their
profiles only, in which lines that no other document has are blotted out: no alignment depends on more. Pairs carry
hashes of lines, never text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import attach, ready, written

NULL_ID = (1 << 63) - 1
SHARE = 256  # pairs that one copy of a first holder's lines serves
SLICE = 8  # holders of a line that what first holders left is aligned with first; after them WIDER times as many
WIDER = 32
DEALT = 4096  # rows that ask for a line, and holders of it, in one share
_BLANK = " \t\x0b\x0c\r"
SCHEMA = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string"


def line_hashes(text: Column) -> Column:
    """A hash of each line without outer white space; 0 for blank lines."""
    plain = lambda x: F.btrim(x, F.lit(_BLANK))
    some = lambda x: F.when(plain(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(plain(x)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, "\n"), some))


def align(a: list[int], b: list[int]) -> list[int]:
    """The places in `b` of the lines that patience diff aligns with `a`; a block's outer blank lines don't count.

    Anchors are lines that are unique in both stretches; of these the longest run that ascends in both stays. Blocks
    grow from anchors over equal lines, and the stretches between blocks are aligned in turn.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {h: i for i, h in enumerate(a[a0:a1], a0) if h and once_a[h] == 1 and once_b.get(h) == 1}
        pairs = [(place[h], j) for j, h in enumerate(b[b0:b1], b0) if h in place]
        if not pairs:
            continue
        tails: list[int] = []
        tail_at: list[int] = []
        before = [-1] * len(pairs)
        for k, (i, _) in enumerate(pairs):
            at = bisect_left(tails, i)
            before[k] = tail_at[at - 1] if at else -1
            if at == len(tails):
                tails.append(i)
                tail_at.append(k)
            else:
                tails[at], tail_at[at] = i, k
        run, k = [], tail_at[-1]
        while k >= 0:
            run.append(pairs[k])
            k = before[k]
        i0, j0 = a0, b0
        blocks: list[tuple[int, int, int]] = []
        for i, j in reversed(run):
            if i < i0 or j < j0:
                continue  # inside the last block
            n = 1
            while i > i0 and j > j0 and a[i - 1] == b[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                n += 1
            blocks.append((i, j, n))
            i0, j0 = i + n, j + n
        i0, j0 = a0, b0
        for i, j, n in blocks:
            todo.append((i0, i, j0, j))
            i0, j0 = i + n, j + n
            first, last = j, j + n - 1
            while first <= last and not b[first]:
                first += 1
            while last >= first and not b[last]:
                last -= 1
            out += range(first, last + 1)
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, gone = [], []
        for key, earlier, later in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = align(earlier, later)
            if found:
                keys.append(key)
                gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(gone, type=pa.list_(pa.int32()))], names=["row", "gone"])


def profile(lines: list[int], shared: set[int]) -> list[int | None]:
    """`lines` with each run of lines that aren't `shared` as one None, which equals no line."""
    out: list[int | None] = []
    for h in lines:
        if not h or h in shared:
            out.append(h)
        elif not out or out[-1] is not None:
            out.append(None)
    return out


def _inner_blanks(lines: list[int], shared) -> Iterator[tuple[int, range]]:
    """Each run of blank lines between two lines that are `shared`, as a key of all three and its places."""
    last = -1
    for j, h in enumerate(lines):
        if h:
            if 0 <= last < j - 1 and lines[last] in shared and h in shared:
                yield hash((lines[last], j - last - 1, h)), range(last + 1, j)
            last = j


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row: the keys of what could leave it and hasn't, the lines that can anchor a pair with an earlier document;
    then, of the row as an earlier document, its profile, the keys in it, and the lines that can anchor a pair."""
    names = ["row", "doc", "lines", "left", "once", "profile", "keys", "alone"]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 6]
    for batch in batches:
        rows = []
        for row, doc, lines, common, gone in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            shared = {x["line"]: x["first"] for x in common or ()}
            before = {h for h, first in shared.items() if first < doc}
            drop = set(gone or ())
            left = {h for j, h in enumerate(lines) if h in before and j not in drop}
            left.update(k for k, places in _inner_blanks(lines, before) if any(j not in drop for j in places))
            alone = [h for h, n in Counter(lines).items() if n == 1 and h in shared]
            keys = {*(h for h in lines if h in shared), *(k for k, _ in _inner_blanks(lines, shared))} if alone else ()
            rows.append((row, doc, lines, list(left), [h for h in alone if h in before], profile(lines, set(shared)), list(keys), alone))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            lines = (text.as_py() or "").split("\n") if text.is_valid and len(text.as_py()) else []
            drop = set(gone or ())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            rows.append((doc_id, len(lines), len(drop), hashlib.sha256(kept.encode("utf-8")).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _gone(pairs: DataFrame, earlier: DataFrame, later: DataFrame) -> DataFrame:
    """For each of the distinct `pairs` (row, first) the places that leave the row. `earlier`: arrays of lines by first, of
    which the least counts, `later`: by row. An earlier document with many pairs is copied once for each share of them."""
    firsts = written(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("pairs")).withColumn("shares", F.ceil(F.col("pairs") / SHARE).cast("int")), "firsts")
    earlier = earlier.join(firsts, "first").groupBy("first").agg(F.min("lines").alias("earlier"), F.max("shares").alias("shares"))
    earlier = earlier.select("first", "earlier", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = attach(pairs, firsts, "first", "pairs", pairs.count(), F.col("row")).withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    both = dealt.select("row", "first", "share").join(later, "row").join(earlier, ["first", "share"])
    return both.select("row", "earlier", "later").mapInArrow(_aligned, "row long, gone array<int>")


def _united(gone: DataFrame) -> DataFrame:
    return gone.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _further(keyed: DataFrame, shared: DataFrame, gone: DataFrame) -> DataFrame:
    """`gone` with what the pairs through first holders missed, so that it is what all pairs give."""
    common = shared.groupBy("row").agg(F.collect_list(F.struct("line", "first")).alias("common"))
    kinds = "row long, doc long, lines array<bigint>, left array<bigint>, once array<bigint>, profile array<bigint>, keys array<bigint>, alone array<bigint>"
    whole = keyed.dropDuplicates(["row"]).join(common, "row", "left").join(gone, "row", "left")
    whole = written(whole.select("row", "doc", "lines", "common", "gone").mapInArrow(_rest, kinds), "rest")
    rest = whole.where("size(left) > 0 and size(once) > 0")  # the others have nothing to lose or no anchor
    if rest.isEmpty():
        return gone
    # earlier documents that differ in their profiles, each by its smallest id
    known = whole.groupBy("doc").agg(F.min(F.struct("lines", "profile", "keys", "alone")).alias("x")).where("size(x.alone) > 0")
    known = known.groupBy("x.profile").agg(F.min(F.struct("doc", "x.keys", "x.alone")).alias("x"))
    known = written(known.select(F.col("x.doc").alias("first"), F.col("profile").alias("lines"), "x.keys", "x.alone"), "profiles")
    sole = known.select("first", F.explode("alone").alias("line")).groupBy("line").agg(F.min("first").alias("first"))
    # first holders that have a line once, for the lines that the row has once; a row for which there is none has no anchor
    asked = written(rest.select("row", "doc", F.explode("once").alias("line"), F.array_contains("left", F.col("line")).alias("open")), "asked")
    sole = asked.groupBy("line").agg(F.count(F.lit(1)).alias("n")).join(sole, "line")
    met = written(attach(asked, sole, "line", "n", asked.count(), F.col("row")).where("first < doc").select("row", "first", "open"), "met")
    more = written(_gone(met.where("open").select("row", "first").distinct(), known, rest.select("row", F.col("lines").alias("later"))), "gone")
    gone = written(_united(gone.unionByName(more)), "gone")
    asking = rest.join(met.select("row").distinct(), "row", "left_semi").select("row", "doc", "lines", _signs("once").alias("signs"))
    asking = written(asking.join(common, "row"), "asking")
    gone = [gone]
    left = _left(asking, asking, gone, kinds)
    holders = _holders(known, left)
    widest = holders.agg(F.max("m")).first()[0] or 0
    low, high = 0, SLICE
    while low < widest:
        pairs = written(_asked(left, holders, low, high), "line-pairs")
        gone.append(written(_gone(pairs, known, asking.select("row", F.col("lines").alias("later"))), "gone"))
        left = _left(asking, left, gone, kinds)
        low, high = high, high * WIDER
        if left.isEmpty():
            break
    return _united(reduce(DataFrame.unionByName, gone))


def _signs(lines: str) -> Column:
    """64 bits, of which each of `lines` sets one: arrays that have no bit alike have no line alike."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x)))


def _left(asking: DataFrame, rows: DataFrame, gone: list[DataFrame], kinds: str) -> DataFrame:
    """Those of `rows` (row) that still have something to lose after all of `gone`, each with the keys of that."""
    some = asking.join(rows.select("row"), "row", "left_semi")
    so_far = _united(reduce(DataFrame.unionByName, gone).join(some.select("row"), "row", "left_semi"))
    found = some.join(so_far, "row", "left").select("row", "doc", "lines", "common", "gone").mapInArrow(_rest, kinds)
    return written(found.where("size(left) > 0").select("row", "doc", "left").join(some.select("row", "signs"), "row"), "left")


def _holders(known: DataFrame, left: DataFrame) -> DataFrame:
    """The `known` documents that have a key of `left`: key, first, signs, m (how many have it) and at, from 0 to m: a place
    among these that a hash gives, so that any stretch of places holds about as many documents as it is long."""
    keys = left.select(F.explode("left").alias("key")).distinct()
    postings = known.select("first", F.explode("keys").alias("key"), _signs("alone").alias("signs"))
    sizes = written(postings.groupBy("key").agg(F.count(F.lit(1)).alias("m")).join(keys, "key", "left_semi"), "sizes")
    held = attach(postings, sizes, "key", "m", known.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0], F.col("first")).where("m is not null")
    return written(held.withColumn("at", F.pmod(F.xxhash64("key", "first"), F.lit(1 << 53)) / F.lit(float(1 << 53)) * F.col("m")), "postings")


def _asked(left: DataFrame, holders: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs (row, first) of the rows `left` with the earlier holders of their keys at the places from `low` to `high`, but for
    those without a line in both that each has once. A key's rows and places are dealt into shares, so that none is hot."""
    asked = left.select("row", "doc", "signs", F.explode("left").alias("key"))
    holders = holders.where((F.col("at") >= low) & (F.col("at") < high))
    sizes = holders.groupBy("key").agg(F.max("m").alias("m"), F.count(F.lit(1)).alias("held"))
    sizes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(sizes, "key")
    sizes = written(sizes.withColumn("shares", F.ceil(F.col("n") / DEALT).cast("int")), "sizes")
    part = lambda x: F.floor(x / DEALT).cast("int")
    asked = attach(asked, sizes, "key", "n", asked.count(), F.col("row")).where("m is not null")
    asked = asked.withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    asked = asked.select("row", "doc", "signs", "key", "share", F.explode(F.sequence(part(F.lit(low)), part(F.least(F.col("m"), F.lit(high))))).alias("part"))
    total = sizes.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    holders = attach(holders.drop("m"), sizes.select("key", "held", "shares"), "key", "held", total, F.col("first")).where("shares is not null")
    holders = holders.select("first", F.col("signs").alias("alone"), "key", part(F.col("at")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    met = asked.join(holders, ["key", "share", "part"]).where("first < doc and (signs & alone) != 0")
    return met.select("row", "first").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_pair: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_lines, n_removed, kept_sha256, kept_text.

    Lines end at \\n and are compared without outer white space. A document is aligned with the first holder of each line
    that it shares with a smaller id, as both stand in the input, and loses the aligned blocks of all these pairs; with
    `every_pair` it loses those of its pairs with all documents of smaller ids. Blank lines lead to no pair of first holders
    and go only from within a block. Null and empty texts have no lines. A null id ranks behind
    every id. Rows that share an id don't affect each other, and repeated rows give repeated rows; where an id comes with
    several texts, later documents are aligned with the least of these as arrays of hashes. An empty table gives an
    empty result; other columns are ignored.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = plain.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), line_hashes(F.col("text")).alias("lines"))
    keyed = written(keyed, "lines")
    held = keyed.select("doc", "row", F.explode(F.array_distinct("lines")).alias("line")).where("line != 0")
    holders = held.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    holders = written(holders.drop("last"), "holders")
    total = keyed.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    shared = attach(held, holders, "line", "n", total, F.col("row")).where("first is not null").select("row", "doc", "line", "first")
    if every_pair:
        shared = written(shared, "shared")
    pairs = written(shared.where("first < doc").select("row", "first").distinct(), "line-pairs")
    gone = _united(_gone(pairs, keyed.select(F.col("doc").alias("first"), "lines"), keyed.select("row", F.col("lines").alias("later")).dropDuplicates(["row"])))
    if every_pair:
        gone = _further(keyed, shared, written(gone, "gone"))
    # a merge at every size: `gone` grows with the documents
    return plain.withColumn("row", F.xxhash64("doc_id", "text")).join(gone.hint("merge"), "row", "left").select("doc_id", "text", "gone").mapInArrow(_cut, SCHEMA)
