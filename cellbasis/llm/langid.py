"""Language identification by cross-parsing: the language whose automaton needs fewest phrases wins.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily
into phrases, each the longest match that the automaton yields at that place. The number of phrases, normalised by
the sample's and the text's length, estimates the cross-entropy of the text under the language.

Every letter of the samples is a symbol of its own. The automata are sparse transition tables, whose size follows the
sample and not the alphabet, and many segments of text walk through them side by side, one character a step, so the cost
is a few array operations a step whatever the number of segments. Segments of one text are then joined: the phrases are
those of one parse through the whole text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import chunks, keep_rows, ready

UNKNOWN = "und"
#: The documented bound of the training sample: documents a language (on average, twice as many at most), characters of
#: each, characters a language, which come from all these documents alike.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 1000
TRAIN_CHARS = 30_000
#: Languages of one model. Beyond it languages are dealt into groups by frequency, each with a model and a pass of its own,
#: and the best costs of all passes count: no label is left out.
LANGUAGES_A_PASS = 64
SEGMENT = 256  # characters that walk as one; a longer text is several segments, joined afterwards
FEW_LANES, ROUNDS = 24, 4  # so few walk on faster one by one, as do those that so many rounds side by side have not settled
_POINTS = 0x110000  # code points
_LOW = (1 << 32) - 1

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # symbol of each code point: 0 not a letter, 1.. letters of the samples, then one for the rest
    symbols: int  # all symbols, padding included
    local: list[np.ndarray]  # a language's own symbol by symbol: 0 not a letter, 1.. its sample's letters, then one for all that it lacks, padding
    tables: list[np.ndarray]  # by state + own symbol: the state, << 32, | the next state; another state there: no transition
    bits: list[float]  # bits that a phrase costs


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the minimal automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step, link


def sparse_table(step: list[dict[int, int]], symbols: int) -> np.ndarray:
    """The transitions as one array, in which each state is the place its symbols count from; no two have the same.

    The root is 0 and has all `symbols`: those without a transition lead back to it.
    """
    rows = sorted(range(1, len(step)), key=lambda s: -len(step[s]))
    size = 1 << (2 * max(len(step) + symbols, sum(map(len, step)) + symbols)).bit_length()
    rng = random.Random(size)
    while True:
        used = bytearray(b"\1" * symbols + bytes(size))
        at, taken = [0] * len(step), {0}
        for s in rows:
            for _ in range(1000):
                place = rng.randrange(1, size)
                if place not in taken and not any(used[place + c] for c in step[s]):
                    break
            else:
                break  # too crowded
            taken.add(place)
            at[s] = place
            for c in step[s]:
                used[place + c] = 1
        else:
            break
        size *= 2
    out = np.full(size + symbols, -1 << 32, dtype=np.int64)
    out[:symbols] = 0
    for s, row in enumerate(step):
        for c, to in row.items():
            out[at[s] + c] = at[s] << 32 | at[to]
    return out


def _symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """The symbols of `text` in lower case, each run of what isn't a letter as one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = codes[points]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def _even(parts: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """The middles of `parts`, `limit` symbols in all: no part is cut to less than any other has. Each ends with its last
    symbol, which isn't a letter."""
    room, longest = limit, 0
    by_size = sorted(len(p) for p in parts)
    for i, n in enumerate(by_size):
        if n * (len(by_size) - i) > room:
            longest = room // (len(by_size) - i)
            break
        room, longest = room - n, n
    spare = max(0, limit - sum(min(n, longest) for n in by_size))  # of the division, one symbol a part
    out = []
    for p in parts:
        size = min(len(p), longest + (spare > 0 and len(p) > longest))
        spare -= size > longest
        if size:
            first = (len(p) - size) // 2
            out.append(np.append(p[first : first + size - 1], p[-1]))
    return out


def train(samples: dict[str, list[str]], train_chars: int = TRAIN_CHARS) -> Model:
    """A model of each language's sample texts; of languages that tie, the first in `samples` wins."""
    langs = list(samples)
    seen = sorted({ord(c) for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
    letter = np.array([chr(i).isalpha() for i in range(_POINTS)])
    codes = np.where(letter, len(seen) + 1, 0).astype(np.int32)
    codes[seen] = np.arange(1, len(seen) + 1)
    symbols = len(seen) + 3  # none, letters, other letters, padding
    local, tables, bits = [], [], []
    for lang in langs:
        text = np.concatenate([np.zeros(1, dtype=np.int32), *_even([_symbols(t + " ", codes) for t in samples[lang]], train_chars - 1)])
        own = np.unique(text[text != 0])
        to_own = np.full(symbols, len(own) + 1, dtype=np.int32)
        to_own[0], to_own[own], to_own[symbols - 1] = 0, np.arange(1, len(own) + 1), len(own) + 2
        step, _ = suffix_automaton(to_own[text].tolist())
        local.append(to_own)
        tables.append(sparse_table(step, len(own) + 3))
        bits.append(float(np.log2(len(text) + 1)))
    return Model(langs, codes, symbols, local, tables, bits)


def _walk(lanes: np.ndarray, own: np.ndarray, table: np.ndarray, state: np.ndarray, starts: np.ndarray, again: bool) -> tuple[np.ndarray, np.ndarray]:
    """Walk the columns of `lanes` (step by step, one lane a segment) from `state`; mark in `starts` where phrases begin.

    With `again`, a lane stops at the first phrase that begins where one began in the walk before: from there on both are the
    same. Returns the lanes' states at their ends and, with `again`, which lanes never met their earlier walk.
    """
    root = table[: own.max() + 1] & _LOW
    live = np.arange(lanes.shape[1])
    for step, column in enumerate(lanes):
        symbol = own[column[live] if again else column]
        found = table[state + symbol]
        begins = (state == 0) | ((found >> 32) != state)  # the phrase before has ended; what the language lacks leads to the root
        state = np.where(begins, root[symbol], found & _LOW)
        if not again:
            starts[step] = begins
            continue
        met = begins & starts[step, live]
        starts[step, live] = begins
        if met.any():
            live, state = live[~met], state[~met]
            if not len(live):
                break
    return state, live


def _walk_on(lanes: np.ndarray, joined: np.ndarray, own: np.ndarray, table: np.ndarray, ends: np.ndarray, starts: np.ndarray, lane: int) -> None:
    """Walk one lane again from the end of the lane before it, and on through its text, up to a phrase that began there before too."""
    root = (table[: own.max() + 1] & _LOW).tolist()
    state = int(ends[lane - 1])
    while True:
        before = starts[:, lane].tolist()
        for step, symbol in enumerate(own[lanes[:, lane]].tolist()):
            found = int(table[state + symbol])
            if state == 0 or found >> 32 != state:
                if before[step]:
                    return
                starts[step, lane], state = True, root[symbol]
            else:
                starts[step, lane], state = False, found & _LOW
        ends[lane] = state
        lane += 1
        if lane >= len(joined) or not joined[lane]:
            return


def _starts(lanes: np.ndarray, joined: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where phrases begin in each lane when lanes that are `joined` go on where the lane before ends.

    All lanes first walk from the root. A joined lane then walks again from the state that the lane before ends in, up to the
    first phrase that both walks begin at the same symbol, mostly a few symbols on; where they never do, the lane after it
    walks again too. The result is that of one walk through the whole text.
    """
    starts = np.zeros(lanes.shape, dtype=bool)
    ends, _ = _walk(lanes, own, table, np.zeros(lanes.shape[1], dtype=np.int64), starts, False)
    todo = np.flatnonzero(joined)
    for _ in range(ROUNDS):
        if len(todo) <= FEW_LANES:
            break
        part = np.ascontiguousarray(starts[:, todo])
        state, unmet = _walk(lanes[:, todo], own, table, ends[todo - 1], part, True)
        starts[:, todo] = part
        changed = todo[unmet]
        ends[changed] = state
        after = changed + 1
        after = after[after < len(joined)]
        todo = after[joined[after]]
    for lane in todo.tolist():  # in the order of the text: what the first one sets right the next one meets
        _walk_on(lanes, joined, own, table, ends, starts, lane)
    return starts


def phrases(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: phrases by language, number of symbols, and whether it has a letter."""
    parts = [_symbols(t, model.codes) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    letters = np.array([bool((p != 0).any()) for p in parts])
    rows = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(rows)])
    padding = model.symbols - 1
    lanes = np.full((int(first[-1]), SEGMENT), padding, dtype=np.int32)
    flat = lanes.reshape(-1)
    for p, at in zip(parts, first[:-1].tolist(), strict=True):
        flat[at * SEGMENT : at * SEGMENT + len(p)] = p
    lanes = np.ascontiguousarray(lanes.T)
    real = lanes != padding
    joined = np.ones(lanes.shape[1], dtype=bool)
    joined[first[:-1][rows > 0]] = False
    out = np.zeros((len(texts), len(model.langs)), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), rows)
    for k, table in enumerate(model.tables):
        if len(owner):
            began = (_starts(lanes, joined, model.local[k], table) & real).sum(axis=0)
            out[:, k] = np.bincount(owner, weights=began, minlength=len(texts)).astype(np.int64)
    return out, sizes, letters


def best_two(texts: list[str | None], model: Model) -> list[list[tuple[float, int]]]:
    """For each text the least costs with their languages' places in the model, two at most; of ties the model's first
    come first. None where the text has no letter."""
    given = [t or "" for t in texts]
    counts, sizes, letters = phrases(given, model)
    out: list[list[tuple[float, int]]] = []
    cost = counts * np.array(model.bits)[None, :] / np.maximum(sizes, 1)[:, None] if model.langs else counts
    for i, text in enumerate(given):
        known = model.langs and letters[i] and any(c.isalpha() for c in text)
        out.append([(float(cost[i, k]), int(k)) for k in np.argsort(cost[i], kind="stable")[:2]] if known else [])
    return out


def verdict(found: list[tuple[float, str]]) -> tuple[str, float]:
    """Language and score of the least costs: 1 - the best / the second best; 1 where there is no second."""
    if not found:
        return UNKNOWN, 0.0
    return found[0][1], 1 - found[0][0] / found[1][0] if len(found) > 1 else 1.0


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and score of each text: 1 - the best language's bits / the second best's; ties go to the model's first."""
    return [verdict([(cost, model.langs[k]) for cost, k in found]) for found in best_two(texts, model)]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; such rows are never learnt from. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _labelled(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")


def label_groups(docs: DataFrame, a_pass: int = LANGUAGES_A_PASS) -> list[dict[str, int]]:
    """Every label with its number of rows, the most frequent first, in groups of `a_pass`; one empty group if there is none."""
    counts = [(r.lang, r.n) for r in _labelled(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]
    return [dict(counts[i : i + a_pass]) for i in range(0, max(1, len(counts)), a_pass)]


def sample(docs: DataFrame, counts: dict[str, int], docs_a_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """The training sample of the labels in `counts` (of `label_groups`): about `docs_a_language` rows a language, chosen by a
    hash of the id, the same rows every time, `chars` characters from the middle of each; in the order of `counts`. Bounded
    whatever the table's size."""
    rows = _labelled(docs)
    if not counts:
        return {}
    span = 1 << 32
    at_most = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(span, -(-docs_a_language * span // n)))) for k, n in sorted(counts.items())])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < at_most)
    middle = F.greatest(F.lit(1), (F.length("text") / 2 - chars / 2).cast("int"))
    # repeated rows count once; the limit holds even where the hash draws more than it should
    drawn = drawn.select("lang", "doc_id", F.substring("text", middle, F.lit(chars)).alias("part")).distinct()
    drawn = drawn.orderBy(F.xxhash64("doc_id", "lang", "part"), "lang", "part").limit(2 * docs_a_language * len(counts))
    out: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r.part)):
        out.setdefault(r.lang, []).append(r.part)
    return {k: out[k] for k in counts if any(c.isalpha() for t in out.get(k, []) for c in t)}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = TRAIN_CHARS, a_pass: int = LANGUAGES_A_PASS) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of rows that aren't held out, every label of them; predicts from the whole text alone.
    `und` with score 0 where the text is null or has no letter, or where no row is labelled. Where languages tie the one
    with most labelled rows wins. Null ids count as ''. Repeated rows give repeated rows, an empty table an empty result; other columns
    are ignored.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    groups = label_groups(plain, a_pass)
    if len(groups) > 1:
        return _identify_in_passes(plain, groups, train_chars)
    model = docs.sparkSession.sparkContext.broadcast(train(sample(plain, groups[0]), train_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found: list[tuple[str, float]] = []
            for a, b in chunks(texts, 1 << 20):
                found += predict(texts[a:b], m)
            langs = pa.array([x[0] for x in found], type=pa.string())
            scores = pa.array([x[1] for x in found], type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), langs, scores], names=["doc_id", "held_out", "lang_pred", "score"])

    return plain.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def _identify_in_passes(plain: DataFrame, groups: list[dict[str, int]], train_chars: int) -> DataFrame:
    """What one model of all `groups` together would give, by a pass for each."""
    keyed = plain.select("doc_id", "text", F.xxhash64("text").alias("k"), F.sha2("text", 256).alias("s"))
    found = "array<struct<cost: double, rank: long, lang: string>>"
    united, rank = None, 0
    for counts in groups:
        model = plain.sparkSession.sparkContext.broadcast(train(sample(plain, counts), train_chars))
        one = keyed.mapInArrow(_costs(model, rank), f"doc_id long, k long, s string, found {found}")
        united = one if united is None else united.unionByName(one)
        rank += len(counts)
    by_text = united.groupBy("doc_id", "k", "s").agg((F.count(F.lit(1)) / len(groups)).cast("int").alias("times"), F.slice(F.array_sort(F.flatten(F.collect_set("found"))), 1, 2).alias("found"))
    best, second = F.col("found")[0], F.col("found")[1]
    score = F.when(F.size("found") == 0, F.lit(0.0)).when(F.size("found") == 1, F.lit(1.0)).otherwise(1 - best["cost"] / second["cost"])
    told = by_text.withColumn("lang_pred", F.when(F.size("found") == 0, F.lit(UNKNOWN)).otherwise(best["lang"])).withColumn("score", score)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t")).drop("t")


def _costs(model, rank: int):
    """The function that finds the least costs under `model`, whose first language has this rank among all labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        kind = pa.list_(pa.struct([("cost", pa.float64()), ("rank", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[list[dict]] = []
            for a, b in chunks(texts, 1 << 20):
                rows += [[{"cost": cost, "rank": rank + k, "lang": m.langs[k]} for cost, k in two] for two in best_two(texts[a:b], m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rows, type=kind)], names=["doc_id", "k", "s", "found"])

    return run


def known_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, with all their columns, whose language can be told: not null and not without any letter. Where no
    row can be learnt from, because none is labelled, or all that are labelled are held out or have no letter, every text
    with a letter stays."""
    ready(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # any model's verdict is und for the same texts, so the first group's does for all
    model = docs.sparkSession.sparkContext.broadcast(train(sample(plain, label_groups(plain)[0])))

    def known(texts: list[str | None]) -> list[bool]:
        if not model.value.langs:
            return [any(c.isalpha() for c in t or "") for t in texts]
        return [lang != UNKNOWN for lang, _ in predict(texts, model.value)]

    return keep_rows(docs, text_col, known)
