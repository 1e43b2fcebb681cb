"""The corpus operators against brute force on small fixtures."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellbasis.llm import common, decontaminate, exact_dedup, langid, line_dedup, minhash, packing, pii, substring_dedup, urlfilter, warc
from cellbasis.llm.wordautomaton import Automaton

SOUP = "the quick brown fox jumps over a lazy dog while seven grey wolves sing under cold stars and nobody listens to them at all tonight".split()
RNG = np.random.default_rng(11)


def prose(n, seed=0):
    return " ".join(np.random.default_rng(seed).choice(SOUP, n))


def frame(spark, rows, extra=False):
    out = spark.createDataFrame([(None if i is None else int(i), t) for i, t in rows], "doc_id long, text string")
    if extra:  # names that the operators use themselves
        for name in ("digest", "content", "rank", "kept", "keep_id", "rep", "node", "row", "batch", "n", "lines", "size"):
            out = out.withColumn(name, F.lit("clash"))
    return out


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "Word "), (6, "Word "), (None, "word"), (None, None), (7, "one two three four five six"), (8, "ONE two three four five  six"), (9, prose(3000, 5)), (10, prose(3000, 5)), (11, "…—!?")]


def collect(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- exact dedup -----------------------------------------------------------------------------------------


def brute_exact(rows):
    body = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in rows]
    out = []
    for (i, _), b in zip(rows, body, strict=True):
        group = [(j, t or "") for (j, t), c in zip(rows, body, strict=True) if c == b]
        keep = min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0] or 0))[0]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """Also under a digest that clashes for different texts: contents, not digests, decide."""
    digest = (lambda c: F.substring(exact_dedup.sha256_hex(c), 1, 1)) if weak else exact_dedup.sha256_hex
    rows = EDGES + [(100 + k, prose(k % 7, k % 5)) for k in range(60)]
    got = collect(exact_dedup.exact_dedup(frame(spark, rows, True), salts=3, digest=digest), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = brute_exact(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] if weak else got == want


def test_exact_dedup_plan_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark, EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_distinct_only_keeps_columns_and_one_of_repeated_rows(spark):
    docs = frame(spark, EDGES, True)
    out = exact_dedup.distinct_only(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == [3, 4, 6, 7, 8, 9, 11]


# ---- near dedup ------------------------------------------------------------------------------------------


def shingles(text, k=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_near(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common_ = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
            x, y = sorted((root(ids[a]), root(ids[b])))
            parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets, strict=True))


def near_corpus():
    rows, n = [], 0
    for family in range(6):
        words = prose(120, family).split()
        for copy in range(14):
            mine = list(words)
            for at in RNG.integers(0, 120, RNG.integers(0, 5)):
                mine[at] = f"edit{RNG.integers(0, 1000)}"
            rows.append((n, " ".join(mine)))
            n += 1
    shared = prose(60, 99)  # a passage in many otherwise different documents
    for k in range(40):
        rows.append((n, shared + " " + " ".join(f"w{k}x{j}" for j in range(int(RNG.integers(5, 90))))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "short"), (n + 3, "SHORT"), (n + 4, "a b c d"), (n + 5, "a b c d e")]


ROWS_NEAR = near_corpus()


def test_near_dedup_equals_brute_force(spark):
    got = collect(minhash.near_dedup(frame(spark, ROWS_NEAR, True)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_near(ROWS_NEAR), key=repr)


def test_near_dedup_in_crowded_nodes(spark):
    """Leaves of four members and two levels: almost every node ends in blocks, and the result is the same."""
    got = collect(minhash.near_dedup(frame(spark, ROWS_NEAR), levels=2, leaf=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_near(ROWS_NEAR), key=repr)


def test_near_dedup_edges(spark):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, EDGES, True)).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 4, False), (7, 7, True), (8, 7, False), (9, 9, True), (10, 9, False), (11, 11, True)} <= got
    assert minhash.near_dedup(frame(spark, [])).count() == 0
    out = minhash.representatives_only(frame(spark, EDGES[3:7], True))
    assert {r.doc_id for r in out.collect()} == {4}


@pytest.mark.parametrize("dense", [False, True])
def test_linked_pairs_are_exact(dense):
    pool = 40 if dense else 4000
    sets = [np.unique(RNG.integers(0, pool, RNG.integers(0, 60)).astype(np.uint64)) for _ in range(70)]
    got = minhash.linked(sets, 30)
    for a, b in itertools.product(range(70), repeat=2):
        both = len(np.intersect1d(sets[a], sets[b]))
        want = a != b and len(sets[a]) > 0 and len(sets[b]) > 0 and 100 * both >= 30 * (len(sets[a]) + len(sets[b]) - both)
        assert got[a, b] == want


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 200), (200, 150)] + [(400 + k, 300) for k in range(50)] + [(7, 7)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[150] == got[200] == 100 and got[449] == 300
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- words -----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85\xa0é", max_size=12)), max_size=8))
def test_words_are_split_and_hashed_alike(texts):
    words = common.Words(texts, lower=True)
    h = words.hashes()
    want = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    got = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    assert got == want and len(set(h.tolist())) == len(set(want))
    assert np.diff(words.first).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]


# ---- personal data ---------------------------------------------------------------------------------------

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    found = []
    for kind, pattern in _BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                ok = 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            elif kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                found.append((m.start(), list(_BASE).index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1029.@+ -()%é\n", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    got = [s for s in pii.find(text, pii.anchors()) if s[2] in pii.KINDS]
    assert got == brute_pii(text)


SAMPLES = ["mail me: a.b+c@x-y.co.uk.", "4111 1111 1111 1111 and 4111-1111-1111-1112", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8", "+44 (0)20 7946 0958", "a@b.c@d.e", "1" * 5000 + ".2", "@@@@", "", None]


def test_personal_data_rows(spark, sf_dir):
    texts = SAMPLES + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, list(enumerate(texts)), True)).collect()}
    for i, t in enumerate(texts):
        base = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_anchors_add_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, https://me:secret@host/x, joe (at) example (dot) org"
    assert {s[2] for s in pii.find(text, pii.anchors())} >= {"iban", "account", "login", "veiled"}


# ---- lines -----------------------------------------------------------------------------------------------


def brute_lines(rows):
    """All pairs: each later document against the first holder of each of its lines, as the operator states it."""
    key = lambda x: x.strip(" \t\x0b\x0c\r")
    docs = [(i, [] if not t else [key(x) for x in t.split("\n")], t) for i, t in rows]
    out = []
    for i, lines, t in docs:
        gone = set()
        firsts = {min(j for j, other, _ in docs if x in other) for x in lines if x}
        for f in firsts:
            if f < i:
                earlier = min(o for j, o, _ in docs if j == f)
                number = {x: n for n, x in enumerate(dict.fromkeys([*earlier, *lines]), 1) if x}
                gone |= set(line_dedup.align([number.get(x, 0) for x in earlier], [number.get(x, 0) for x in lines]))
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n") if t else []) if n not in gone)
        out.append((i, len(lines), len(gone), kept))
    return sorted(out)


def test_line_dedup(spark):
    rows = []
    for k in range(60):
        lines = [f"line {RNG.integers(0, 40)}" if RNG.random() < 0.6 else f"own {k} {j}" for j in range(int(RNG.integers(0, 12)))]
        rows.append((k, "\n".join(["site header"] * (k % 3 > 0) + lines + [""] * (k % 2))))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, " site header \r\n")]
    got = collect(line_dedup.line_dedup(frame(spark, rows, True)), "doc_id", "n_lines", "n_removed", "kept_text")
    assert got == sorted(brute_lines(rows), key=repr)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    assert line_dedup.line_dedup(frame(spark, EDGES)).count() == len(EDGES)


def brute_all_pairs(rows):
    """Each later document against every document of a smaller id."""
    key = lambda x: x.strip(" \t\x0b\x0c\r")
    docs = [(i, [] if not t else [key(x) for x in t.split("\n")], t) for i, t in rows]
    number = {x: n for n, x in enumerate(dict.fromkeys(x for _, lines, _ in docs for x in lines if x), 1)}
    codes = [(i, [number.get(x, 0) for x in lines], t) for i, lines, t in docs]
    out = []
    for i, lines, t in codes:
        gone = {j for k, other, _ in codes if k < i for j in line_dedup.align(other, lines)}
        out.append((i, len(lines), len(gone), "\n".join(x for n, x in enumerate((t or "").split("\n") if t else []) if n not in gone)))
    return sorted(out)


LINES = {
    "the first holder has the passage twice": ["p\nq\np\nq", "p\nq", "p\nq"],
    "the first holder has another order": ["x\ny", "y\nx", "y\nx"],
    "blank lines that a later pair alone has within a block": ["x\na", "y\nb", "x\n\ny", "x\n\ny\nc"],
    "crossed with several earlier holders": ["x\n1\ny\n2\nz", "z\n3\nx\n4\ny", "y\n5\nx\n6\nz", "z\ny\nx", "7\nz\ny\nx"],
    "a line that is always there twice": ["h\na\nh", "h\nb\nh", "h\nc\nh", "h\nc\nh\nd"],
}


@pytest.mark.parametrize("name", LINES)
def test_line_dedup_of_every_pair(spark, name):
    rows = list(enumerate(LINES[name]))
    got = collect(line_dedup.line_dedup(frame(spark, rows), every_pair=True), "doc_id", "n_lines", "n_removed", "kept_text")
    assert got == brute_all_pairs(rows)


def test_line_dedup_of_every_pair_of_many(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        lines = [f"line {rng.integers(0, 12)}" if rng.random() < 0.5 else "" if rng.random() < 0.3 else f"own {k} {j}" for j in range(int(rng.integers(0, 12)))]
        rows.append((k, "\n".join(lines)))
    rows += [(120, None), (121, ""), (122, "\n\n")]
    got = collect(line_dedup.line_dedup(frame(spark, rows, True), every_pair=True), "doc_id", "n_lines", "n_removed", "kept_text")
    assert got == sorted(brute_all_pairs(rows), key=repr) != sorted(brute_lines(rows), key=repr)
    assert line_dedup.line_dedup(frame(spark, []), every_pair=True).count() == 0
    assert line_dedup.line_dedup(frame(spark, EDGES), every_pair=True).count() == len(EDGES)


def test_line_dedup_of_every_pair_in_many_rounds(spark, monkeypatch):
    """Lines in another order in most documents, so that holders are asked round after round, in many shares."""
    for name, value in (("SLICE", 1), ("WIDER", 2), ("DEALT", 2)):
        monkeypatch.setattr(line_dedup, name, value)
    rounds = []
    asked = line_dedup._asked
    monkeypatch.setattr(line_dedup, "_asked", lambda *a: rounds.append(a[2:]) or asked(*a))
    rng = np.random.default_rng(20)
    rows = []
    for k in range(70):
        lines = [f"line {x}" for x in rng.permutation(5)[: rng.integers(1, 5)]] + ["twice"] * int(rng.integers(0, 3)) + ([""] if k % 3 else [])
        rows.append((k, "\n".join([lines[x] for x in rng.permutation(len(lines))] + [f"own {k}"])))
    got = collect(line_dedup.line_dedup(frame(spark, rows, True), every_pair=True), "doc_id", "n_lines", "n_removed", "kept_text")
    assert got == sorted(brute_all_pairs(rows), key=repr)
    assert rounds[:3] == [(0, 1), (1, 2), (2, 4)]


def test_registered_line_dedup_is_of_every_pair(spark, sf_dir):
    from cellbasis.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = collect(queries.op4_line_dedup(spark, sf_dir), "doc_id", "n_removed")
    assert got == sorted(((i, n) for i, _, n, _ in brute_all_pairs(rows)), key=repr)


def test_alignment():
    assert line_dedup.align([1, 2, 3, 4], [9, 2, 3, 8]) == [1, 2]
    assert line_dedup.align([1, 2], [2, 1]) in ([0], [1])  # out of order: one of them
    assert line_dedup.align([1, 5, 5, 2], [1, 5, 5, 2]) == [0, 1, 2, 3]  # repeated lines go with the block
    assert line_dedup.align([1, 0, 2], [1, 0, 2]) == [0, 1, 2] and line_dedup.align([1, 0], [1, 0]) == [0]
    assert line_dedup.align([], [1]) == [] and line_dedup.align([0], [0]) == []


# ---- decontamination -------------------------------------------------------------------------------------


def brute_leaks(docs, items, w=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    wins = {}
    for i, t in items:
        words = split(t)
        for k in range(max(1, len(words) - w + 1) if words else 0):
            wins.setdefault(tuple(words[k : k + w]), set()).add(str(i))
    out = []
    for d, t in docs:
        words, hit, ids = split(t), set(), set()
        for win, who in wins.items():
            for k in range(len(words) - len(win) + 1):
                if tuple(words[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= who
        out.append((d, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(0, prose(25, 1)), (1, prose(12, 2)), (2, "tiny item"), (3, None), (4, "?!"), (10, prose(25, 1)), (5, "Ünïcode wörds Ünïcode")]
LEAKY = EDGES + [(20, "xx " + prose(25, 1).upper().replace(" ", " -- ") + " yy"), (21, " ".join(prose(25, 1).split()[3:13])), (22, " ".join(prose(25, 1).split()[3:12])), (23, "a tiny, ITEM tiny item"), (24, "Ünïcode wörds Ünïcode")]


@pytest.mark.parametrize("limit", [decontaminate.MAX_ITEM_BYTES, 150])
def test_decontamination(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, LEAKY, True), items, max_item_bytes=limit)
    assert collect(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_leaks(LEAKY, ITEMS)
    clean = decontaminate.clean_only(frame(spark, LEAKY, True), items, max_item_bytes=limit)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((b[0] for b in brute_leaks(LEAKY, ITEMS) if not b[5]), key=repr)


def brute_windows(items, text, window):
    out = set()
    for item, words in items:
        n = min(window, len(words))
        out |= {(j, n, item) for k in range(len(words) - n + 1) for j in range(len(text) - n + 1) if n and text[j : j + n] == words[k : k + n]}
    return out


def test_word_automaton_finds_every_occurrence():
    rng = np.random.default_rng(11)
    for _ in range(150):
        window, kinds = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        draw = lambda n, more=0: [b"%d" % v for v in rng.integers(0, kinds + more, n)]  # noqa: B023, E731
        items = [(str(rng.integers(4)), draw(rng.integers(10))) for _ in range(rng.integers(6))]
        automaton = Automaton(items, window)
        texts = [draw(n, int(rng.integers(2))) for n in (0, 3, 400)]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        first, size, code = automaton.scan(np.array([n for t in texts for n in [*automaton.numbered(t), -1]], dtype=np.int32))
        got = [set() for _ in texts]
        for a, n, c in zip(first.tolist(), size.tolist(), code.tolist(), strict=True):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            got[k] |= {(a - int(starts[k]), n, i) for i in automaton.items_of(c)}
        assert got == [brute_windows(items, t, window) for t in texts]


def test_large_benchmarks_take_one_pass(spark):
    """5 MB of items in several automata: every planted window is found, the corpus is read once and nothing of it is shuffled."""
    rng = np.random.default_rng(12)
    vocabulary = np.array([f"w{i}" for i in range(30_000)])
    items = [(i, " ".join(rng.choice(vocabulary, 900))) for i in range(1000)]
    assert sum(len(t) for _, t in items) > 5e6
    docs = [(i, " ".join([*rng.choice(vocabulary, 50), *(items[i * 37 % 1000][1].split()[5:20] if i % 3 == 0 else [])])) for i in range(60)]
    table = pd.DataFrame(items, columns=["item_id", "text"])
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(table), max_item_bytes=2 << 20)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.n_hit, r.n_items) for r in got.collect()} == {(i, 15 if i % 3 == 0 else 0, int(i % 3 == 0)) for i, _ in docs}


def test_decontamination_spans_and_empty_sides(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    text = "say: Tiny, item! ok"
    r = decontaminate.decontaminate(frame(spark, [(1, text)]), items).first()
    a, b = map(int, r.spans.split(":"))
    assert text[a:b] == "Tiny, item"
    assert decontaminate.decontaminate(frame(spark, LEAKY), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark, []), items).count() == 0


def test_near_dedup_recall_through_deep_trees(spark):
    """Leaves of four sets, so that nearly all pairs must be kept together by branches: links found against all links there are."""
    rng = np.random.default_rng(17)
    words = [f"v{k}" for k in range(400)]
    rows = []
    for family in range(60):
        base = rng.choice(words, 90)
        for _ in range(6):
            text = base.copy()
            at = int(rng.integers(0, 85))
            text[at : at + int(rng.integers(0, 4))] = "x" + str(int(rng.integers(1 << 30)))
            rows.append((len(rows), " ".join(text)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(86)} for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(frame(spark, rows), leaf=4).collect()}
    kept = sum(got[a] == got[b] for a, b in linked)
    assert len(linked) > 500 and kept >= 0.99 * len(linked)
    assert minhash.depth(1000, 1024) == minhash.LEVELS and minhash.depth(10**10, 1024) == 12


# ---- WARC ------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big, uni = "x" * 150, "é\r\n\r\n" * 60
    rows = [(1, "http://a.org/x", big), (2, "https://b.org:8080/?q=1", big), (3, None, None), (4, "odd\nurl\t", ""), (5, "http://a.org/x", uni), (6, "http://A.org/x", "small"), (7, "http://c.org", "small"), (8, "http://a.org/x", big), (8, "http://a.org/x", big), (None, "http://n.org", big)]
    got = collect(warc.round_trip(pages(spark, rows).withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = min(same) if same else None
        again = len(data) >= 100 and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_look_up_by_url(spark):
    rows = [(k, f"http://h{k % 7}.example.org/{k % 50}", f"page {k}") for k in range(1500)] + [(5000 + k, "http://hot.org/", "hot") for k in range(1200)]
    archive = warc.write_archive(pages(spark, rows))
    reader = warc.Reader(archive.folder, archive.shards)
    for url in ("http://h3.example.org/3", "http://hot.org/", "http://none.org/"):
        hits = reader.of_url(url)
        assert sorted(h[0] for h in hits) == sorted(i for i, u, _ in rows if u == url)
        for page, name, start, length in hits[:3]:
            fields, _, payload = reader.read(name, start, length)
            assert fields["WARC-Target-URI"] == url and payload.decode() == next(h for i, _, h in rows if i == page)


def test_surt():
    assert warc.surt("http://www.a.org:80/x?y#z") == "org,a,www:80)/x?y#z" and warc.surt(None) == "" and warc.surt("a.b/c") == "b,a)/c"


# ---- language --------------------------------------------------------------------------------------------


def test_suffix_automaton_holds_all_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    step, _ = langid.suffix_automaton(text)

    def has(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    inside = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    for n in range(1, 5):
        for s in itertools.product((1, 2, 3), repeat=n):
            assert has(s) == (s in inside)


def test_phrases_are_greedy_longest_matches():
    samples = {"x": ["abracadabra banana"], "y": ["zebu quokka lemur"]}
    model = langid.train(samples)
    texts = ["abra cadabra zebu!", "", "banana  lemur qqq " * 40, "ñandú 123"]
    got, sizes, _ = langid.phrases(texts, model)
    for lang in range(2):
        sample = langid._symbols(" " + list(samples.values())[lang][0] + " ", model.codes).tolist()
        for i, t in enumerate(texts):
            s = langid._symbols(t, model.codes).tolist()
            count = at = 0
            while at < len(s):  # through the whole text
                n = 0
                while at + n < len(s) and any(sample[k : k + n + 1] == s[at : at + n + 1] for k in range(len(sample))):
                    n += 1
                at += max(n, 1)
                count += 1
            assert got[i, lang] == count


def test_long_texts_are_one_parse():
    """Segments are joined: the phrases of texts of 10,000 letters and more are those of one walk, also where none of a
    segment's own phrases begins where the whole text's do."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    model = langid.train({"x": [text(200) for _ in range(20)], "y": ["abab" * 500, "z" * 900]})
    texts = [text(3000), "", "z" * 2000, "ab" * 6000, text(5), text(200) + " 5 ñ q " * 300]
    got, sizes, _ = langid.phrases(texts, model)
    assert sizes[0] > 10_000
    for k, table in enumerate(model.tables):
        for i, t in enumerate(texts):
            state = count = 0
            for c in model.local[k][langid._symbols(t, model.codes)].tolist():
                found = int(table[state + c])
                if state == 0 or found >> 32 != state:
                    count, found = count + 1, int(table[c])
                state = found & langid._LOW
            assert got[i, k] == count


def _letters(first, n, step=1):
    return [c for c in map(chr, range(first, first + 4 * n * step, step)) if c.isalpha() and c == c.lower()][:n]


def _invented(letters, seed, n=60):
    """Texts of words that are drawn from a fixed vocabulary over `letters`."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(letters, rng.integers(2, 5))) for _ in range(80)]
    return [" ".join(rng.choice(words, 40)) for _ in range(n)]


def test_han_kana_and_hangul_are_told_apart():
    texts = {"zh": "我们今天在学校学习中文然后回家吃饭", "ja": "わたしたちはきょう学校で日本語を勉強します", "ko": "우리는 오늘 학교에서 한국어를 공부합니다"}
    model = langid.train({k: [v] for k, v in texts.items()})
    told = langid.predict(["今天我们回家学习", "きょうわたしたちは勉強します", "오늘 우리는 공부합니다"], model)
    assert [x for x, _ in told] == ["zh", "ja", "ko"] and min(s for _, s in told) > 0.2


def test_languages_of_many_scripts_and_one_script():
    starts = {"la": 0x61, "el": 0x3B1, "ru": 0x430, "hy": 0x561, "he": 0x5D0, "ar": 0x620, "hi": 0x905, "bn": 0x985, "ta": 0xB85, "th": 0xE01, "ka": 0x10D0, "am": 0x1200, "ko": 0xAC00, "goth": 0x10330}
    alphabets = {k: _letters(v, 44) for k, v in starts.items()} | {"zh": _letters(0x4E00, 3000)}
    samples = {f"{k}{v}": _invented(letters, 2 * n + v) for n, (k, letters) in enumerate(alphabets.items()) for v in range(2)}
    model = langid.train({k: v[:40] for k, v in samples.items()})
    used = {c for v in samples.values() for t in v[:40] for c in t if c.isalpha()}
    assert len({int(model.codes[ord(c)]) for c in used}) == len(used) > 396
    for lang, texts in samples.items():  # two languages share each script, and differ in their words
        assert {x for x, _ in langid.predict(texts[40:], model)} == {lang}


def test_all_drawn_documents_are_learnt_from(spark):
    sizes = [0, 3, 10, 50, 51, 200]
    parts = [np.append(np.arange(1, n), 0) if n else np.zeros(0, dtype=int) for n in sizes]
    for limit in (0, 4, 40, 113, 160, 313, 314, 1000):
        got = [len(p) for p in langid._even(parts, limit)]
        assert sum(got) == min(limit, sum(sizes)) and all(p[-1] == 0 for p in langid._even(parts, limit))
    assert sorted(len(p) for p in langid._even(parts, 113)) == [3, 10, 33, 33, 34]
    # texts of large ids have words of their own
    old, new = _letters(0x61, 13), _letters(0x6E, 13)
    model = langid.train({"x": _invented(old, 1, 200) + _invented(new, 2, 200), "y": _invented(old, 3, 200) + _invented(new, 4, 200)}, 10_000)
    for seed, lang in ((2, "x"), (4, "y")):
        assert {k for k, _ in langid.predict(_invented(new, seed, 230)[200:], model)} == {lang}
        assert np.mean([s for _, s in langid.predict(_invented(new, seed, 230)[200:], model)]) > 0.3


def test_labels_beyond_one_pass(spark):
    rows = [(100 * n + k, text, f"l{n:02}") for n in range(70) for k, text in enumerate(_invented(_letters(0x61, 26), n, 6))]
    rows += [(9000, None, None), (9001, "1 2", "l00"), (None, rows[0][1], None), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = collect(langid.identify(docs), "doc_id", "held_out", "lang_pred", "score")
    assert told == collect(langid.identify(docs, a_pass=80), "doc_id", "held_out", "lang_pred", "score")
    label = {i: lang for i, _, lang in rows[:420]}
    assert len(told) == len(rows) and all(lang == label[i] for i, held, lang, _ in told if i in label and not held)
    assert np.mean([lang == label[i] for i, held, lang, _ in told if i in label and held]) > 0.9  # some labels have one row to learn from
    assert langid.known_only(docs).count() == 422


def test_texts_with_letters_stay_where_nothing_can_be_learnt(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    for lang, labelled in ((None, "the end"), ("en", "the end"), ("en", "12 34")):
        rows = spark.createDataFrame([(held, "the end", lang), (1000, "und der", None), (1001, None, None), (1002, "1 2 !", None), (1003, labelled, None)], "doc_id long, text string, lang string")
        stay = {held, 1000} | ({1003} if labelled == "the end" else set())
        assert {r.doc_id for r in langid.known_only(rows).collect()} == stay
        assert {r.lang_pred for r in langid.identify(rows).collect()} == {"und"}
    unlettered = spark.createDataFrame([(i, "12 34", "en") for i in range(9)] + [(1000, "und der", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.known_only(unlettered).collect()} == {1000}


def test_sparse_tables_hold_the_transitions():
    step, _ = langid.suffix_automaton([0, 1, 2, 1, 1, 2, 3, 1, 2, 0])
    table = langid.sparse_table(step, 6)
    state, todo = {0: 0}, [0]
    while todo:
        s = todo.pop()
        for c in range(6):
            found = int(table[state[s] + c])
            assert (found >> 32 == state[s]) == (c in step[s] or s == 0)
            if c in step[s] and step[s][c] not in state:
                state[step[s][c]] = found & 0xFFFFFFFF
                todo.append(step[s][c])
            assert c not in step[s] or state[step[s][c]] == found & 0xFFFFFFFF
    assert len(set(state.values())) == len(step)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert set(got.doc_id) == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert langid.identify(docs).select("lang_pred").exceptAll(langid.identify(docs.withColumn("source", F.lit("x"))).select("lang_pred")).count() == 0


def test_language_edges(spark):
    rows = spark.createDataFrame([(2, "the end of the day", "en"), (1, None, "en"), (3, "", None), (4, "123 !", None), (5, "der und die das", "de"), (None, "und der", None)], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(rows).collect()}
    assert {(1, "und"), (3, "und"), (4, "und")} <= got
    none = langid.identify(rows.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(rows.limit(0)).count() == 0
    assert langid.known_only(rows.withColumn("score", F.lit(1))).columns == ["doc_id", "text", "lang", "score"]


# ---- substrings ------------------------------------------------------------------------------------------


def brute_substrings(rows, w=13):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    rank = lambda i: substring_dedup.NULL_ID if i is None else i
    for i, words in docs:
        for k in range(len(words) - w + 1):
            key = tuple(words[k : k + w])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - w + 1):
            if first[tuple(words[k : k + w])] < rank(i):
                gone |= set(range(k, k + w))
        kept = [x for k, x in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, a_round", [(substring_dedup.BLOCK_BYTES, 1 << 14), (2000, 1 << 14), (2000, 3)])
def test_substring_dedup(spark, size, a_round):
    passage, other = prose(40, 3).split(), prose(30, 4).split()
    rows = EDGES + [(100, " ".join(passage))]
    for k in range(40):
        own = [f"w{k}_{j}" for j in range(20)]
        cut_ = int(RNG.integers(5, 40))
        rows.append((101 + k, " ".join(own[:7] + passage[:cut_] + (other[: int(RNG.integers(8, 20))] if k % 2 else []) + passage[cut_ - 5 :] + own[7:])))
    got = collect(substring_dedup.substring_dedup(frame(spark, rows, True), block_bytes=size, batch_bytes=size, blocks_a_round=a_round), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_groups_of_substring_dedup_do_not_grow():
    """The text that stands behind a group of any stage, from 30 GB to 100 TB."""
    for total in (30 << 30, 3 << 40, 100 << 40):
        blocks, batches, wide, slices = substring_dedup.plan(total, substring_dedup.BLOCK_BYTES, substring_dedup.BATCH_BYTES, substring_dedup.BLOCKS_A_ROUND)
        supers = -(-blocks // wide)
        assert total / batches <= substring_dedup.BATCH_BYTES and total / blocks <= substring_dedup.BLOCK_BYTES
        assert total / (supers * slices) <= 2 * substring_dedup.BLOCK_BYTES  # of a slice in a super-block
        assert (wide > 1) == (blocks > substring_dedup.BLOCKS_A_ROUND) and supers <= substring_dedup.BLOCKS_A_ROUND
        assert slices <= substring_dedup.BLOCKS_A_ROUND  # entries of one seed that reach its block


def test_factors_are_copies_of_one_place():
    """A factor ends where the earlier document's next seed is not the next one here."""
    none = substring_dedup.NULL_ID
    docs, places = np.array([5, 5, 5, 5, 2, none, 5]), np.array([10, 11, 30, 31, 9, 0, 32])
    assert substring_dedup.factors(docs, places, 9, 13) == [(0, 14, 5), (2, 16, 5), (4, 17, 2), (6, 19, 5)]
    assert substring_dedup.factors(docs, places, 2, 13) == []


# ---- packing ---------------------------------------------------------------------------------------------


def unpack(rows, table, capacity):
    from collections import defaultdict

    spans = defaultdict(list)
    for length, number, n, sequence, offset in table.tolist():
        for k in range(n):
            spans[sequence + k].append((offset, length))
    seen = defaultdict(int)
    for some in spans.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
            seen[length] += 1
        assert at <= capacity
    assert dict(seen) == {k: v for k, v in rows.items() if v}
    return len(spans)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 12), max_size=12))
def test_plan_packs_everything_without_gaps(counts):
    used = unpack(counts, packing.plan(counts, 30), 30)
    total = sum(k * v for k, v in counts.items())
    least = max(-(-total // 30), sum(v for k, v in counts.items() if k > 15))
    assert least <= used <= least * 3 // 2 + 1


def test_large_items_pair():
    assert unpack({20: 3, 10: 3}, packing.plan({20: 3, 10: 3}, 30), 30) == 3
    assert unpack({11: 4}, packing.plan({11: 4}, 30), 30) == 2


def test_pieces_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = EDGES + [(50, "a<|endoftext|>b"), (51, "日本語 x\x1cy"), (52, prose(40, 8)), (53, "it's  \n\n we'll   go  ")]
    got = packing.pack(frame(spark, rows, True), capacity=64).toPandas()
    want = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 64)):
            want.append((i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, pd.DataFrame(want, columns=cols).astype({"doc_id": "Int64"}).itertuples(index=False))) == sorted(map(repr, got[cols].astype({"doc_id": "Int64"}).itertuples(index=False)))
    for _, some in got.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert some.offset.tolist() == [0, *some.length.cumsum().tolist()[:-1]] and some.length.sum() <= 64
    assert packing.pack(frame(spark, [])).count() == 0


def test_cut():
    assert packing.cut(64, 64) == [(0, 64)] and packing.cut(65, 64) == [(0, 1), (1, 64)] and packing.cut(1, 64) == [(0, 1)]
    assert packing.cut(150, 64) == [(0, 22), (22, 64), (86, 64)]


# ---- URLs ------------------------------------------------------------------------------------------------


def test_hosts_paths_and_rules():
    assert urlfilter.split("HTTP://A.Example.NET/En/x?y#z") == ("a.example.net", "/En/x")
    assert urlfilter.split("x://h#f/") == ("h", "") and urlfilter.split(None) == ("", "") and urlfilter.split("no scheme") == ("", "")
    known = urlfilter.Rules(urlfilter.RULES)
    rule = lambda u: known.match(*urlfilter.split(u))
    assert rule("http://a.example.net/x") == "net/" and rule("http://example.net/en/1") == "example.net/en/"
    assert rule("http://notexample.com/de/") is None and rule("http://s.example.com/de/x") == "example.com/de/"
    assert rule("http://a.org/fr/1") == "org/fr/" and rule("http://a.org/fr") is None and rule("http://x.net") is None


def test_url_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "plain")], "page_id long, url string")
    got = urlfilter.filter_urls(docs.select("page_id", "url").unionByName(extra).withColumn("host", F.lit("clash"))).collect()
    assert len(got) == docs.count() + 3
    for r in got:
        assert r.verdict in ("allow", "block") and 0 <= r.score <= 1
        if r.rule:
            assert r.verdict == urlfilter.RULES[r.rule]
    again = urlfilter.filter_urls(docs).orderBy("page_id").collect()
    assert again == urlfilter.filter_urls(docs.repartition(5)).orderBy("page_id").collect()
    assert urlfilter.filter_urls(docs.limit(0)).count() == 0


def brute_rule(host, path, rules):
    fit = []
    for rule in rules:
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        if ("." + host).endswith("." + h) and path[: len(p)] == p:
            fit.append(rule)
    return max(fit, key=lambda r: (len(r), r), default=None)


def test_url_rules_over_the_whole_table(spark):
    """Host, path, rule and the rules' verdicts of every page against a statement of the contract of its own."""
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = ["https://EXAMPLE.net/en/a", "https://a.example.net/en", "https://notexample.net/en/", "https://x.org/fr/?a#b", "https://org/fr/", "ftp://example.com/de/#x", "https://example.com?/de/", "https://net", "://net/", "https://net./", "https://Ä.NET/x"]
    extra = [(10_000 + i, u) for i, u in enumerate(odd)] + [(10_000, odd[0])] * 3
    got = urlfilter.filter_urls(pages.unionByName(spark.createDataFrame(extra, "page_id long, url string"))).select("page_id", "host", "path", "rule", "verdict").collect()
    want = []
    for page, url in [*map(tuple, pages.collect()), *extra]:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda x: chr(ord(x.group()) + 32), m.group(1)) if m else ""
        path = m.group(2) if m else ""
        rule = brute_rule(host, path, rules)
        want.append((page, host, path, rule, rules.get(rule)))
    assert len(got) == len(want)
    assert sorted((*map(repr, r[:4]), r[4]) for r in got if r[3]) == sorted((*map(repr, w[:4]), w[4]) for w in want if w[3])
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, (w[:4] for w in want)))
    assert {r[4] for r in got} <= {"allow", "block"} and len({r for r in got if r[0] == 10_000}) == 1


def test_url_rules_that_tie_and_long_urls(spark):
    rules = {"a.b/": "allow", "b/xx": "block", "b/x": "allow", "c.a.b/": "block", "b/y/": "block"}
    known = urlfilter.Rules(rules)
    hosts = ["b", "a.b", "c.a.b", "d.c.a.b", ".b", "b.", "", "x.y.z.b", "ab", "a.b.c"]
    for h in hosts:
        for p in ["", "/", "/x", "/xx", "/xxx", "/y", "/y/z"]:
            assert known.match(h, p) == brute_rule(h, p, rules)
    long = "http://" + "a." * 300_000 + "net/" + "x" * 1_000_000 + "?" + "k=v&" * 100_000
    got = urlfilter.filter_urls(spark.createDataFrame([(1, long), (2, long)], "page_id long, url string")).collect()
    assert [(r.rule, r.verdict, len(r.path)) for r in got] == [("net/", "block", 1_000_001)] * 2


def test_url_sample_is_bounded_and_the_same(spark):
    many = spark.range(5000).select((F.col("id") % 4000).alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 4000, F.lit(".net/"), F.col("id") % 4000).alias("url"))
    drawn = urlfilter.sample(many, urlfilter.RULES, 300)
    assert len(drawn) == len(set(drawn)) == 300 and drawn == urlfilter.sample(many.repartition(7), urlfilter.RULES, 300)


def test_trees_learn():
    x = RNG.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = urlfilter.boost(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) >= 0.5) == (y[1500:] == 1)).mean() > 0.95
    assert (urlfilter.boost(x[:0], y[:0]).score(x) < 0.5).all()


# ---- shared plumbing -------------------------------------------------------------------------------------


def test_attach_serves_hot_and_cold_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("k"))
    groups = spark.createDataFrame([("hot", 1, 2500), ("1", 2, 1), ("none", 3, 1)], "k string, v int, n long")
    got = common.attach(left, groups, "k", "n", 5000, F.col("id"))
    assert got.count() == 5000 and got.where("v = 1").count() == 2500 and got.where("v = 2").count() == 1 and got.where("v is null").count() == 2499
