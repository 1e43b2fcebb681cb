"""Very long texts, one very long word and one very long line go through every operator whole."""

import hashlib
import zlib

import numpy as np
import pytest

from cellbasis.llm import decontaminate, exact_dedup, langid, line_dedup, minhash, packing, pii, substring_dedup, warc

WORDS = [f"word{i % 5003}x{i % 7}" for i in range(120_000)]
LONG = " ".join(WORDS)
ONE_WORD = "ab" * 150_000
ROWS = [(1, LONG), (2, LONG + " tail"), (3, ONE_WORD), (4, ONE_WORD + " x"), (5, "\n".join(WORDS[:30_000])), (6, "\n".join(WORDS[:30_000])), (7, "mail a@b.co " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").cache()


def test_exact(docs):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[5] == (5, 2) and got[6] == (5, 2) and got[1] == (1, 1)


def test_near(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(docs).collect()}
    assert got[1][0] == len({tuple(WORDS[i : i + 5]) for i in range(len(WORDS) - 4)}) and got[2][1] == got[5][1] == got[6][1] == 1 and got[3] == (1, 3) and got[4] == (1, 4)


def test_personal_data(docs):
    got = {r.doc_id: r.n_email for r in pii.find_personal_data(docs).collect()}
    assert got[7] == 20_000 and got[1] == 0


def test_lines(docs):
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got[5] == (30_000, 0) and got[1] == (1, 0) and got[6][0] == 30_000 and got[6][1] > 0


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[119_000:119_020]))], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, items).collect()}
    assert got[1] and got[2] and not got[3]


def test_language(spark, docs):
    from pyspark.sql import functions as F

    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 5, "en").otherwise("de"))
    assert langid.identify(labelled).count() == len(ROWS)


def test_substrings(docs):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert got[2].n_removed == len(WORDS) and got[2].kept_sha256 == hashlib.sha256(b"tail").hexdigest() and got[1].n_removed == 0
    assert got[5].n_removed == 30_000 and got[3].n_words == 1


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.pack(docs).toPandas()
    ids = np.array(Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode(LONG, add_special_tokens=False).ids + [0], dtype="<u4")
    mine = got[got.doc_id == 1].sort_values("piece")
    assert mine.length.sum() == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))


def test_warc(spark):
    rows = [(1, "http://a.org/" + "x" * 5000, LONG), (2, "http://b.org/", LONG)]
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (len(LONG), "response"), 2: (len(LONG), "revisit")}
