"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Rows are first deduplicated where they lie (map-side partial aggregation under a salt that is the partition's
own number), then merged in salted digest groups, then the salts' winners are combined globally. Each stage
groups by the digest *and the full normalised content*, so a digest collision never merges different texts.
A hot text therefore reaches each later stage as at most one row for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import attach, keep_ids, ready, written

#: Characters that equality ignores: \x20 and \x09-\x0D.
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

SALTS = 32
_ID_SPAN = 1 << 65  # room for every 64-bit id and for null


def normalised(text: Column) -> Column:
    """`text` (null: empty) without the characters that equality ignores."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _big(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _rank(text: Column, doc_id: Column) -> Column:
    """A decimal that orders rows: more code points first, then the smaller id, null ids last. One fixed-width
    number keeps the aggregate a hash aggregate; the greatest of structs would sort whole texts."""
    chars = F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("decimal(38,0)")
    place = F.coalesce(_big(1 << 63) - doc_id.cast("decimal(38,0)"), _big(0))
    return (chars * _big(_ID_SPAN)).cast("decimal(38,0)") + place.cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    place = F.pmod(rank.cast("decimal(38,0)"), _big(_ID_SPAN))
    return F.when(place > 0, (_big(1 << 63) - place).cast("long"))


def sha256_hex(content: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 of `content`."""
    return F.sha2(content.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting \\x20 and \\x09-\\x0D. Of equal texts the row with the most code
    points of original text stays, then the one with the smallest id.

    Null text counts as empty, so null, empty and blank texts are one group. A null id ranks behind every id
    and such a row stays only where its whole group has null ids. Rows repeated with the same id are counted
    in group_size and share the fate of that id. An empty table gives an empty result. Other columns of
    `docs`, whatever their names, are ignored.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = plain.select("doc_id", normalised(F.col("text")).alias("content"), _rank(F.col("text"), F.col("doc_id")).alias("rank"))
    keyed = keyed.withColumn("digest", digest(F.col("content")))
    local = (
        keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    )
    winners = local.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))
    groups = written(winners.select("digest", _id_of(F.col("rank")).alias("keep_id"), F.col("size").alias("group_size")), "exact-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    clashes = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    clashing = bool(clashes.take(1))
    if clashing:
        groups = groups.join(clashes, "digest", "left_anti")
    rows = keyed.select("doc_id", "digest") if not clashing else keyed.join(clashes, "digest", "left_anti").select("doc_id", "digest")
    # groups of one row need no join: the row keeps itself
    out = attach(rows, groups.where("group_size > 1"), "digest", "group_size", total, F.col("doc_id"))
    if clashing:
        apart = keyed.join(clashes, "digest", "left_semi")
        again = apart.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size"))
        again = again.select("digest", "content", _id_of(F.col("rank")).alias("keep_id"), "group_size")
        out = out.unionByName(apart.select("doc_id", "digest", "content").join(again, ["digest", "content"]).drop("content"))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def distinct_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; rows that repeat an id and its text are one document."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select("doc_id")
    stay = keep_ids(docs, id_col, kept).withColumn("__digest", sha256_hex(normalised(F.col(text_col))))
    return stay.dropDuplicates([id_col, "__digest"]).select(*docs.columns)


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(body) AS text_sha256
FROM k
"""
