"""Shared plumbing of the corpus operators: shared storage, worker paths, skew-safe joins, text hashing."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A key holding more than 1/HOT_SHARE of all rows is hot; so at most HOT_SHARE keys are, and a broadcast of
#: one row for each is bounded whatever the input's size.
HOT_SHARE = 1024


#: Rows of a batch that goes to Python; texts are long, and Spark's default of 10,000 would make batches of 40 MB of them.
BATCH_ROWS = 2000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, give the session a checkpoint folder, and make batches of texts
    small where the session's configuration leaves their size open."""
    if not spark.sparkContext.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *have])
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session whose executors are
    threads of the driver gets one of our own; any other is refused, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellbasis-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/cellbasis/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(folder: str):
    """Arrow's file system for a folder's URI, and the folder's path in it."""
    import pyarrow.fs as pafs

    scheme, found, rest = folder.partition("://")
    if found and scheme in ("s3a", "s3n"):  # Hadoop's names of what Arrow calls s3
        folder = "s3://" + rest
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished stages hold. Their shuffle files and broadcasts are deleted only once the driver has
    collected its garbage, which in a chain of many jobs may otherwise be never."""
    gc.collect()
    spark._jvm.System.gc()


def clean_up(spark: SparkSession) -> None:
    """Delete every table that `written` has left in the shared folder; no result may be in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cellbasis")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of `left` with `groups`, which has one row a key, safe where one key holds most of the rows.

    `size` is the column of `groups` with the key's number of rows in `left`, `total` their sum. Keys above
    1/HOT_SHARE of the rows (at most HOT_SHARE of them) are broadcast; rows they match, and rows without a key, take a
    join key of their own, made from `spread`, so that the other join never gathers them.
    """
    value_cols = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total))
    hot = hot.select(F.col(key).alias("__hot_key"), F.struct(*value_cols).alias("__hot"))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    cold = cold.select(F.col(key).cast("string").alias("__cold_key"), F.struct(*value_cols).alias("__cold"))
    marked = left.join(F.broadcast(hot), left[key] == F.col("__hot_key"), "left")
    marked = marked.withColumn(
        "__left_key",
        F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(
            F.concat(F.lit("hot:"), F.xxhash64(spread).cast("string"))
        ),
    )
    joined = marked.join(cold, F.col("__left_key") == F.col("__cold_key"), "left")
    picked = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[left[c] for c in left.columns], *[picked[c].alias(c) for c in value_cols])


# ---- vectorised hashing of words -------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche, in place where it can."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POW = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        out = np.full(size, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        _POW[base] = have
    return have


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = [_splitmix(256, 11), _splitmix(256, 977)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a batch of texts: maximal runs of bytes other than space and \\x09-\\x0D of their UTF-8.

    `start`, `end`: byte positions in `data` (all texts, each followed by a space). `first`: for each text the
    index of its first word, with the total at the end. Nothing here loops over words.
    """

    def __init__(self, texts: list, lower: bool):
        raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        self.data = _LOWER[data] if lower else data
        space = _SPACE[self.data]
        edge = np.empty(len(space) + 1, dtype=bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        edge[-1] = not space[-1]
        at = np.flatnonzero(edge)
        self.start, self.end = at[::2], at[1::2]
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: sum over its bytes of a random number for the byte times a power for its place."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        longest = int(size.max())
        power = _powers(_BASES[seed], longest)
        if longest <= 4096:
            # gather the bytes of all words, word by word
            total = int(size.sum())
            offset = np.concatenate([[0], np.cumsum(size)[:-1]])
            place = np.arange(total, dtype=np.int64) - np.repeat(offset, size)
            terms = _BYTE[seed][self.data[np.repeat(self.start, size) + place]] * power[place]
            sums = np.add.reduceat(terms, offset)
        else:
            sums = np.empty(len(size), dtype=np.uint64)
            for i, (a, b) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)):
                sums[i] = (_BYTE[seed][self.data[a:b]] * power[: b - a]).sum(dtype=np.uint64)
        return mix(sums + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def windows(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = _splitmix(k, 31 + 7919 * seed)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j : j + n] * factors[j]
    return mix(out)


def hash_whole(words: np.ndarray, seed: int = 0) -> int:
    """A 64-bit hash of a sequence of word hashes of any length."""
    if not len(words):
        return 0
    return int(mix(np.array([(words * _splitmix(len(words), 31 + 7919 * seed)).sum(dtype=np.uint64) ^ np.uint64(len(words))], dtype=np.uint64))[0])


def chunks(texts: list, limit: int):
    """Consecutive slices (first, last) of `texts` with about `limit` characters each, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def keep_rows(docs: DataFrame, text_col: str, test) -> DataFrame:
    """The rows of `docs`, all columns as they are, for whose texts `test` (list of texts -> list of bool) is true."""
    import pyarrow as pa

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept: list[bool] = []
            for a, b in chunks(texts, 1 << 20):
                kept += test(texts[a:b])
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id, null included, is among the distinct `ids` (one column)."""
    wanted = ids.toDF("__wanted").distinct()
    return docs.join(wanted, docs[id_col].eqNullSafe(wanted["__wanted"]), "left_semi")
