"""Helpers that the operators share: scratch tables, Arrow slices and word hashes."""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that a Python task works on at a time; a longer text stands alone.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch that goes to a Python task while a table is written: texts are long, and a batch of
#: Spark's 10,000 rows is held by the JVM and by Python, a few times over, in each task.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Tables written on the way to a result (see `concluded`).
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local
    session (as in tests) gets a temporary folder, which it keeps; a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.logweir.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.logweir.scratch", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    held = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(BATCH_LIMIT, held)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def concluded(spark: SparkSession, build: Callable[[], DataFrame], name: str, **options: str) -> DataFrame:
    """What build() returns as a table. Tables that build() has written are deleted then: nothing else may read them."""
    passing: list[str] = []
    outer = _passing.set(passing)
    try:
        df = build()
    finally:
        _passing.reset(outer)
    out = written(df, name, **options)
    for x in passing:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def unused(name: str, columns: list[str]) -> str:
    """The name, or the first of its numbered forms that no column has (in any case of letters)."""
    taken = {x.lower() for x in columns}
    return next(x for x in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def with_id(df: DataFrame, id_col: str, more: str) -> StructType:
    """A schema: the type of df's column as `id`, then the columns that `more` declares."""
    return StructType([StructField("id", df.schema[id_col].dataType), *DataType.fromDDL(more).fields])


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """Shuffle partitions that keep about `each` rows in one, at least as many as the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of the column `text` each, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
        at, done = 0, 0.0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at, done = to, ends[to - 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its bytes and the offsets of its rows; null counts as empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of the hashes.
LENGTH_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Strings of so many bytes are a number of their own; longer ones go to blake2b, so many of them kept.
TINY_BYTES, MAX_DIGESTS = 7, 100_000
_KEPT = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_digests: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, a bijection: every bit of x bears on every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def sorting_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the strings data[start:end], equal for equal strings and fast: of long ones the first and last
    bytes alone. Different strings can have one number, so the bytes decide (`distinct`, `same_bytes`)."""
    wide, length = _by_eight(data), end - start
    out = length.astype(np.uint64) * np.uint64(LENGTH_BASE)
    rows = np.flatnonzero(length > 0)
    at = 0
    while len(rows) and at < 64:
        left = length[rows] - at
        out[rows] = mixed(out[rows] ^ (wide[start[rows] + at] & _KEPT[np.minimum(left, 8)]))
        at += 8
        rows = rows[left > 8]
    if len(rows):
        out[rows] = mixed(out[rows] ^ wide[end[rows] - 8])
    return out


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each string data[start:end] is the string other[other_start:other_end]."""
    wide, other_wide = _by_eight(data), _by_eight(other)
    length = end - start
    same = length == other_end - other_start
    rows = np.flatnonzero(same & (length > 0))
    at = 0
    while len(rows) and at < 64:
        left = length[rows] - at
        equal = ((wide[start[rows] + at] ^ other_wide[other_start[rows] + at]) & _KEPT[np.minimum(left, 8)]) == 0
        same[rows[~equal]] = False
        rows = rows[equal & (left > 8)]
        at += 8
    for r in rows.tolist():
        same[r] = np.array_equal(data[start[r] + at : end[r]], other[other_start[r] + at : other_end[r]])
    return same


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each different string data[start:end], and for each row which of these it is. Exact: rows
    are grouped by a hash and then held against their group's string."""
    _, at, number = np.unique(sorting_hash(data, start, end), return_index=True, return_inverse=True)
    first = at[number]
    more: dict[bytes, int] = {}
    rows = []
    for r in np.flatnonzero(~same_bytes(data, start, end, data, start[first], end[first])).tolist():
        known = len(more)
        number[r] = len(at) + (n := more.setdefault(data[start[r] : end[r]].tobytes(), known))
        if n == known:
            rows.append(r)
    return np.append(at, np.array(rows, at.dtype)), number


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings data[start:end]. Up to TINY_BYTES they are one-to-one (the bytes and their
    number, mixed by a bijection); longer ones are blake2b's, of the different ones once each."""
    length = end - start
    bits = _by_eight(data)[start] & _KEPT[np.minimum(length, 7)] if len(start) else np.zeros(0, np.uint64)
    out = mixed(bits | (np.minimum(length, 7).astype(np.uint64) << np.uint64(56)))
    rows = np.flatnonzero(length > TINY_BYTES)
    if len(rows):
        at, number = distinct(data, start[rows], end[rows])
        if len(_digests) > MAX_DIGESTS:
            _digests.clear()
        raw = data.tobytes()
        found = np.zeros(len(at), np.uint64)
        for i, (a, b) in enumerate(zip(start[rows[at]].tolist(), end[rows[at]].tolist(), strict=True)):
            word = raw[a:b]
            value = _digests.get(word)
            if value is None:
                value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                if b - a <= 64:
                    _digests[word] = value
            found[i] = value
        out[rows] = found[number]
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of many texts: maximal runs of bytes that is_word (256 booleans, on lower-cased
    bytes) holds, none over a row's end. Returns a 64-bit hash, start, end and row for each word;
    equal words have equal hashes in every batch."""
    low = LOWER[data]
    inside = is_word[low]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return hashed(low, start, end), start, end, row


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on (len(word) - k + 1 of them). Different words can be made to
    meet in them, so what is found by them is compared as spelled; `keyed_grams` cannot be aimed at."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = word[:n].copy()
    for j in range(1, k):
        total = total * np.uint64(WORD_BASE) + word[j : j + n]
    return mixed(total)


def new_keys(k: int) -> tuple[int, ...]:
    """Random keys of one job."""
    return tuple(secrets.randbits(64) for _ in range(k))


def keyed_grams(word: np.ndarray, k: int, keys: tuple[int, ...]) -> np.ndarray:
    """As grams, by a chain of mixing steps with keys of the job: who writes a text does not know them."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = mixed((total ^ word[j : j + n]) + np.uint64(keys[j]))
    return total


def crc_mod(column, n: int):
    """crc32 of a value's text, modulo n: a split that any engine can compute."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def sample_below(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at the most, those whose hashed key is lowest; all rows if there are fewer.
    One count, no sort."""
    rows = df.count()
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < F.lit(max(1, 1_000_000 * most // rows)))
