"""What the operators of this folder share: reading, the shared folder, and words of byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.session import checkpoint_dir

CHUNK_BYTES = 1 << 20  # text that one numpy pass works on; a longer text is a chunk of its own
SMALL_CHUNK = 1 << 18  # where a pass has many arrays of the size of its text, which a worker keeps the memory of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    Shuffle files of the write are removed when it is done, as nothing reads them again. With ``batch_bytes`` Python
    gets rows in batches of about that size, not only of so many rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def rows_or_empty(df: DataFrame, schema: str) -> DataFrame:
    """``df`` cast to the columns of ``schema``, in its order; columns it lacks are null."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def fresh(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of a string array, cut between rows at about ``limit`` bytes.

    ``offsets`` has one entry more than there are rows and starts at 0. Null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if n == 0:
        return
    column = column.cast(pa.large_binary())
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint8)
    upper = (codes >= 0x41) & (codes <= 0x5A)
    lower = np.where(upper, codes + 32, codes).astype(np.uint8)
    is_word = (codes >= 0x80) | ((codes >= 0x30) & (codes <= 0x39)) | ((codes >= 0x61) & (codes <= 0x7A)) | upper
    return lower, is_word


LOWER, IS_WORD = _word_tables()
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = {"n": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``BASE ** i`` modulo 2**64 for ``i < n``, or of the inverse."""
    key, base = ("inverse", BASE_INVERSE) if inverse else ("n", BASE)
    if len(_POWERS[key]) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        _POWERS[key] = np.multiply.accumulate(full)
    return _POWERS[key][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    at_front = (sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts]
    return mixed(at_front ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one entry more than texts)."""
    mask = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False  # words end with their text
    after[inner - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries; those that cross texts are the caller's to drop."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= BASE
        out += hashes[k : k + n]
    return mixed(out ^ np.uint64(size))


def window_ok(first: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """For each window start, whether the window stays in its text."""
    n = n_words - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    text_of = np.zeros(n_words, np.int64)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    return text_of[:n] == text_of[size - 1 :]
