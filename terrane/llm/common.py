"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one grouped Python call is meant to hold.
BLOCK_BYTES = 48 << 20
#: Bytes of one Arrow batch on its way to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20

#: Bytes to blank for words of ASCII letters, digits and everything beyond ASCII,
#: with A-Z lower-cased in the same pass.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: The same for runs between ASCII white space.
TOKEN_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only (a null text is empty), so that other columns cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_type(docs: DataFrame, column: str = "doc_id") -> T.DataType:
    return docs.schema[column].dataType


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t) if isinstance(t, str) else t) for n, t in fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where none is (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and outlives executors.

    Small row groups keep what a writing task holds small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": str(16 << 20), **options}).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by stored(), once all that is computed from them is stored itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have the session cut Arrow batches by bytes, besides rows: rows may be long. A smaller bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark.conf.get(name, str(1 << 30))
    except Exception:  # a Spark without the setting; slices() still bounds what Python makes of a batch
        return
    if now.isdigit() and int(now) > most or now.endswith("b") and int(now[:-1]) > most:
        spark.conf.set(name, str(most))


def slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most about `most` bytes in a string or binary column; a longer row is alone."""
    ends = _offsets(batch.column(column))[1:]
    at, n = 0, batch.num_rows
    while at < n:
        begin = ends[at - 1] if at else _offsets(batch.column(column))[0]
        to = min(n, at + rows, max(at + 1, int(np.searchsorted(ends, begin + most, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give memory that a finished task leaves in a reused Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def map_batches(df: DataFrame, f: Callable, out: T.StructType) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes, after which a worker gives its memory back."""
    bounded_batches(df.sparkSession)

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, out)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 60)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts, counted."""
    return df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def block_count(df: DataFrame, per_block: int = BLOCK_BYTES) -> int:
    """Groups to hash df into so that each holds about per_block bytes of text.

    Parquet holds about a third of its texts' bytes; where Catalyst cannot tell a size, texts are counted.
    """
    size = planned_bytes(df)
    size = 3 * size if size < 1 << 50 else text_bytes(df)
    return max(shuffle_partitions(df.sparkSession), math.ceil(size / per_block), 1)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id as text, the split rule of the held-out sets; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of a stream of word hashes, by start position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = (acc ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def _offsets(strings: pa.Array) -> np.ndarray:
    """Where each value of a string or binary array begins in its data, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    raw = strings.buffers()[1]
    if raw is None or not len(strings):
        return np.zeros(len(strings) + 1, kind)
    return np.frombuffer(raw, kind)[strings.offset : strings.offset + len(strings) + 1]


def string_bytes(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of all values one after another, and where each begins and the last ends. Nulls must be empty."""
    at = _offsets(strings).astype(np.int64)
    data = strings.buffers()[2]
    return memoryview(data)[at[0] : at[-1]] if data is not None else memoryview(b""), at - at[0]


#: Random numbers by byte and odd ones by position, from a fixed seed, for the hashes of words.
_BYTE_KEYS = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64, endpoint=False)


def _position_keys(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def hash_pieces(packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stable 64-bit hashes of pieces, none empty, that lie one after another in bytes.

    A multilinear hash: the sum over a piece's bytes of a number by byte times a number by position, mixed.
    """
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    at = np.arange(len(packed)) - np.repeat(begins, lengths)
    terms = _BYTE_KEYS[packed] * _position_keys(int(lengths.max()))[at]
    return mix64(np.add.reduceat(terms, begins) + lengths.astype(np.uint64))


class Words:
    """The words of a batch of texts.

    hashes: a 64-bit hash of each word; first: where each text's words begin and the last one's end;
    packed, ends: the words' bytes one after another, and where each ends.
    """

    def __init__(self, strings: pa.Array, table: bytes = WORD_TABLE):
        data, at = string_bytes(strings)
        raw = np.frombuffer(bytes(data).translate(table), np.uint8)
        inside = raw != 32
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        starts = at[:-1][at[:-1] < len(raw)]
        begins[starts] = inside[starts]  # a word ends with its text
        stops = at[1:][at[1:] > 0] - 1
        closes[stops] = inside[stops]
        starts = np.flatnonzero(begins)
        lengths = np.flatnonzero(closes) + 1 - starts
        self.packed = raw[inside]
        self.ends = np.cumsum(lengths)
        self.first = np.searchsorted(starts, at)
        self.hashes = hash_pieces(self.packed, lengths)

    def of(self, text: int) -> np.ndarray:
        return self.hashes[self.first[text] : self.first[text + 1]]

    def bytes_of(self, begin: int, end: int) -> bytes:
        """The bytes of some consecutive words, a blank after each."""
        ends = self.ends[begin:end].tolist()
        begins = [int(self.ends[begin - 1]) if begin else 0, *ends[:-1]]
        return b"".join(self.packed[a:b].tobytes() + b" " for a, b in zip(begins, ends))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Words has for these words, none empty."""
    return hash_pieces(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))


def word_hashes(strings: pa.Array, table: bytes = WORD_TABLE, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's begin and the last one's end; worked off in slices."""
    batch = pa.RecordBatch.from_arrays([strings], names=["text"])
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in slices(batch, 0, most):
        words = Words(part.column(0), table)
        parts.append(words.hashes)
        counts.append(np.diff(words.first))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def content_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def batch_of(fields: T.StructType, columns: list) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, target)]
    arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target)]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def batch_table(fields: T.StructType, columns: list) -> pa.Table:
    return pa.Table.from_batches([batch_of(fields, columns)])
