"""Token ids as Parquet list columns.

Rows are range-partitioned by doc_id, encoded in order and written with
dictionary pages (delta pages where a dictionary grows too large), bounded row
groups, small pages and their indexes. Readers may fetch doc_id and n_tokens
without touching ids, or the ids of a range of documents.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import batch_of, block_count, id_type, map_batches, schema, shared_dir, slices, texts
from terrane.llm.token_encode import encoder

WRITER = {
    "compression": "snappy",
    "parquet.writer.version": "v2",  # ids that outgrow the dictionary are delta-packed
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


#: Files whose first positions, 12 bytes each, are broadcast when reading.
BROADCAST_PARTS = 200_000


def write_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Write doc_id, part, part_start, n_tokens and ids of all documents, ascending by doc_id (nulls first).

    A null text is empty and holds the end id only. Rows that share a doc_id
    follow one another by a hash of their text; an empty table gives a table
    without rows.
    """
    out = schema(("doc_id", id_type(docs)), ("part", "int"), ("part_start", "long"), ("n_tokens", "int"), ("ids", "array<int>"))

    def encode(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path, end_id)
        for batch in batches:
            for rows in slices(batch, 1):
                ids, n = enc(rows.column(1))
                stops = np.concatenate([[0], np.cumsum(n)])
                yield batch_of(out, [
                    rows.column(0), np.full(len(n), part, np.int32), start + stops[:-1], n.astype(np.int32),
                    pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids)),
                ])
                start += int(stops[-1])

    order = texts(docs).withColumn("tie", F.xxhash64("text"))
    ranged = order.repartitionByRange(block_count(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_batches(ranged.select("doc_id", "text"), encode, out).write.options(**WRITER).parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids as written at path."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # reads two small columns
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    if len(rows.inputFiles()) <= BROADCAST_PARTS:  # else ids would be shuffled to meet a few numbers
        starts = F.broadcast(starts)
    return rows.join(starts, "part").select(
        "doc_id", (F.col("first") + F.col("part_start")).cast("long").alias("start"), "n_tokens", "ids"
    )


def id_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (recounted) and ids_crc32 of rows with ids."""
    out = schema(("doc_id", id_type(rows)), ("start", "long"), ("n_tokens", "long"), ("ids_crc32", "long"))

    def digest(batches):
        for batch in batches:
            ids = batch.column(2)
            flat = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield batch_of(out, [batch.column(0), batch.column(1), np.diff(at) // 4, np.array(crc, np.int64)])

    return map_batches(rows.select("doc_id", "start", "ids"), digest, out)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids into the shared folder and return their digests as read back."""
    path = f"{shared_dir(docs.sparkSession)}/terrane-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, tokenizer_path, end_id, path)
    return id_digests(read_token_ids(docs.sparkSession, path))
