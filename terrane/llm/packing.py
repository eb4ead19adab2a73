"""Packing documents into windows by best-fit decreasing.

Documents longer than a window are cut into full windows and a rest. Pieces are
then placed by falling length, each into the open window whose remaining
capacity is the smallest that still holds it. A segment tree over capacities
finds that window. Only pieces' lengths are packed, in hash groups of bounded
size, and groups' windows are numbered one after another.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import batch_of, id_type, map_batches, schema, slices, stored, texts
from terrane.llm.token_encode import encoder

#: Tokens whose pieces one group packs: some 500 windows, of which about the last stays open.
GROUP_TOKENS = 1 << 21


class Capacities:
    """A segment tree over 0..size of how many open windows have each remaining capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least need that some open window has, or -1."""
        i, count = self.leaves + need, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The window and the offset of each piece (in the given order for equal lengths), and the number of windows."""
    order = np.argsort(-lengths, kind="stable")
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_at = Capacities(size), [[] for _ in range(size + 1)]
    n = 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        if need > size:
            raise ValueError(f"a piece of {need} tokens does not fit a window of {size}")
        capacity = tree.tightest(need)
        if capacity < 0:
            capacity, w = size, n
            n += 1
        else:
            w = open_at[capacity].pop()
            tree.add(capacity, -1)
        window[i], offset[i] = w, size - capacity
        if capacity > need:
            open_at[capacity - need].append(w)
            tree.add(capacity - need, 1)
    return window, offset, n


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each document's pieces of at most size ids."""
    out = schema(("doc_id", id_type(docs)), ("row", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"))

    def cut(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, end_id)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows in slices(batch, 1):
                ids, n = enc(rows.column(1))
                flat = memoryview(ids.astype("<u4")).cast("B")
                each = -(-n // size)
                doc = np.repeat(np.arange(len(n)), each)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * size
                length = np.minimum(size, n[doc] - start)
                first = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                yield batch_of(out, [rows.column(0).take(pa.array(doc)), row + doc, start, length, np.array(crc, np.int64), n[doc]])
                row += len(n)

    return map_batches(texts(docs), cut, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of a document, the end id included, is in exactly one piece, and
    sequence_id runs from 0 without gaps. A null or empty text is one piece with
    the end id. Repeated rows are packed each on its own. Columns besides doc_id
    and text are ignored; an empty table gives no rows.
    """
    pieces = stored(pieces_of(docs, tokenizer_path, end_id, size))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    grouped = pieces.withColumn("pack", F.pmod(F.xxhash64("row", "start"), F.lit(groups)).cast("int"))
    out = schema(*[(f.name, f.dataType) for f in pieces.schema if f.name != "row"], ("pack", "int"), ("window", "long"), ("offset", "long"), ("windows", "long"))

    def pack(pdf):
        pdf = pdf.sort_values(["row", "start"], ignore_index=True)  # the same windows if a task runs again
        window, offset, n = best_fit_decreasing(pdf["length"].to_numpy(), size)
        return pdf.drop(columns="row").assign(window=window, offset=offset, windows=n)[out.names]

    packed = stored(grouped.groupBy("pack").applyInPandas(pack, out))
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    firsts = packed.groupBy("pack").agg(F.max("windows").alias("n")).select("pack", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return packed.join(firsts, "pack").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("window")).cast("long").alias("sequence_id"), "offset"
    )
