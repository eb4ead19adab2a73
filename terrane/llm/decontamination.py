"""Benchmark decontamination by winnowing.

Both sides are reduced to fingerprints: of every WINDOW consecutive k-gram
hashes the smallest is kept (the rightmost of equal ones). A span of
k + WINDOW - 1 words shared by both leaves a fingerprint in both, so that a
join of fingerprints misses no shared span of n words when k + WINDOW - 1 <= n.
Hits are extended to all n-word windows around them, and a window counts only
if its words are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import Words, batch_of, gram_hashes, id_type, map_batches, schema, slices, texts

#: Bytes of benchmark text that one pass over the documents takes along, as an index of some five bytes
#: for each; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: the minimum of each window of hashes, the rightmost among equal ones."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))], np.int64)
    best, at = hashes[: n - window + 1].copy(), np.arange(n - window + 1)
    for i in range(1, window):
        other = hashes[i : i + n - window + 1]
        better = other <= best
        best = np.where(better, other, best)
        at = np.where(better, np.arange(i, i + n - window + 1), at)
    return np.unique(at)


class Index:
    """Windows of a block of benchmark items, by hash. Holds the items' words, so that hits can be held against them.

    windows: for each length of a window the ascending hashes and where, among all words, each window begins.
    """

    def __init__(self, items: list[tuple[str, str]], n: int, k: int):
        self.n, self.k, self.winnow = n, k, n - k + 1
        self.ids = [item_id for item_id, _ in items]
        self.words = words = Words(pa.array([text for _, text in items], pa.string()))
        counts = np.diff(words.first)
        prints = [np.zeros(0, np.uint64)]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(counts, n)[counts > 0]).tolist():
            which = np.flatnonzero(counts >= n if length == n else counts == length)
            each = counts[which] - length + 1
            starts = np.repeat(words.first[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            keys = gram_hashes(words.hashes, length)[starts]
            order = np.argsort(keys, kind="stable")
            self.windows[length] = keys[order], starts[order].astype(np.int32)
            if length == n:
                for i in which.tolist():
                    grams = gram_hashes(words.of(i), k)
                    prints.append(grams[winnow(grams, self.winnow)])
        self.prints = np.unique(np.concatenate(prints))
        words.hashes, words.ends = np.zeros(0, np.uint64), words.ends.astype(np.int32)

    def owners(self, words: Words, start: int, length: int, key: np.uint64) -> set[str]:
        """The items that hold the window of a document's words, whose hash is key."""
        keys, starts = self.windows[length]
        among = starts[np.searchsorted(keys, key) : np.searchsorted(keys, key, side="right")]
        same = words.bytes_of(start, start + length)
        among = [at for at in among.tolist() if self.words.bytes_of(at, at + length) == same]
        return {self.ids[i] for i in (np.searchsorted(self.words.first, among, side="right") - 1).tolist()}


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def candidates(hashes: np.ndarray, index: Index) -> list[tuple[int, int, np.uint64]]:
    """(start, length, hash) of a document's windows whose hash is one of the benchmark's."""
    found = []
    if len(index.prints) and len(hashes) >= index.n:
        grams = gram_hashes(hashes, index.k)
        prints = winnow(grams, index.winnow)
        prints = prints[_among(grams[prints], index.prints)]
        if len(prints):
            starts = np.unique(np.concatenate([prints - i for i in range(index.winnow)]))
            starts = starts[(starts >= 0) & (starts + index.n <= len(hashes))]
            windows = gram_hashes(hashes, index.n)[starts]
            hit = _among(windows, index.windows[index.n][0])
            found += [(s, index.n, w) for s, w in zip(starts[hit].tolist(), windows[hit])]
    for length, (table, _) in index.windows.items():
        if length < index.n:  # items shorter than a window have no full span to leave a fingerprint
            grams = gram_hashes(hashes, length)
            found += [(s, length, grams[s]) for s in np.flatnonzero(_among(grams, table)).tolist()]
    return found


def _hits(words: Words, text: int, index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """The word ranges of a text that are hit, and the items whose windows occur there."""
    spans, items, first = [], set(), int(words.first[text])
    for start, length, key in candidates(words.of(text), index):
        owners = index.owners(words, first + start, length, key)
        if owners:
            spans.append((start, start + length))
            items |= owners
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int | None = None):
    """The benchmark's items in blocks of bounded size, one after another on the driver."""
    block_bytes = block_bytes or BLOCK_BYTES
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [tuple(r) for r in part.collect()]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 6) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges that are hit) and item_ids.

    Null texts have no words. Items of fewer than n words, but not none, are one
    window; repeated items count once each by id. Without benchmark rows nothing
    is hit. Columns besides those named are ignored. A benchmark beyond
    BLOCK_BYTES is taken in blocks, whose hits are merged by document.
    """
    spark = docs.sparkSession
    out = schema(("doc_id", id_type(docs)), ("row", "string"), ("n_words", "long"), ("spans", "array<struct<begin:int,end:int>>"), ("item_ids", "array<string>"))
    rows = texts(docs).withColumn("row", F.md5(F.col("text").cast("binary")))
    passes = None
    blocks = 0
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(items, n, k))

        def scan(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, 1, 1 << 20):
                    words = Words(part.column(1))
                    hits = [_hits(words, i, shared.value) for i in range(part.num_rows)]
                    yield batch_of(out, [
                        part.column(0), part.column(2), np.diff(words.first),
                        [[{"begin": a, "end": b} for a, b in spans] for spans, _ in hits], [sorted(items) for _, items in hits],
                    ])

        part = map_batches(rows, scan, out)
        passes = part if passes is None else passes.unionByName(part)
        blocks += 1
    if blocks > 1:
        # Copies of a row have the same hits in each pass; occurrences keeps their number.
        merged = passes.groupBy("doc_id", "row").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
            F.floor(F.count(F.lit(1)) / blocks).cast("int").alias("occurrences"),
        )
        passes = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("occurrences")))).select("doc_id", "row", "n_words", "spans", "item_ids")
    return passes


def _covered(spans) -> int:
    total, reach = 0, 0
    for s in sorted(spans, key=lambda x: (x["begin"], x["end"])):
        total += max(0, s["end"] - max(reach, s["begin"]))
        reach = max(reach, s["end"])
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 6) -> DataFrame:
    """find_overlaps() summed up: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_overlaps(docs, benchmark, n, k)
    out = schema(("doc_id", id_type(docs)), ("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"))

    def sums(batches):
        for batch in batches:
            hit = [_covered(s) for s in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield batch_of(out, [batch.column(0), batch.column(1), np.array(hit, np.int64), np.array([len(x) for x in items], np.int64), sha, [h > 0 for h in hit]])

    return map_batches(found.select("doc_id", "n_words", "spans", "item_ids"), sums, out)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 6) -> DataFrame:
    """The documents of which no n-word window is in the benchmark, with all their columns.

    Null and empty texts stay, and so does every row of an empty benchmark's table; repeated rows are judged each.
    """
    spark, kind = docs.sparkSession, T.StructType(docs.schema.fields)
    at = docs.columns.index("text")
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(items, n, k))

        def keep(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, at, 1 << 20):
                    text = part.column(at)
                    words = Words(text.fill_null("") if text.null_count else text)
                    yield part.filter(pa.array([not _hits(words, i, shared.value)[0] for i in range(part.num_rows)], pa.bool_()))

        docs = map_batches(docs, keep, kind)
    return docs
