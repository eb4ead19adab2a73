"""Scoring texts with a smoothed n-gram model, as a weighted backoff automaton.

A state is a context that occurs in training. Its arcs carry log10
probabilities of the words seen after it; its failure arc leads to the context
without its first word and carries the weight of backing off. A text is
scored in one pass from left to right: at each word failure arcs are followed,
and their weights added, until a state has an arc for the word.

Probabilities are Dirichlet-smoothed, order by order,
p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k), down to the add-one estimate
(c(w) + 1) / (N + V + 1), which leaves one share to all unknown words.

The model grows with the corpus, so no task ever holds it. Documents are hashed
into blocks of bounded bytes; each block counts its own n-grams, counts meet in hash buckets,
whose number follows from the n-grams' bytes, and each block gets back the counts of the
n-grams it holds, from which it builds its slice of the automaton.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import (
    TOKEN_TABLE, batch_table, bounded_batches, crc32_of_id, gram_hashes, hash_pieces, id_type, release, schema, shuffle_partitions, text_bytes, texts, word_hashes,
)

ORDER = 2
#: Weight of the lower order, in observations.
CONCENTRATION = 100.0
#: Bytes of text that one block holds, and bytes of text whose n-grams one bucket merges.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20


def _mark(word: bytes) -> np.uint64:
    return hash_pieces(np.frombuffer(word, np.uint8), np.array([len(word)]))[0]


_START, _END = _mark(b" start"), _mark(b" end")  # no word holds a blank


class Stream:
    """The texts of a block one after another: each text's tokens after order - 1 starts (one at least).

    Tokens are the words between ASCII white space with A-Z lower-cased, and one end a text.
    """

    def __init__(self, strings: pa.Array, order: int):
        lead = max(1, order - 1)
        self.order = order
        words, first = word_hashes(strings, TOKEN_TABLE)
        n = len(first) - 1
        self.counts = np.diff(first) + 1
        stops = np.cumsum(self.counts + lead)
        self.last_start = stops - self.counts - 1
        self.hashes = np.full(int(stops[-1]) if n else 0, _START, np.uint64)
        self.hashes[np.arange(len(words)) + np.repeat(np.arange(n) * (lead + 1) + lead, self.counts - 1)] = words
        self.hashes[stops - 1] = _END
        real = np.ones(len(self.hashes), bool)
        for i in range(lead):
            real[self.last_start - i] = False
        self.ends = np.flatnonzero(real)  # positions of tokens that are predicted
        self.owner = np.repeat(np.arange(n, dtype=np.int32), self.counts)

    def table(self, k: int, train: np.ndarray) -> Table:
        """The k-grams that end at predicted tokens.

        Below the highest order the run of starts counts once a text, as the first token's context.
        """
        at, weight = self.ends, train[self.owner]
        if k < self.order and len(self.counts):
            at, weight = np.concatenate([at, self.last_start]), np.concatenate([weight, train])
        grams = gram_hashes(self.hashes, k)[at - (k - 1)] if len(at) else np.zeros(0, np.uint64)
        keys, inverse = np.unique(grams, return_inverse=True)
        number = np.zeros(len(self.hashes), np.int32)
        number[at] = inverse
        return Table(keys, np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64), number)


class Table:
    """A block's distinct k-grams in ascending order of their keys, their counts in training, and the number of
    the one that ends at each position of the stream."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, number: np.ndarray):
        self.keys, self.counts, self.number = keys, counts, number

    def parts(self, buckets: int) -> list[tuple[int, slice]]:
        """Buckets are equal ranges of keys."""
        if not len(self.keys):
            return []
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, byte plane by byte plane: high planes are mostly zeros."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after one byte that says how many."""
    width = 1 if not len(counts) or counts.max() < 1 << 8 else 4 if counts.max() < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def start_key() -> np.uint64:
    """The unigram key of a start, which is no token."""
    return gram_hashes(np.array([_START]), 1)[0]


class Automaton:
    """The states and arcs that a stream can meet, numbered as its tables are.

    arcs[k]: for each k-gram the log10 probability of its last word after the others, nan where training has no such arc.
    failures[k]: for each k-gram, as a state, the log10 weight of backing off from it; 0 where it is no state.
    """

    def __init__(self, stream: Stream, tables: dict[int, Table], tokens: int, types: int, concentration: float = CONCENTRATION):
        self.stream, self.tables, self.order = stream, tables, stream.order
        self.norm = float(tokens + types + 1)
        self.arcs: dict[int, np.ndarray] = {}
        self.failures: dict[int, np.ndarray] = {}
        ends = stream.ends
        p = (tables[1].counts + 1) / self.norm
        self.root = np.log10(p)
        lower = p[tables[1].number[ends]]
        for k in range(2, self.order + 1):
            table, context = tables[k], tables[k - 1]
            some = np.zeros(len(table.keys), np.int64)  # a token at which each k-gram ends
            some[table.number[ends]] = np.arange(len(ends))
            h = context.counts[context.number[ends[some] - 1]] if len(some) else np.zeros(0)
            p = np.where(h > 0, (table.counts + concentration * lower[some]) / (h + concentration), lower[some]) if len(some) else np.zeros(0)
            self.arcs[k] = np.where(table.counts > 0, np.log10(p), np.nan)
            self.failures[k - 1] = np.where(context.counts > 0, np.log10(concentration / (context.counts + concentration)), 0.0)
            lower = p[table.number[ends]]

    def known(self) -> np.ndarray:
        return self.tables[1].counts[self.tables[1].number[self.stream.ends]]

    def states(self) -> np.ndarray:
        """The state after each position: how many of its last words the longest run of them that is a context has; 0 is the root."""
        state = np.zeros(len(self.stream.hashes), np.int8)
        for k in range(1, self.order):
            table = self.tables[k]
            if len(table.keys):
                state[table.counts[table.number] > 0] = k
        return state

    def traverse(self) -> np.ndarray:
        """The weight of each token: that of the failure arcs followed for it and of the arc taken.

        A token is read in the state that the tokens before it have led to. As a state is a run of
        words, all states of a block are known at once, and its tokens fall from level to level together.
        """
        ends, weight = self.stream.ends, np.zeros(len(self.stream.ends))
        state = self.states()[ends - 1]
        pending = np.arange(len(weight))
        for k in range(self.order, 1, -1):
            here = pending[state[pending] == k - 1]
            arc = self.arcs[k][self.tables[k].number[ends[here]]]
            missing = np.isnan(arc)
            weight[here[~missing]] += arc[~missing]
            failed = here[missing]
            weight[failed] += self.failures[k - 1][self.tables[k - 1].number[ends[failed] - 1]]
            state[failed] = k - 2
            state[here[~missing]] = -1
            pending = pending[state[pending] >= 0]
        weight[pending] += self.root[self.tables[1].number[ends[pending]]]
        return weight


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    return pa.concat_arrays([c for c in table.column(name).chunks] or [pa.array([], table.schema.field(name).type)])


def _segments(buckets: int, order: int, out):
    def count(table: pa.Table) -> pa.Table:
        stream = Stream(_column(table, "text"), order)
        train = _column(table, "train").to_numpy(zero_copy_only=False)
        block, rows = table.column("block")[0].as_py(), []
        for k in range(1, order + 1):
            grams = stream.table(k, train)
            for bucket, part in grams.parts(buckets):
                rows.append((block, k, bucket, pack_keys(grams.keys[part]), pack_counts(grams.counts[part])))
        del stream, grams
        release()
        return batch_table(out, list(map(list, zip(*rows))) if rows else [[] for _ in out])

    return count


def _merge(columns: list[str]):
    skip = start_key()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, tokens, types = [], 0, 0
        bucket = int(pdf["bucket"].iloc[0])
        for k, part in pdf.groupby("k"):
            keys = [unpack_keys(x) for x in part["grams"]]
            counts = [unpack_counts(x) for x in part["counts"]]
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
            if k == 1:
                real = unique != skip
                tokens, types = int(totals[real].sum()), int((totals[real] > 0).sum())
            at = 0
            for block, own in zip(part["block"], counts):
                all_counts = totals[inverse[at : at + len(own)]]
                at += len(own)
                other = all_counts != own  # the block knows the rest itself
                if other.any():
                    rows.append((block, k, bucket, np.packbits(other).tobytes(), pack_counts(all_counts[other]), 0, 0))
        rows.append((-1, 0, bucket, b"", b"", tokens, types))
        release()
        return pd.DataFrame(rows, columns=columns)

    return merge


def score_documents(
    docs: DataFrame, order: int = ORDER, concentration: float = CONCENTRATION, held_out: tuple[int, int] = (7, 2), block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose crc32(doc_id as text) mod held_out[0]
    is not held_out[1]. A null or empty text is the end alone. With nothing to
    learn from every token has probability 1. Repeated rows are learnt from and
    scored each, those of different input partitions in different blocks. Columns besides
    doc_id and text are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size, least = text_bytes(docs), shuffle_partitions(spark)
    blocks, buckets = max(least, math.ceil(size / block_bytes)), max(least, math.ceil(size / bucket_bytes))
    rows = texts(docs).select(
        "doc_id", "text",
        (crc32_of_id() % held_out[0] == held_out[1]).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block"),
    ).withColumn("train", ~F.col("held_out"))
    # One exchange of the texts, which counting and scoring share.
    dealt = rows.repartition("block")
    parts = schema(("block", "int"), ("k", "int"), ("bucket", "int"), ("grams", "binary"), ("counts", "binary"))
    segments = dealt.groupBy("block").applyInArrow(_segments(buckets, order, parts), parts)
    slices = schema(("block", "int"), ("k", "int"), ("bucket", "int"), ("which", "binary"), ("totals", "binary"), ("tokens", "long"), ("types", "long"))
    merged = segments.groupBy("bucket").applyInPandas(_merge(slices.names), slices)
    total = merged.where("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types"))
    known = dealt.crossJoin(F.broadcast(total))  # a single row
    out = schema(
        ("doc_id", id_type(docs)), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"),
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return batch_table(out, [[] for _ in out])
        stream = Stream(_column(left, "text"), order)
        answers = {(k, b): i for i, (k, b) in enumerate(zip(right.column("k").to_pylist(), right.column("bucket").to_pylist()))}
        train = _column(left, "train").to_numpy(zero_copy_only=False)
        tables = {}
        for k in range(1, order + 1):
            tables[k] = table = stream.table(k, train)
            for bucket, part in table.parts(buckets):
                if (i := answers.get((k, bucket))) is not None:
                    counts = table.counts[part]
                    other = np.unpackbits(np.frombuffer(right.column("which")[i].as_buffer(), np.uint8), count=len(counts)).astype(bool)
                    counts[other] = unpack_counts(right.column("totals")[i].as_py())
        tokens, types = left.column("tokens")[0].as_py(), left.column("types")[0].as_py()
        model = Automaton(stream, tables, tokens, types, concentration)
        by = lambda x: np.bincount(stream.owner, weights=x, minlength=len(left))
        done = batch_table(out, [
            _column(left, "doc_id"), _column(left, "held_out"), stream.counts, by(model.known() > 0).astype(np.int64),
            np.full(len(left), tokens, np.int64), by(model.root[tables[1].number[stream.ends]]), by(model.traverse()),
        ])
        del stream, tables, model
        release()
        return done

    answers = merged.where("block >= 0").select("block", "k", "bucket", "which", "totals")
    return known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)
