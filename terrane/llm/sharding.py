"""Placing documents into shards with a hierarchical weighted hash tree.

A tree has regions, racks and shards. At each level every child draws
ln(u) / weight, with u a hash of the document's key and the child's path,
and the largest draw wins. A child's draw depends on its own path and weight
alone, so that a changed weight moves rows only into or out of the subtree
it belongs to. A shard added as a region of its own therefore takes rows
into itself and moves no others.

Only built-in column functions are used.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import fresh, shuffle_partitions, stored


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Shard]:
    """An even tree: shards fill racks, racks fill regions."""
    per_region = racks_per_region * shards_per_rack
    return [Shard(i // per_region, i % per_region // shards_per_rack, i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own: no other subtree's weight changes."""
    return [*tree, Shard(1 + max((s.region for s in tree), default=-1), 0, 1 + max((s.shard for s in tree), default=-1), weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.ln(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """The child with the largest draw; ties go to the smallest id."""
    alive = [c for c in children if c[2] > 0]
    if not alive:
        return F.lit(None).cast("int")
    if len(alive) == 1:
        return F.lit(alive[0][0])
    draws = [F.struct(_draw(key, path, w).alias("d"), F.lit(-child).alias("c")) for child, path, w in alive]
    return -F.array_max(F.array(*draws))["c"]


def place(df: DataFrame, tree: list[Shard], key: str, out: str) -> DataFrame:
    """df with a column out: the shard of each row's key. A null key is hashed as the empty text."""
    regions: dict[int, float] = defaultdict(float)
    racks: dict[tuple[int, int], float] = defaultdict(float)
    for s in tree:
        regions[s.region] += s.weight
        racks[s.region, s.rack] += s.weight
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    region, rack = fresh(df, "region"), fresh(df, "rack")
    df = df.withColumn(region, _winner(k, [(r, f"{r}", w) for r, w in sorted(regions.items())]))
    choice = F.lit(None).cast("int")
    for r in sorted(regions):
        choice = F.when(F.col(region) == r, _winner(k, [(c, f"{q}/{c}", w) for (q, c), w in sorted(racks.items()) if q == r])).otherwise(choice)
    df = df.withColumn(rack, choice)
    choice = F.lit(None).cast("int")
    for r, c in sorted(racks):
        leaves = [(s.shard, f"{r}/{c}/{s.shard}", s.weight) for s in tree if (s.region, s.rack) == (r, c)]
        choice = F.when((F.col(region) == r) & (F.col(rack) == c), _winner(k, leaves)).otherwise(choice)
    return df.withColumn(out, choice).drop(region, rack)


def shard_documents(docs: DataFrame, tree: list[Shard] | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text has none and crc32 0.
    Slots run from 0 without gaps in each shard. They are numbered within hash
    buckets of a shard, whose starts come from the buckets' counts, so that no
    task sees a whole shard. Repeated rows get a slot each, in buckets of their own. Columns besides
    doc_id and text are ignored. An empty table gives no rows.
    """
    tree = topology(8) if tree is None else tree
    if buckets is None:
        buckets = max(16, min(4096, shuffle_partitions(docs.sparkSession) // 2))
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    rows = place(place(rows, tree, "doc_id", "shard"), grown(tree), "doc_id", "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    rows = stored(rows)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most shards * buckets rows, both of them parameters.
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard",
    )
