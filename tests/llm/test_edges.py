"""Placement against brute force, and the pipeline on empty tables, null ids and side tables with clashing columns."""

import math

import pytest
import xxhash
from pyspark.sql import functions as F

from terrane.llm import decontamination, sharding, toxicity
from tests.llm.helpers import SCHEMA, frame, odd
from tests.llm.test_models import toxic_tables


def winner(key, children):
    """The child of the largest draw among (id, path, weight)."""
    def draw(path, weight):
        h = xxhash.xxh64_intdigest(path.encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    return max((c for c in children if c[2] > 0), key=lambda c: (draw(c[1], c[2]), -c[0]))[0]


def descend(key, tree):
    """Level by level: the tree's weights are sums over leaves."""
    def total(leaves):
        return sum(s.weight for s in leaves)

    regions = {s.region for s in tree}
    region = winner(key, [(r, f"{r}", total(s for s in tree if s.region == r)) for r in regions])
    here = [s for s in tree if s.region == region]
    rack = winner(key, [(c, f"{region}/{c}", total(s for s in here if s.rack == c)) for c in {s.rack for s in here}])
    return winner(key, [(s.shard, f"{region}/{rack}/{s.shard}", s.weight) for s in here if s.rack == rack])


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 2.0, 0.5, 1.0, 0.0, 3.0, 1.0, 1.0, 4.0, 1.0]])
def test_placement_against_brute_force(spark, weights):
    tree = [sharding.Shard(s.region, s.rack, s.shard, w) for s, w in zip(sharding.topology(len(weights)), weights)]
    keys = [str(i) for i in range(-5, 600)] + ["", "ünï", None]
    docs = spark.createDataFrame([(k,) for k in keys], "k string")
    grown = sharding.grown(tree, 1.5)
    rows = sharding.place(sharding.place(docs, tree, "k", "a"), grown, "k", "b").collect()
    assert [(r.a, r.b) for r in rows] == [(descend(r.k or "", tree), descend(r.k or "", grown)) for r in rows]
    assert all(r.a == r.b or r.b == len(weights) for r in rows) and all(weights[r.a] for r in rows)


def test_slots_of_one_repeated_row(spark):
    docs = frame(spark, ["again"], [7]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n")
    rows = sharding.shard_documents(docs, buckets=16).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(5000))


def tables(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, toxic int"), spark.createDataFrame([], "item_id bigint, text string"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Null ids and texts, no labels, an empty benchmark: one row of each class of equal texts is packed, the others all."""
    import corpus_pipeline

    docs = odd(spark).union(frame(spark, ["another one without an id", "a third text without any id"], [None, None]))
    tables(spark, tmp_path, docs, spark.createDataFrame([], "doc_id bigint, toxic int"), spark.createDataFrame([(1, None)], "item_id bigint, text string"))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        now = spark.read.parquet(f"{tmp_path}/out{i}")
        assert now.columns == docs.columns
    kept = {r.text for r in now.collect() if r.text}
    assert kept >= {r.text for r in docs.collect() if r.text and len(r.text.split()) > 3}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_id is None) and max(r.offset + r.length for r in packed) <= 4096


def test_side_tables_with_clashing_columns(spark):
    """Columns of labels and benchmark besides those that are read take no part, whatever their names."""
    docs, labels = toxic_tables(spark)
    more = labels.select("doc_id", "toxic", F.lit("foul").alias("text"), F.lit(1.0).alias("score"), F.lit(1).alias("predicted"), F.lit(True).alias("held_out"), F.lit(3).alias("block"))
    first, second = ({r.doc_id: r.score for r in toxicity.score_documents(docs, x).collect()} for x in (labels, more))
    assert second == pytest.approx(first)
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id bigint, text string")
    clash = items.select("*", F.lit(5).alias("doc_id"), F.lit("x").alias("n_words"), F.lit(0).alias("block"), F.lit("en").alias("lang"))
    texts = frame(spark, ["a w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 b", "w1 w2", None])
    got = [sorted(map(tuple, decontamination.contamination(texts, b).select("doc_id", "n_words", "n_hit").collect())) for b in (items, clash)]
    assert got[0] == got[1] == [(0, 12, 10), (1, 2, 0), (2, 0, 0)]


def test_null_texts_pass_the_toxicity_filter(spark):
    docs, labels = toxic_tables(spark)
    kept = toxicity.without_toxic(docs.union(frame(spark, [None, ""], [9000, 9001])), labels)
    assert {9000, 9001} <= {r.doc_id for r in kept.collect()}
