"""The pipeline on a small folder of tables."""

import random

from tests.llm.helpers import frame
from tests.llm.test_models import prose, toxic_tables


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_tables(spark)
    r = random.Random(1)
    passage = prose(r, 30)
    extra = ["copy " + passage + " tail", 'keep token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here', "twin text " + "w1 w2 w3 w4 w5 w6", "twin text " + "w1 w2 w3 w4 w5 w6", None]
    docs = docs.union(frame(spark, extra, range(1000, 1005)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{i}")
        now = spark.read.parquet(f"{tmp_path}/out{i}")
    ids = {x.doc_id for x in now.collect()}
    assert 1000 not in ids and {1001, 1002, 1004} <= ids and 1003 not in ids
    assert not {i for i in range(0, 600, 6)} - {0} <= ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
