from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, block int, bucket int"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, 0.5, 1, 2) for i, t in zip(ids, texts)], SCHEMA)


def odd(spark):
    """Null, empty, blank, very long, repeated and exotic texts, a repeated row and a null id."""
    texts = [None, "", "  \n\t ", "word " * 30_000, "same text here, twice over", "same text here, twice over", "Ünïcode ß 漢字 Σας \x00 \x1c end.", "a.b,c  d\n\ne ,f", "same text here, twice over"]
    return frame(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 4]).union(frame(spark, ["no id at all"], [None]))
