"""Delimited text: delimiter, types and number formats found from a sample, values cast in Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.relational import quoted

DELIMITERS = (",", ";", "\t", "|")
SAMPLE_ROWS = 10_000
#: Blank, no-break blanks and apostrophes.
GROUPING = " \u00a0\u202f'\u2019"
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts all lines into the same number of fields, the larger number first; quoted ones do not count."""
    bare = [re.sub(r'"(?:[^"]|"")*"', "", x) for x in lines if x.strip()]
    best, most = ",", 0
    for d in DELIMITERS:
        counts = {x.count(d) for x in bare}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def clean_names(names: list[str]) -> list[str]:
    out: list[str] = []
    for i, n in enumerate(names):
        base, k = re.sub(r"\W+", "_", n.strip()).strip("_") or f"column_{i + 1}", 2
        name = base
        while name.lower() in (o.lower() for o in out):
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def normalised(column: str | Column, decimal_comma: bool = False) -> Column:
    """A number's text without group marks (blanks, no-break blanks, apostrophes, and commas or full stops), with a decimal point."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    c = F.regexp_replace(c, f"[{GROUPING}]", "")
    if decimal_comma:
        return F.replace(F.regexp_replace(c, r"\.(?=\d{3}(\D|$))", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(c, r",(?=\d{3}(\D|$))", "")


def has_decimal_commas(df: DataFrame, columns: list[str]) -> bool:
    """Whether the numbers of a sample of text columns are written with a decimal comma.

    A mark between a digit and exactly three digits groups. Without any of those `3,5` may be either and nothing is changed;
    with some, commas before other runs of digits must be more than those that group.
    """
    short = [F.when(F.length(F.trim(F.col(quoted(c)))) <= 32, F.trim(F.col(quoted(c)))).otherwise("") for c in columns]
    if not short:
        return False
    text = df.select(*[F.col(quoted(c)) for c in columns]).limit(SAMPLE_ROWS).select(F.concat_ws("\n", *short).alias("t"))
    count = lambda pattern: F.coalesce(F.sum(F.regexp_count("t", F.lit(pattern))), F.lit(0))
    three = r"(?=[0-9]{3}(?![0-9]))"
    r = text.agg(count(rf"(?<=[0-9])[,{GROUPING}]{three}").alias("all"), count(rf"(?<=[0-9]),{three}").alias("commas"), count(rf"(?<=[0-9]),(?=[0-9])(?![0-9]{{3}}(?![0-9]))").alias("decimal")).first()
    return r["all"] > 0 and r["decimal"] > r["commas"]


def infer_types(df: DataFrame, columns: list[str], decimal_comma: bool = False) -> DataFrame:
    """A row a text column: column, type (text, boolean, integer, float). Codes with leading zeros stay text."""
    sample = df.select(*columns).limit(SAMPLE_ROWS)
    rows = None
    for c in columns:
        v = F.trim(F.col(quoted(c)))
        full = (v != "") & v.isNotNull()
        every = lambda test: F.coalesce(F.min(F.when(full, test.cast("int"))), F.lit(0)) == 1  # noqa: B023,E731
        one = sample.agg(
            F.max(F.when(full, v.rlike(r"^0\d+$").cast("int"))).alias("zeros"), every(F.lower(v).isin(*TRUE[:4], *FALSE[:4])).alias("b"),
            every(normalised(v, decimal_comma).rlike(r"^[+-]?\d{1,18}$")).alias("i"), every(normalised(v, decimal_comma).try_cast("double").isNotNull()).alias("f"), F.count(F.when(full, 1)).alias("n"),
        )
        kind = F.when((F.col("n") == 0) | (F.col("zeros") == 1), "text").when(F.col("b"), "boolean").when(F.col("i"), "integer").when(F.col("f"), "float").otherwise("text")
        one = one.select(F.lit(c).alias("column"), kind.alias("type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def cast_as(column: str, kind: str, decimal_comma: bool = False) -> Column:
    """A text column as a type; what cannot be read is null."""
    v = F.trim(F.col(column))
    if kind == "boolean":
        return F.when(F.lower(v).isin(*TRUE), True).when(F.lower(v).isin(*FALSE), False)
    if kind in ("integer", "float"):
        return normalised(v, decimal_comma).try_cast("bigint" if kind == "integer" else "double")
    return F.col(column)


def bad_values(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """How many values of each column were there but could not be read."""
    return df.agg(*[F.count(F.when((F.trim(c) != "") & cast_as(c, k).isNull(), 1)).alias(c) for c, k in types.items()])


def read_delimited(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    head = [r[0] for r in spark.read.text(path).limit(20).collect()]
    raw = spark.read.csv(path, sep=detect_delimiter(head), header=True, inferSchema=False, escape='"', multiLine=False)
    raw = raw.toDF(*clean_names(raw.columns))
    commas = has_decimal_commas(raw, raw.columns)
    if types is None:
        types = {r["column"]: r["type"] for r in infer_types(raw, raw.columns, commas).collect()}
    return raw.select(*[cast_as(c, types.get(c, "text"), commas).alias(c) for c in raw.columns])


def points_of(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with geometry from coordinate columns; null where one is missing or not finite."""
    from terrane.functions.spatial import st

    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    good = a.isNotNull() & b.isNotNull() & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ~F.isnan(a) & ~F.isnan(b)
    return df.withColumn("geometry", F.when(good, st("st_point", a, b)))


def coordinate_columns(names: list[str]) -> tuple[str, str] | None:
    lower = {n.lower(): n for n in names}
    for x, y in (("lon", "lat"), ("lng", "lat"), ("longitude", "latitude"), ("x", "y"), ("easting", "northing")):
        if x in lower and y in lower:
            return lower[x], lower[y]
    return None
