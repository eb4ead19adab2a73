"""Class breaks of numeric columns, and the classes of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("equal", "arithmetic", "quantile", "stddev", "jenks", "geometric", "headtail")
JENKS_SAMPLE = 1500  # values at most that the optimal classes are computed on


def _values(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


#: Below this a span or deviation counts as none.
EPSILON = 2.0**-52


def breaks(df: DataFrame, column: str, method: str, classes: int) -> list[float]:
    """The inner class bounds in ascending order, one less than classes, which is clamped to 2..64.

    head/tail stops by itself and may give fewer. Equal values spread over a span of 1; without values the span is 0 to 1.
    """
    k = min(64, max(2, classes))
    values = _values(df, column)
    low, high, n, mean, std = values.agg(F.min("v"), F.max("v"), F.count("v"), F.avg("v"), F.stddev_pop("v")).first()
    if not n:
        low, high, method = 0.0, 1.0, "equal"
    span = high - low if high - low >= EPSILON else 1.0
    if method == "equal":
        return [low + span * i / k for i in range(1, k)]
    if method == "arithmetic":
        step = span / (k * (k + 1) / 2)
        return [low + step * i * (i + 1) / 2 for i in range(1, k)]
    if method == "quantile":
        at = [min(i * n // k, n - 1) for i in range(1, k)]
        found = dict(zip(sorted(set(at)), _nth(values, sorted(set(at)))))
        return [found[i] for i in at]
    if method == "stddev":
        return [mean + 0.5 * max(std, EPSILON) * (i - k / 2) for i in range(1, k)]
    if method == "geometric":
        base = values.where("v > 0").agg(F.min("v")).first()[0]
        if base is None or high / base <= 1 + 1e-12:
            return breaks(df, column, "equal", k)
        q = (high / base) ** (1 / k)
        return [base * q**i for i in range(1, k)]
    if method == "headtail":
        out, head, size = [], values, n
        while len(out) < k - 1 and size > 1:
            m = head.agg(F.avg("v")).first()[0]
            rest = head.where(F.col("v") >= m)
            count = rest.count()
            if count in (0, size):
                break
            out.append(m)
            if count / size >= 0.4:
                break
            head, size = rest, count
        return out or breaks(df, column, "equal", k)
    if method == "jenks":
        stride = max(1, -(-n // JENKS_SAMPLE))
        sample = np.sort(np.array(_nth(values, list(range(0, n, stride)))))
        return jenks(sample, k)
    raise ValueError(f"no method {method!r}")


def _nth(values: DataFrame, positions: list[int]) -> list[float]:
    """Values at positions of the ascending order, found from counts by value range so that no task sorts all rows."""
    from pyspark.sql import Window

    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id())
    totals = counts.groupBy("part").agg(F.sum("n").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("run", run).join(F.broadcast(totals.select("part", "before")), "part").withColumn("end", F.col("before") + F.col("run"))
    wanted = F.explode(F.filter(F.array(*map(F.lit, positions)), lambda p: (p < F.col("end")) & (p >= F.col("end") - F.col("n"))))
    return [r[0] for r in ranked.select("v", wanted.alias("p")).orderBy("p").select("v").collect()]


def jenks(values: np.ndarray, k: int) -> list[float]:
    """Fisher's optimal classes of sorted values: the first value of each class but the first."""
    n = len(values)
    k = min(k, len(np.unique(values)))
    if k < 2:
        return []
    s, s2 = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])
    cost = s2[1:] - s[1:] ** 2 / np.arange(1, n + 1)
    back = np.zeros((k, n), np.int64)
    for c in range(1, k):
        new = np.full(n, np.inf)
        for j in range(c, n):
            i = np.arange(c, j + 1)  # the class's first value
            w = s2[j + 1] - s2[i] - (s[j + 1] - s[i]) ** 2 / (j + 1 - i)
            total = cost[i - 1] + w
            m = int(np.argmin(total))
            new[j], back[c, j] = total[m], i[m]
        cost = new
    out, j = [], n - 1
    for c in range(k - 1, 0, -1):
        i = int(back[c, j])
        out.append(float(values[i]))
        j = i - 1
    return sorted(out)


def bin_of(column: str | Column, bounds: list[float]) -> Column:
    """How many bounds are at most the value, 63 at most; 0 for null and values that are not finite."""
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    n = F.lit(0)
    for b in bounds:
        n = n + F.when(v >= F.lit(float(b)), 1).otherwise(0)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0).otherwise(F.least(n, F.lit(63)))


def category_of(column: str, known: list[str]) -> Column:
    """The place of a value in a list; 63 for others and null."""
    out = F.lit(63)
    for i, v in reversed(list(enumerate(known[:63]))):
        out = F.when(F.col(column).cast("string") == v, i).otherwise(out)
    return F.coalesce(out, F.lit(63))
