"""Reports over many runs: every grouping of the run's columns in one job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def across(rows: DataFrame, sets: Iterable[tuple[str, ...]], metric: Column, *, digits: int = 4, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row for each group of each set of columns (null where a column is not of the set): level, n, mean and quantiles of a metric.

    level is the number of grouping() bits, the first column the highest. Values are rounded to digits decimals and counted first, so a group is as many rows as it
    has different values and none is held whole; quantiles are exact on these values, and interpolate between neighbours. Null metrics are left out; a group without a
    value does not appear, nor does anything for an empty table.
    """
    sets = [tuple(s) for s in sets]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    scale = 10**digits
    counted = rows.select(*columns, F.round(metric * scale).cast("long").alias("_v")).where("_v is not null").groupBy(*columns, "_v").agg(F.count(F.lit(1)).alias("_n"))
    marks = F.array(*(F.struct(F.lit(sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)).alias("level"), *(F.col(c) if c in s else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns)) for s in dict.fromkeys(sets)))
    each = counted.select(F.explode(marks).alias("g"), "_v", "_n").groupBy("g.level", *(F.col(f"g.`{c}`").alias(c) for c in columns), "_v").agg(F.sum("_n").alias("_n"))
    keys = ["level", *columns]
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("_to", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_to") > rank, F.col("_v")))

    made = [F.max("_all").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n") / scale).alias("mean")]
    for q in quantiles:
        place = (F.col("_all") - 1) * F.lit(float(q))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        made.append(((low + (high - low) * share) / scale).alias(f"q{round(100 * q)}"))
    return placed.groupBy(*keys).agg(*made)


def robust(rows: DataFrame, keys: list[str], metric: Column, *, digits: int = 4) -> DataFrame:
    """(keys, n, mean, median, q25, q75, iqr) of a metric, as across() for one set of columns; without keys one row, none for an empty table."""
    out = across(rows, [tuple(keys)], metric, digits=digits).withColumnRenamed("q50", "median")
    return out.select(*keys, "n", "mean", "median", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"))
