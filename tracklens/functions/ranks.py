"""Ranks and quantiles over a whole table without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the values of a group are cut.
RANGES = 256


def counted(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, n, below, total: for each value of ``rows`` in its group how many rows have it, how many have a
    smaller one, and how many the group has. Nulls are left out.

    Values are cut into ranges at approximate quantiles (at most RANGES rows for each group); the sums of the ranges
    are added up first, then the values of each range on their own. Cuts decide where the work is done, not the result.
    """
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]

    def attach(df: DataFrame, small: DataFrame) -> DataFrame:
        renamed = small.withColumnsRenamed({c: f"_{c}" for c in by})
        return (df.join(F.broadcast(renamed), same) if by else df.crossJoin(F.broadcast(renamed))).drop(*[f"_{c}" for c in by])

    # Groups are few (dimensions of a vector, names of measures): a row each.
    ranged = attach(counts, cuts).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    renamed = sums.withColumnsRenamed({c: f"_{c}" for c in by})
    joined = ranged.join(F.broadcast(renamed), [*same, F.col("_range") == F.col("_r")]).drop(*[f"_{c}" for c in by], "_r")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("below", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("_range", "_before")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, breaks: the quantiles ``shares`` of each group, between two values in proportion. One row for each group."""
    known = counted(rows, by, value)

    def at(position: Column) -> Column:
        """The value at a place (from 0) of the ordered rows: one row of a group knows it, and one aggregate finds all places."""
        return F.max(F.when((position >= F.col("below")) & (position < F.col("below") + F.col("n")), F.col(value)))

    places = [F.lit(q) * (F.col("total") - 1) for q in shares]
    ends = [x for i, h in enumerate(places) for x in (at(F.floor(h)).alias(f"_low{i}"), at(F.ceil(h)).alias(f"_high{i}"))]
    each = known.groupBy(*by).agg(F.max("total").alias("total"), *ends)
    between = [F.col(f"_low{i}") + (h - F.floor(h)) * (F.col(f"_high{i}") - F.col(f"_low{i}")) for i, h in enumerate(places)]
    return each.select(*by, F.array(*between).alias("breaks"))
