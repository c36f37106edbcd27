"""Counts, shares, grids and other descriptive aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_and_shares(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG1: rows of each group and their share of all."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("fraction", F.col("n") / F.col("_all")).drop("_all")


def kept_removed(df: DataFrame, by: Sequence[str], keep: Column) -> DataFrame:
    """AGG2."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept")).withColumn("removed", F.col("total") - F.col("kept"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """AGG3 and SET3: a contingency table with a column for each of the given values."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(str(v)) for v in values))


def area_summary(cells: DataFrame, nuclei: DataFrame, key: str, area: str) -> DataFrame:
    """JOI2 and AGG4: mean and median of both areas and of the guarded ratio."""
    both = cells.select(key, F.col(area).alias("a")).join(nuclei.select(key, F.col(area).alias("b")), key)
    ratio = F.when(F.col("a") != 0, F.col("b") / F.col("a"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.percentile("a", 0.5).alias("median_a"), F.avg("b").alias("mean_b"), F.percentile("b", 0.5).alias("median_b"), F.avg(ratio).alias("mean_ratio"))


def grid_means(df: DataFrame, x: str, y: str, step: float, values: Sequence[str]) -> DataFrame:
    """AGG10: means and counts in square cells from the least coordinates on."""
    origin = df.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    cell = df.crossJoin(F.broadcast(origin)).withColumns({"gx": F.floor((F.col(x) - F.col("_x0")) / step), "gy": F.floor((F.col(y) - F.col("_y0")) / step)})
    return cell.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))


def row_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG10: each column's share of the row's sum, 0 where that is 0."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.withColumns({c: F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in columns})


def dominant(columns: Sequence[str]) -> Column:
    """AGG10: the name of the largest column, the first of equals."""
    best = F.greatest(*(F.col(c) for c in columns))
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        out = F.when(F.col(c) == best, c).otherwise(out)
    return out


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AGG10's abundance summary: mean, median, 5th and 95th percentile, interpolated."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, q).alias(name) for name, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))))


def grid_concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOI3: grid cells that both tables have, their number, correlation and share of equal dominant labels.

    a, b: (gx, gy, value, label).
    """
    both = a.alias("a").join(b.alias("b"), ["gx", "gy"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("a.value", "b.value").alias("pearson"), F.avg((F.col("a.label") == F.col("b.label")).cast("double")).alias("concordance"))


def combinations(names: DataFrame, size: int) -> DataFrame:
    """SET4: all sets of up to `size` names, in name order, as (combo array, size)."""
    out = level = names.select(F.array("name").alias("combo"))
    for _ in range(size - 1):
        level = level.join(names, F.element_at("combo", -1) < F.col("name")).select(F.concat("combo", F.array("name")).alias("combo"))
        out = out.union(level)
    return out.withColumn("size", F.size("combo"))


def jaccard(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET2: sizes of both sets of keys, of their intersection, and the Jaccard index (0 for two empty sets)."""
    tagged = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full_outer")
    out = tagged.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("_n"))
    return out.withColumn("jaccard", F.when(F.col("_n") > 0, F.col("n_both") / F.col("_n")).otherwise(0.0)).drop("_n")

