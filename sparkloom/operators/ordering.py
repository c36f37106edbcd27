"""Running sums and places over a whole order, without one task that sees all rows.

Rows fall into buckets that follow one another in the order; windows run within buckets, and the buckets' own totals, a few
thousand rows at most, are added up by a window of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def bucket_of(value: Column) -> Column:
    """A whole number that never falls as a value of at least 0 grows: 64 buckets for each power of two from 1e-300 on."""
    v = F.greatest(value, F.lit(1e-300))
    e = F.floor(F.log2(v))
    return F.when(value > 0, e * 64 + F.floor(v / F.pow(F.lit(2.0), e.cast("double")) * 64)).otherwise(-1_000_000).cast("int")


def number_by_draw(rows: DataFrame, draw: Column, ties: Sequence[str], out: str = "place") -> DataFrame:
    """Each row's place from 0 in the order of a draw in [0, 1), then of the ties, and _n, the number of rows."""
    marked = rows.withColumns({"_u": draw}).withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_s"), F.sum("_m").over(Window.partitionBy()).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_u", *ties)) - 1
    return marked.withColumn("_w", own).join(F.broadcast(starts), "_b").withColumn(out, (F.col("_w") + F.col("_s")).cast("bigint")).drop("_u", "_b", "_w", "_s")  # BUCKETS rows


def running(rows: DataFrame, value: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds the sums (new column: summed column) over the rows up to each one in the order of a distinct value of at least 0.

    by: groups that are ordered apart. The result also has _bucket.
    """
    rows = rows.withColumn("_bucket", bucket_of(F.col(value)))
    down = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    totals = rows.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy(down("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    own = Window.partitionBy(*by, "_bucket").orderBy(down(value)).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    return within.join(starts, [*by, "_bucket"]).withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in sums}).drop(*(f"_s_{n}" for n in sums))


def least_from(rows: DataFrame, value: str, of: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the least `of` over the rows with at least the value; rows from running(), which has left _bucket."""
    least = rows.groupBy(*by, "_bucket").agg(F.min(of).alias("_l"))
    after = Window.partitionBy(*by).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select(*by, "_bucket", F.min("_l").over(after).alias("_later"))
    # in falling order, where a running minimum takes one pass
    own = Window.partitionBy(*by, "_bucket").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.min(of).over(own)).join(later, [*by, "_bucket"]).withColumn(out, F.least(out, "_later")).drop("_later")
