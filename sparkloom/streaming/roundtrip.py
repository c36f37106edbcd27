"""Extension: dose effects kept up to date from a stream of experiment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_effects(stream: DataFrame, *, time: str = "ts", gene: str = "gene", dose: str = "dose", effect: str = "effect_size", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, sum and sum of squares of effects by window, gene and dose, final once the watermark has passed.

    The time may be a timestamp without zone, which is taken as one of the session's zone. State is bounded by the
    windows that are open.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, size).alias("w"), gene, dose).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(effect).alias("total"), F.sum(F.col(effect) * F.col(effect)).alias("squares"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), gene, dose, "n_rows", "total", "squares")


def effects_of(windows: DataFrame, gene: str = "gene") -> DataFrame:
    """AGG11 over what the stream has written: rows, mean and population deviation of each gene."""
    out = windows.groupBy(gene).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("_s"), F.sum("squares").alias("_q"))
    mean = F.col("_s") / F.col("n_rows")
    return out.select(gene, "n_rows", mean.alias("mean_effect"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("n_rows") - mean * mean)).alias("std_effect"))
