"""Screens of responses: rank sums with exact tails, response edges, trial selection, merged contexts, name universes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import rank_sum_p
from . import expression as X
from . import ranking as R


def stratified_rank_sum(values: DataFrame, by: Sequence[str], stratum: str, value: str, first: str, second: str, least: int = 3) -> DataFrame:
    """STA3: (by, u, z, p, mean_first, mean_second, log2fc) of a rank-sum test between two strata with enough values.

    p is exact where a stratum has at most 8 values and none are equal, else by the corrected z; the fold change is
    log2((mean_first + 1e-6) / (mean_second + 1e-6)).
    """
    test = X.rank_sum(values, by, stratum, value, first, second, ties=True).filter((F.col("n_case") >= least) & (F.col("n_control") >= least))
    mean = lambda s: F.avg(F.when(F.col(stratum) == s, F.col(value)))
    means = values.filter(F.col(stratum).isin(first, second)).groupBy(*by).agg(mean(first).alias("mean_first"), mean(second).alias("mean_second"))
    out = test.join(means, list(by)).withColumn("p", rank_sum_p("u", "n_case", "n_control", "z", "ties"))
    return out.withColumn("log2fc", F.log2((F.col("mean_first") + 1e-6) / (F.col("mean_second") + 1e-6))).drop("ties")


def response_edges(values: DataFrame, cells: DataFrame, control: str, least: int = 5, alpha: float = 0.1) -> DataFrame:
    """STA4: (source, target, u, z, p, q, responds) of every label against the controls, for every other target.

    values: (cell_id, gene, value), zeros left out; cells: (cell_id, label). Values are counted by label, gene and value
    first, zeros by what is missing, so a control's count meets each label but no cell does. Labels with fewer than
    `least` cells are left out; distributions that are equal have p = 1; q is over all pairs.
    """
    n = cells.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    counts = values.join(cells, "cell_id").groupBy("label", "gene", "value").agg(F.count(F.lit(1)).alias("m"))
    found = counts.groupBy("label", "gene").agg(F.sum("m").alias("k"))
    every = n.crossJoin(found.select("gene").distinct()).join(found, ["label", "gene"], "left")  # labels times genes
    zeros = every.select("label", "gene", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("m")).filter("m > 0")
    counts = counts.join(n.select("label"), "label", "left_semi").unionByName(zeros).groupBy("label", "gene", "value").agg(F.sum("m").alias("m"))
    case = counts.filter(F.col("label") != control).select(F.col("label").alias("source"), F.col("gene").alias("target"), "value", F.col("m").alias("_a"), F.col("m").alias("_m"))
    sources = n.filter(F.col("label") != control).select(F.col("label").alias("source"))
    base = counts.filter(F.col("label") == control).select(F.col("gene").alias("target"), "value", F.lit(0).cast("bigint").alias("_a"), F.col("m").alias("_m"))
    both = case.unionByName(sources.crossJoin(base).select(case.columns)).filter("source <> target")
    per = both.groupBy("source", "target", "value").agg(F.sum("_a").alias("_a"), F.sum("_m").alias("_m"))
    test = X.rank_sum_of_counts(per, ["source", "target"], "value", ties=True)
    test = test.withColumn("p", rank_sum_p("u", "n_case", "n_control", "z", "ties")).drop("ties")
    return R.benjamini_hochberg(test, "p").withColumn("responds", F.col("q") <= alpha)


def best_trial(trials: DataFrame, positives: DataFrame, most: int = 20) -> DataFrame:
    """SRT11: (trial, average_precision, n_trials) of the trial with the highest average precision, then the least number.

    trials: (trial, source, target, score); positives: (source, target). More than `most` trials are an error.
    """
    marked = trials.join(positives.select("source", "target", F.lit(True).alias("_t")).distinct(), ["source", "target"], "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    scored = R.ranking_metrics(marked, "score", "_t", ["trial"])
    n = scored.agg(F.count(F.lit(1)).alias("n_trials"))
    best = scored.agg(F.max_by(F.struct("trial", "average_precision"), F.struct(F.round("average_precision", 12).alias("a"), (-F.col("trial")).alias("t"))).alias("b"))
    out = best.select("b.*").crossJoin(F.broadcast(n))
    return out.withColumn("n_trials", F.when(F.col("n_trials") <= most, F.col("n_trials")).otherwise(F.raise_error(F.lit(f"more than {most} trials")).cast("bigint")))


def merged_contexts(contexts: dict[str, DataFrame], label: str, control: str, by: Sequence[str] = ("gene",), value: str = "value") -> DataFrame:
    """EVD14: the rows of all contexts by name, each standardised by its own controls, with the context as environment."""
    done = [X.standardize(rows, F.col(label) == control, by, value).withColumn("environment", F.lit(name)) for name, rows in contexts.items()]
    return union_by_name(done)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """SET1: the rows of all frames; a column that a frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_names(frames: Sequence[DataFrame], name: str) -> DataFrame:
    """JOI12: the names that all frames have, each once."""
    return reduce(lambda a, b: a.join(b.select(name), name, "left_semi"), frames[1:], frames[0].select(name).distinct())


def eligible_sources(cells: DataFrame, names: DataFrame, held_out: DataFrame, control: str, least: int) -> DataFrame:
    """JOI12: (label, n) of labels with enough cells that are names of the universe, aren't held out and aren't the control."""
    n = cells.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("label") != control))
    return n.join(names.select(F.col("name").alias("label")), "label", "left_semi").join(held_out.select("label"), "label", "left_anti")


def weighted_metrics(rows: DataFrame, score: str, positive: str, weight: str, by: Sequence[str]) -> DataFrame:
    """WIN6 for rows that count several times: (by, average_precision)."""
    blocks = rows.groupBy(*by, score).agg(F.sum(weight).alias("_m"), F.sum(F.when(F.col(positive), F.col(weight)).otherwise(0)).alias("_t"))
    part = Window.partitionBy(*by)
    down = part.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({"_tp": F.sum("_t").over(down), "_seen": F.sum("_m").over(down), "_p": F.sum("_t").over(part)})
    gain = F.when((F.col("_p") > 0) & (F.col("_seen") > 0), F.col("_t") / F.col("_p") * F.col("_tp") / F.col("_seen"))
    return blocks.groupBy(*by).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))
