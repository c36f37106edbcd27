"""Aggregation and statistics of sparse measurement triples (cell, gene, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pseudobulk(expr: DataFrame, cells: DataFrame, by: Sequence[str], *, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """AGG6: sums of each gene over the cells of a group, and the group's number of cells."""
    groups = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"))
    sums = expr.join(cells.select(cell, *by), cell).groupBy(*by, gene).agg(F.sum(value).alias("total"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    return sums.alias("s").join(groups.alias("g"), on).select(*(F.col(f"s.{c}") for c in by), gene, "total", "n_cells")


def log_normalized(rows: DataFrame, unit: Sequence[str], value: str, scale: float = 1e6, out: str = "log_value") -> DataFrame:
    """AGG7: log1p(value / library * scale); a library that isn't above 0 counts as 1.

    The library is an aggregate of its own, so that a unit with very many values isn't gathered in one task.
    """
    library = rows.groupBy(*unit).agg(F.sum(value).alias("_lib"))
    lib = F.when(F.col("_lib") > 0, F.col("_lib")).otherwise(1.0)
    return rows.join(library, list(unit)).withColumn(out, F.log1p(F.col(value) / lib * scale)).drop("_lib")


def group_means(expr: DataFrame, cells: DataFrame, group: str, *, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """AGG8: means over all cells of a group; a triple that is missing is a zero."""
    n = cells.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sums = expr.join(cells.select(cell, group), cell).groupBy(group, gene).agg(F.sum(value).alias("_s"))
    return sums.join(n, group).select(group, gene, (F.col("_s") / F.col("_n")).alias("mean"))


def effective_donors(cells: DataFrame, by: Sequence[str], donor: str = "donor") -> DataFrame:
    """AGG20: 1 / sum of squared donor shares, and the largest share."""
    counts = cells.groupBy(*by, donor).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.groupBy(*by).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.col("_n")).alias("_q"), F.max("_n").alias("_m"), F.count(F.lit(1)).alias("n_donors"))
    return out.select(*by, "n_donors", (F.col("_t") * F.col("_t") / F.col("_q")).alias("effective_donors"), (F.col("_m") / F.col("_t")).alias("max_share"))


def donor_direction(values: DataFrame, by: Sequence[str], *, donor: str = "donor", response: str = "response", value: str = "value", case: str, control: str) -> DataFrame:
    """AGG21: the share of (case donor, control donor) pairs whose difference of means has the overall sign.

    Pairs are not built: the donors' means are ranked together, and a case's rank among the controls counts its pairs.
    """
    means = values.filter(F.col(response).isin(case, control)).groupBy(*by, donor, response).agg(F.avg(value).alias("m"))
    per = means.groupBy(*by, "m").agg(F.count_if(F.col(response) == case).alias("_a"), F.count_if(F.col(response) == control).alias("_b"))
    up = Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_less", F.coalesce(F.sum("_b").over(up), F.lit(0)))
    out = per.groupBy(*by).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"), F.sum(F.col("_a") * F.col("_less")).alias("_up"), F.sum(F.col("_a") * F.col("_b")).alias("_tie"), (F.sum(F.col("m") * F.col("_a")) / F.nullif(F.sum("_a"), F.lit(0))).alias("_ma"), (F.sum(F.col("m") * F.col("_b")) / F.nullif(F.sum("_b"), F.lit(0))).alias("_mb"))
    pairs = F.col("_na") * F.col("_nb")
    agreeing = F.when(F.col("_ma") > F.col("_mb"), F.col("_up")).when(F.col("_ma") < F.col("_mb"), pairs - F.col("_up") - F.col("_tie")).otherwise(F.col("_tie"))
    return out.filter(pairs > 0).select(*by, pairs.alias("n_pairs"), (agreeing / pairs).alias("consistency"))


def signature_score(expr: DataFrame, cells: DataFrame, up: Sequence[str], down: Sequence[str], by: str, *, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """STA5: (mean of one gene set - mean of the other) / pooled deviation over all their values, zeros included.

    Values are log1p of what is above 0; the deviation is at least 1e-6; coverage is the share of the genes that occur.
    """
    n = cells.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    x = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    rows = expr.filter(F.col(gene).isin(*up, *down)).join(cells.select(cell, by), cell).select(by, gene, x.alias("x"), F.col(gene).isin(*up).alias("is_up"))
    found = expr.filter(F.col(gene).isin(*up, *down)).select(gene).distinct().agg(F.count_if(F.col(gene).isin(*up)).alias("n_up"), F.count_if(F.col(gene).isin(*down)).alias("n_down"))
    sums = rows.groupBy(by).agg(F.sum(F.when(F.col("is_up"), F.col("x"))).alias("_a"), F.sum(F.when(~F.col("is_up"), F.col("x"))).alias("_b"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    out = n.join(sums, by, "left").crossJoin(F.broadcast(found)).fillna(0.0, ["_a", "_b", "_s", "_q"])
    size = F.col("_n") * (F.col("n_up") + F.col("n_down"))
    a, b = F.col("_a") / (F.col("_n") * F.col("n_up")), F.col("_b") / (F.col("_n") * F.col("n_down"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / size - F.pow(F.col("_s") / size, F.lit(2.0))))
    return out.select(by, a.alias("mean_up"), b.alias("mean_down"), ((a - b) / F.greatest(deviation, F.lit(1e-6))).alias("score"), ((F.col("n_up") + F.col("n_down")) / F.lit(float(len(up) + len(down)))).alias("coverage"))


def status_band(score: Column, names: tuple[str, str] = ("up", "down"), limit: float = 0.3) -> tuple[Column, Column]:
    """SCA10: a status and its confidence from a score."""
    size = F.abs(score)
    status = F.when(score.isNull() | F.isnan(score), "Unknown").when(score >= limit, names[0]).when(score <= -limit, names[1]).otherwise("Unknown")
    sure = F.when(score.isNull() | F.isnan(score), "none").when(size < limit, "low").when(size >= 0.8, "high").when(size >= 0.5, "medium").otherwise("low")
    return status, sure


def welch(values: DataFrame, by: Sequence[str], group: str, value: str, case: str, control: str) -> DataFrame:
    """STA1: means, t and degrees of freedom of Welch's test; t is null where both variances are 0."""
    a, b = (F.when(F.col(group) == g, F.col(value)) for g in (case, control))
    out = values.groupBy(*by).agg(F.count(a).alias("n_case"), F.count(b).alias("n_control"), F.avg(a).alias("mean_case"), F.avg(b).alias("mean_control"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    out = out.filter("n_case > 1 and n_control > 1")
    p, q = F.col("_va") / F.col("n_case"), F.col("_vb") / F.col("n_control")
    t = F.when(p + q > 0, (F.col("mean_case") - F.col("mean_control")) / F.sqrt(p + q))
    dof = F.when(p + q > 0, (p + q) * (p + q) / (p * p / (F.col("n_case") - 1) + q * q / (F.col("n_control") - 1)))
    return out.select(*by, "n_case", "n_control", "mean_case", "mean_control", t.alias("t"), dof.alias("dof"))


def rank_sum(values: DataFrame, by: Sequence[str], group: str, value: str, case: str, control: str, ties: bool = False) -> DataFrame:
    """STA2: Mann-Whitney U of the cases, with the tie-corrected, continuity-corrected z of the larger U.

    Values are counted first, so that the ordered window holds distinct values only.
    """
    rows = values.filter(F.col(group).isin(case, control))
    per = rows.groupBy(*by, value).agg(F.count_if(F.col(group) == case).alias("_a"), F.count(F.lit(1)).alias("_m"))
    return rank_sum_of_counts(per, by, value, ties)


def rank_sum_of_counts(per: DataFrame, by: Sequence[str], value: str, ties: bool = False) -> DataFrame:
    """STA2 of counted values: (by, value, _a of the cases, _m in all); with ties a column tells whether values are equal."""
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_rank", F.coalesce(F.sum("_m").over(before), F.lit(0)) + (F.col("_m") + 1) / 2.0)
    m = F.col("_m").cast("double")
    out = per.groupBy(*by).agg(F.sum("_a").alias("n_case"), F.sum("_m").alias("_n"), F.sum(F.col("_a") * F.col("_rank")).alias("_r"), F.sum(m * m * m - m).alias("_t"))
    n1, n = F.col("n_case").cast("double"), F.col("_n").cast("double")
    n2 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    out = out.filter((F.col("n_case") > 0) & (F.col("_n") > F.col("n_case")) & (F.col("_n") > 1))
    z = F.when(spread > 0, (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread)
    return out.select(*by, "n_case", (F.col("_n") - F.col("n_case")).alias("n_control"), u.alias("u"), z.alias("z"), *([(F.col("_t") > 0).alias("ties")] if ties else []))


def standardize(rows: DataFrame, control: Column, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """SCA12: (x - mean) / deviation, both of control rows only; a deviation of at most 1e-6 counts as 1."""
    stats = rows.filter(control).groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_d"))
    d = F.when(F.col("_d") > 1e-6, F.col("_d")).otherwise(1.0)
    return rows.join(stats, list(by)).withColumn(out, (F.col(value) - F.col("_m")) / d).drop("_m", "_d")


def robust_scale(rows: DataFrame, by: Sequence[str], value: str, out: str = "scaled") -> DataFrame:
    """SCA13: (x - 5th percentile) / (95th - 5th) held to [0, 1]; 0 where they are equal."""
    q = rows.groupBy(*by).agg(F.percentile(value, 0.05).alias("_a"), F.percentile(value, 0.95).alias("_b"))
    scaled = F.when(F.col("_b") > F.col("_a"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))))).otherwise(0.0)
    return rows.join(q, list(by)).withColumn(out, scaled).drop("_a", "_b")


def top_variable(rows: DataFrame, context: str, gene: str, value: str, k: int) -> DataFrame:
    """SRT6: the k genes of the largest mean, over contexts, of population variance."""
    per = rows.groupBy(context, gene).agg(F.var_pop(value).alias("v"))
    return per.groupBy(gene).agg(F.avg("v").alias("variance")).orderBy(F.col("variance").desc(), F.col(gene)).limit(k)


def variable_genes(rows: DataFrame, gene: str, value: str, k: int, bins: int = 20, force: Sequence[str] = ()) -> DataFrame:
    """STA20: the k genes of the largest dispersion, normalised within bins of the mean; forced genes come besides."""
    stats = rows.groupBy(gene).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("v")).filter("mean > 0")
    stats = stats.withColumn("dispersion", F.col("v") / F.col("mean"))
    ends = stats.agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    stats = stats.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("mean") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0).cast("int"))
    per = stats.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_d"))
    z = F.when(F.col("_d") > 0, (F.col("dispersion") - F.col("_m")) / F.col("_d")).otherwise(1.0)
    scored = stats.join(F.broadcast(per), "bin").select(gene, F.round(z, 9).alias("dispersion_z"))
    top = scored.orderBy(F.col("dispersion_z").desc(), F.col(gene)).limit(k)
    return top if not force else top.union(scored.filter(F.col(gene).isin(*force)).join(top.select(gene), gene, "left_anti"))


def fallback_score(rows: DataFrame, gene: str, value: str) -> DataFrame:
    """SRT10: mean absolute value plus sample variance."""
    return rows.groupBy(gene).agg((F.avg(F.abs(value)) + F.coalesce(F.var_samp(value), F.lit(0.0))).alias("score"))


def agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """STA6: Pearson, RMSE and R2 of b against a, and Pearson under weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    x, y = F.col(a), F.col(b)
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), F.sum((x - y) * (x - y)).alias("_res"), F.var_pop(x).alias("_v"), F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"), F.sum(w * x * y).alias("_xy"))
    cx, cy = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_w"), F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_w")
    weighted = F.when((cx > 1e-12) & (cy > 1e-12), (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_w")) / F.sqrt(cx * cy)).otherwise(0.0)
    return out.select(*by, "n", "pearson", "rmse", F.when(F.col("_v") > 0, 1 - F.col("_res") / (F.col("_v") * F.col("n"))).alias("r2"), weighted.alias("weighted_pearson"))


def spearman(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """STA6: Pearson of average ranks."""
    def ranked(df: DataFrame, c: str, out: str) -> DataFrame:
        counts = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_m"))
        before = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.select(*by, c, (F.coalesce(F.sum("_m").over(before), F.lit(0)) + (F.col("_m") + 1) / 2.0).alias(out))
        return df.join(ranks, [*by, c])

    return ranked(ranked(pairs, a, "_ra"), b, "_rb").groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def direction_accuracy(pairs: DataFrame, observed: str, predicted: str, expected: str, by: Sequence[str] = ()) -> DataFrame:
    """STA7: share of rows whose change has the expected sign; no change counts as a fall."""
    sign = F.when(F.col(predicted) > F.col(observed), 1).otherwise(-1)
    return pairs.groupBy(*by).agg(F.avg((sign == F.col(expected)).cast("double")).alias("direction_accuracy"))


def log_linear_decay(rows: DataFrame, distance: str, effect: str, by: Sequence[str] = ()) -> DataFrame:
    """STA8: slope, length -1 / slope (0 where it rises) and R2 of log effect on distance; 0 under three effects."""
    x, y = F.col(distance), F.log(F.col(effect))
    out = rows.filter(F.col(effect) > 1e-12).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_s"), F.regr_r2(y, x).alias("_r"))
    slope = F.coalesce("_s", F.lit(0.0))
    length = F.when((F.col("n") >= 3) & (slope < -1e-12), -1.0 / slope).otherwise(0.0)
    return out.select(*by, "n", F.when(F.col("n") >= 3, slope).otherwise(0.0).alias("slope"), length.alias("length"), F.when(F.col("n") >= 3, F.coalesce("_r", F.lit(0.0))).otherwise(0.0).alias("r2"))
