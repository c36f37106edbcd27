"""Candidate pools from several sources, evidence-gated ranks, and metrics of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import least_from, running

#: Parts of the legacy weighted sum.
LEGACY_WEIGHTS = {"causal": 0.25, "spatial": 0.25, "consistency": 0.25, "actionability": 0.10, "niche": 0.15}


def minmax(value: Column, *by: str) -> Column:
    """WIN3: scaled to [0, 1] over the group, 0 where the range is at most 1e-12."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo > 1e-12, (value - lo) / (hi - lo)).otherwise(0.0)


def minmax_by(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """WIN3 over a whole table: one aggregate row is joined back, so that no window gathers all rows in a task."""
    stats = df.agg(*(f(c).alias(f"_{side}_{n}") for n, c in columns.items() for side, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {n: F.when(F.col(f"_hi_{n}") - F.col(f"_lo_{n}") > 1e-12, (c - F.col(f"_lo_{n}")) / (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).otherwise(0.0) for n, c in columns.items()}
    return out.withColumns(scaled).drop(*stats.columns)


def candidate_pool(effects: DataFrame, *, gene: str = "gene", source: str = "source", group: str = "cell_type", effect: str = "effect", p: str = "p", sources: Sequence[str], p_sources: Sequence[str] | None = None, focus: Sequence[str] = ()) -> DataFrame:
    """AGG5: one row for each gene over effects of several sources.

    A source counts if the gene has a group there. The majority sign is that of the sum of signs; the consistency is
    the part of effects with it, 0.5 if signs cancel, 0 without effects. A missing p is 1. Null and NaN effects are
    left out; empty genes and those named "nan" or "None" are dropped.
    """
    x = F.when(~F.isnan(F.col(effect)), F.col(effect).cast("double"))
    q = F.when(~F.isnan(F.col(p)), F.col(p).cast("double"))
    if p_sources is not None:
        q = F.when(F.col(source).isin(*p_sources), q)
    rows = effects.filter(F.col(gene).isNotNull() & ~F.col(gene).isin("", "nan", "None"))
    rows = rows.select(F.col(gene).alias("gene"), F.col(source).alias("_s"), F.col(group).alias("_g"), x.alias("_x"), q.alias("_q"))
    sign = F.signum("_x")
    counts = [F.count_distinct(F.when(F.col("_s") == s, F.col("_g"))).alias(f"n_groups_{s}") for s in sources]
    names = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("_s") == s, F.col("_g")))), ";").alias(f"groups_{s}") for s in sources]
    # sums of signs and counts by sign are enough for the consistency, so that one aggregation does all
    pool = rows.groupBy("gene").agg(*counts, *names, F.avg("_x").alias("mean_effect"), F.avg(F.abs("_x")).alias("mean_abs_effect"), F.min("_q").alias("min_p"), F.sum(sign).alias("_sum"), F.count_if(F.col("_x") > 0).alias("_pos"), F.count_if(F.col("_x") < 0).alias("_neg"), F.count("_x").alias("_n"))
    consistency = F.when(F.col("_n") == 0, 0.0).when(F.col("_sum") > 0, F.col("_pos") / F.col("_n")).when(F.col("_sum") < 0, F.col("_neg") / F.col("_n")).otherwise(0.5)
    support = sum((F.when(F.col(f"n_groups_{s}") > 0, 1).otherwise(0) for s in sources), F.lit(0))
    return pool.withColumns({"source_count": support, "direction_consistency": consistency, "mean_effect": F.coalesce("mean_effect", F.lit(0.0)), "mean_abs_effect": F.coalesce("mean_abs_effect", F.lit(0.0)), "min_p": F.coalesce("min_p", F.lit(1.0)), "is_focus": F.col("gene").isin(*focus) if focus else F.lit(False)}).withColumn("neg_log10_p", -F.log10(F.greatest(F.col("min_p"), F.lit(1e-300)))).drop("_sum", "_pos", "_neg", "_n")


def initial_score(pool: DataFrame, first: str, last: str) -> DataFrame:
    """The display score of a fresh pool: 2 * sources + 1.5 * effect + 1.5 * significance + consistency + half the spans of two sources."""
    scaled = minmax_by(pool, {"_e": F.col("mean_abs_effect"), "_p": F.col("neg_log10_p"), "_a": F.col(f"n_groups_{first}").cast("double"), "_b": F.col(f"n_groups_{last}").cast("double")})
    return scaled.withColumn("init_score", F.col("source_count") * 2.0 + F.col("_e") * 1.5 + F.col("_p") * 1.5 + F.col("direction_consistency") + F.col("_a") * 0.5 + F.col("_b") * 0.5).drop("_e", "_p", "_a", "_b")


def support_tier(count: Column) -> Column:
    """SCA10."""
    return F.when(count >= 3, "three_source").when(count == 2, "two_source").when(count == 1, "single_source").otherwise("unknown")


def evidence_gated_rank(pool: DataFrame) -> DataFrame:
    """SRT1 and WIN2: ranks by sources, consistency, significance and effect, all downwards, then by name.

    final_score shows the rank as (n - rank + 1) / n; nothing else enters it.
    """
    order = [F.col("source_count").desc(), F.col("direction_consistency").desc(), F.col("neg_log10_p").desc(), F.col("mean_abs_effect").desc(), F.col("gene").asc()]
    ranked = pool.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    n = pool.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("final_score", (F.col("_n") - F.col("rank") + 1) / F.col("_n")).withColumn("support_tier", support_tier(F.col("source_count"))).drop("_n")


def legacy_rank(pool: DataFrame, parts: dict[str, str], weights: dict[str, float] = LEGACY_WEIGHTS) -> DataFrame:
    """SRT2: the weighted sum of parts (weight's name to column), ranked downwards, then by name."""
    score = sum((F.lit(weights[k]) * F.col(c) for k, c in parts.items()), F.lit(0.0))
    scored = pool.withColumn("final_score", score)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("final_score").desc(), F.col("gene").asc())).cast("bigint"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, name: str = "group_rank") -> DataFrame:
    """WIN1 and WIN8: ranks within groups; the first k where k is given. Spark keeps k rows a group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """WIN4: q = min over p' >= p of p' * n / rank. Null and NaN p are 1.

    Equal p have the rank of the last of them, so only distinct p are ordered, and those by buckets of a group.
    """
    v = F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0))
    rows = df.withColumn("_p", v)
    counts = rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_m"))
    ranked = running(counts, "_p", {"_rank": "_m"}, by)
    total = F.broadcast(counts.agg(F.sum("_m").alias("_n"))) if not by else counts.groupBy(*by).agg(F.sum("_m").alias("_n"))
    ranked = ranked.crossJoin(total) if not by else ranked.join(total, list(by))
    done = least_from(ranked.withColumn("_raw", F.col("_p") * F.col("_n") / F.col("_rank")), "_p", "_raw", out, by)
    done = done.select(F.col("_p").alias("_p2"), F.least(F.lit(1.0), out).alias(out), *(F.col(c).alias(f"_by_{c}") for c in by))
    on = F.col("_p") == F.col("_p2")
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    return rows.join(done, on).select(*df.columns, out)


def holm(df: DataFrame, p: str, by: Sequence[str], order: Sequence[Column], out: str = "adjusted_p") -> DataFrame:
    """WIN5: step-down adjustment within groups of claims; ties are ordered by `order`."""
    w = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), (m - F.col("_rk") + 1) * F.col(p))
    return df.withColumn("_rk", F.row_number().over(w)).withColumn("_raw", raw).withColumn(out, F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_rk", "_raw")


def ranking_metrics(scored: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """WIN6 and EVD2: n, positives, prevalence, average precision and AUROC, ties as blocks.

    Rows are first counted by score, so that the ordered window holds distinct scores only. Average precision adds
    each block's gain of recall times the precision behind it; AUROC is null where one class is missing.
    """
    blocks = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_m"), F.count_if(F.col(positive)).alias("_t"))
    part = Window.partitionBy(*by) if by else Window.partitionBy()
    down = part.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({"_tp": F.sum("_t").over(down), "_seen": F.sum("_m").over(down), "_p": F.sum("_t").over(part), "_all": F.sum("_m").over(part)})
    gain = F.when(F.col("_p") > 0, F.col("_t") / F.col("_p") * F.col("_tp") / F.col("_seen"))
    below = F.col("_all") - F.col("_seen") - (F.col("_p") - F.col("_tp"))  # negatives that score less
    area = F.col("_t") * (below + (F.col("_m") - F.col("_t")) / 2.0)
    out = blocks.groupBy(*by).agg(F.sum("_m").alias("n"), F.sum("_t").alias("positives"), F.sum(gain).alias("average_precision"), F.sum(area).alias("_area"))
    negatives = F.col("n") - F.col("positives")
    return out.withColumns({"prevalence": F.col("positives") / F.col("n"), "average_precision": F.coalesce("average_precision", F.lit(0.0)), "auroc": F.when((F.col("positives") > 0) & (negatives > 0), F.col("_area") / (F.col("positives") * negatives))}).drop("_area")


def precision_at_k(scored: DataFrame, score: str, positive: str, names: Sequence[str], k: int) -> DataFrame:
    """SRT5: the first k by score and names, and the expectation if ties at the cut were drawn."""
    top = scored.orderBy(F.col(score).desc(), *(F.col(c).asc() for c in names)).limit(k)
    first = top.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(positive)).alias("hits"), F.min(score).alias("_cut"))
    above, tied = F.col(score) > F.col("_cut"), F.col(score) == F.col("_cut")
    out = scored.crossJoin(F.broadcast(first)).groupBy("k", "hits").agg(F.count_if(above).alias("_a"), F.count_if(above & F.col(positive)).alias("_ap"), F.count_if(tied).alias("_t"), F.count_if(tied & F.col(positive)).alias("_tp"))
    return out.select("k", (F.col("hits") / F.col("k")).alias("precision"), ((F.col("_ap") + (F.col("k") - F.col("_a")) * F.col("_tp") / F.col("_t")) / F.col("k")).alias("tie_aware_precision"))


def position_score(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """WIN9: the number of rows in the group less the row's place, counted from 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("position_score", (n - (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)).cast("bigint"))


def first_targets(ranking: DataFrame, expressed: DataFrame, k: int) -> DataFrame:
    """SRT7: the k best ranked genes that are expressed, each once."""
    return ranking.join(expressed.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg(F.min("rank").alias("rank")).orderBy("rank", "gene").limit(k)
