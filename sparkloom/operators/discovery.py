"""The end of a discovery run: hubs and combinations, type flows, rules from a ranking, and what-if runs of rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dosing

#: Classes of signals, each with its names, a mark in the row's text (or none), and the behaviour they stand
#: for; the first class that fits counts. The second class gives its own behaviour to the names of ATTACK only.
CLASSES = [
    (["PDCD1", "CTLA4", "LAG3", "TIGIT"], "CHECKPOINT", "exhaustion"),
    (["GZMB", "PRF1", "IFNG", "CXCL9", "CXCL10"], "CD8", "migration"),
    (["TGFB1", "POSTN", "FN1", "COL1A1", "COL1A2"], "STROMAL", "transition"),
    (["EGF", "EREG", "AREG", "HGF", "VEGFA"], None, "migration"),
    (["MKI67", "TOP2A", "PCNA"], None, "proliferation"),
]
ATTACK = ["GZMB", "PRF1", "IFNG"]
FALLING = ["PDCD1", "CTLA4"]


def hubs(ranking: DataFrame, k: int = 30) -> DataFrame:
    """SRT8: the rows of the first k ranks, each gene once, at its best rank."""
    return ranking.orderBy("rank", "gene").limit(k).groupBy("gene").agg(F.min("rank").alias("rank"))


def combinations(results: DataFrame, k: int = 20) -> DataFrame:
    """SRT8: the first k rows of each trigger_target by place, with their order by score; results has also
    target_priority_score and a causal_edge."""
    first = Window.partitionBy("trigger_target").orderBy("place")
    top = results.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
    return top.withColumn("combo_rank", F.rank().over(Window.orderBy(F.col("target_priority_score").desc_nulls_last(), "trigger_target", "causal_edge")))


def edge_ends(edge: Column) -> tuple[Column, Column]:
    """SCA8: what is before and behind the first "->", or else the first arrow sign; the whole and "" without either."""
    def cut(mark: str) -> tuple[Column, Column]:
        return F.substring_index(edge, mark, 1), F.substr(edge, F.instr(edge, mark) + len(mark))

    (a, b), (c, d) = cut("->"), cut("→")
    ascii_arrow, arrow = F.contains(edge, F.lit("->")), F.contains(edge, F.lit("→"))
    return F.when(ascii_arrow, a).when(arrow, c).otherwise(edge), F.when(ascii_arrow, b).when(arrow, d).otherwise(F.lit(""))


def list_parts(text: Column, sep: str = ";") -> Column:
    """SCA8: the parts of a list that aren't empty; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), sep), lambda x: x != "")


def type_flow(flow: DataFrame, weight: str | None = None, score: str | None = None, delta: str | None = None) -> DataFrame:
    """AGG16: the summed products of the weights given, by source_type and target_type; only sums above 0.

    A null weight is 1, a null score 0, a null delta 0; scores count as at least 0 and deltas as at least 1e-6.
    """
    w = F.lit(1.0)
    if weight:
        w = w * F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    if score:
        w = w * F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    if delta:
        w = w * F.greatest(F.coalesce(F.col(delta).cast("double"), F.lit(0.0)), F.lit(1e-6))
    return flow.groupBy("source_type", "target_type").agg(F.sum(w).alias("flow")).filter("flow > 0")


def ranking_with_niches(ranking: DataFrame, niches: DataFrame, order: str) -> DataFrame:
    """JOI15: the ranking with each gene's first niche row by `order`; genes without one keep nulls.

    A null final_score stays and is last in the column place; niches: (gene, niche, order).
    """
    first = niches.groupBy("gene").agg(F.min_by("niche", order).alias("niche"))
    joined = ranking.join(first, "gene", "left")
    return joined.withColumn("place", F.row_number().over(Window.orderBy(F.col("final_score").desc_nulls_last(), "gene")))


def behavior(gene: Column, text: Column, has_edge: Column) -> Column:
    """GRA24: the behaviour that a signal stands for, from its name and the text of its row and edge."""
    name, words = F.upper(gene), F.upper(F.coalesce(text, F.lit("")))
    out = F.when(has_edge, "secretion").otherwise("transition")
    for names, mark, kind in reversed(CLASSES):
        fits = name.isin(names) if mark is None else name.isin(names) | F.contains(words, F.lit(mark))
        value = F.when(name.isin(ATTACK), "attack").otherwise(kind) if mark == "CD8" else F.lit(kind)
        out = F.when(fits, value).otherwise(out)
    return out


def rules_from_ranking(ranking: DataFrame, edges: DataFrame, max_rules: int = 30) -> DataFrame:
    """GRA24: one rule for each of the first genes: cell_type, signal, direction, behavior, response and its numbers.

    ranking: (gene, final_score, niche); edges: (ligand, receptor, source, target), of which a gene's is the first by
    source and target that names it, in any case. The cell type is the niche's, else the edge's source, else "TME_cell".
    """
    ends = edges.select(F.explode(F.array("ligand", "receptor")).alias("_g"), "source", "target").filter("_g is not null")
    index = ends.groupBy(F.upper("_g").alias("_g")).agg(F.min(F.struct("source", "target")).alias("_e"))
    first = ranking.filter(F.trim("gene") != "").orderBy(F.col("final_score").desc_nulls_last(), "gene").limit(max_rules)
    rows = first.join(index, F.upper(first["gene"]) == F.col("_g"), "left")
    score = F.coalesce(F.col("final_score"), F.lit(0.5))
    text = F.concat_ws(" ", "gene", "niche", F.col("_e.source"), F.col("_e.target"))
    rows = rows.withColumn("behavior", behavior(F.col("gene"), text, F.col("_e").isNotNull()))
    direction = F.when((F.col("behavior") != "exhaustion") & F.upper("gene").isin(FALLING), "decreases").otherwise("increases")
    rows = rows.withColumn("direction", direction)
    label = lambda c: F.nullif(F.trim(F.split(c, ";")[0]), F.lit(""))
    cell_type = F.coalesce(label(F.col("niche")), label(F.col("_e.source").cast("string")), F.lit("TME_cell"))
    base = F.when(F.col("direction") == "increases", 0.05).otherwise(0.15)
    top = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.35 + score))
    half = F.greatest(F.lit(0.05), 1 - F.least(score, F.lit(0.95)))
    return rows.select(cell_type.alias("cell_type"), F.col("gene").alias("signal"), "direction", "behavior", F.lit("hill").alias("response"), base.alias("base"), top.alias("saturation"), half.alias("half_max"), F.lit(2.0).alias("hill_power"))


def sensitivity(rules: DataFrame, signals: DataFrame, steps: int, dt: float, delta: float = 0.1) -> DataFrame:
    """GRA24: (rule, baseline, plus, minus, sensitivity) of each rule: the final population, summed over types, with the rule's
    saturation times 1 + delta and 1 - delta; sensitivity = (plus - minus) / (2 delta baseline).

    rules has columns rule (its key) and sign. Every variant of a rule is one more set of rules, all simulated at once.
    """
    if delta <= 0:
        raise ValueError("delta must be positive")
    keys = rules.select(F.col("rule").alias("_of"))
    kinds = F.explode(F.array(F.lit("plus"), F.lit("minus"))).alias("_kind")
    factor = F.when(F.col("rule") != F.col("_of"), 1.0).when(F.col("_kind") == "plus", 1.0 + delta).otherwise(max(0.0, 1.0 - delta))
    changed = rules.crossJoin(keys.select("_of", kinds)).withColumn("saturation", F.col("saturation") * factor)  # rules are few
    last = lambda df, *by: dosing.simulate(df, signals, steps, dt, by=by).filter(F.col("step") == steps).groupBy(*by).agg(F.sum("population").alias("n"))
    base = last(rules).select(F.greatest("n", F.lit(1e-12)).alias("baseline"))
    ends = last(changed, "_of", "_kind").groupBy(F.col("_of").alias("rule")).agg(*(F.max(F.when(F.col("_kind") == k, F.col("n"))).alias(k) for k in ("plus", "minus")))
    return ends.crossJoin(F.broadcast(base)).select("rule", "baseline", "plus", "minus", ((F.col("plus") - F.col("minus")) / (2 * delta * F.col("baseline"))).alias("sensitivity"))


def scenarios(rules: DataFrame, signals: DataFrame, overrides: Mapping[str, Mapping[str, float]], steps: int, dt: float) -> DataFrame:
    """GRA24: (scenario, cell_type, population) at the last step, signals being times the scenario's factors."""
    spark = rules.sparkSession
    factors = spark.createDataFrame([(s, g, float(f)) for s, by in overrides.items() for g, f in by.items()], "scenario string, signal string, _f double")
    names = spark.createDataFrame([(s,) for s in overrides], "scenario string")
    changed = signals.crossJoin(names).join(factors, ["scenario", "signal"], "left").withColumn("value", F.col("value") * F.coalesce("_f", F.lit(1.0))).drop("_f")
    return dosing.simulate(rules, changed, steps, dt, by=("scenario",)).filter(F.col("step") == steps).drop("step")
