"""Doses, responses, combinations, time lags, and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hill(c: Column, emax: float, ec50: float, power: float) -> Column:
    """SCA1: emax c^h / (ec50^h + c^h), held to [0, emax]."""
    p = F.pow(c, F.lit(float(power)))
    return F.least(F.lit(float(emax)), F.greatest(F.lit(0.0), emax * p / (ec50**power + p + 1e-12)))


def response(x: Column, kind: Column, direction: Column, base: Column, top: Column, half: Column, power: Column) -> Column:
    """SCA1: a rule's response to a signal; falling step responses turn the comparison, not the range."""
    v = F.greatest(x, F.lit(0.0))
    p = F.pow(v, power)
    falls = direction == "decreases"
    part = F.when(kind == "hill", p / (F.pow(half, power) + p + 1e-12)).when(kind == "linear", F.least(F.lit(1.0), v / half)).otherwise(F.when(falls, (v < half).cast("double")).otherwise((v >= half).cast("double")))
    return F.when(~falls | (kind == "step"), base + (top - base) * part).otherwise(top - (top - base) * part)


def concentration(dose: Column, t: Column, ka: float, ke: float, vd: float, f: float) -> Column:
    """SCA2: one-compartment oral concentration, at least 0."""
    return F.greatest(F.lit(0.0), f * dose * ka / max(vd * (ka - ke), 1e-8) * (F.exp(-ke * t) - F.exp(-ka * t)))


def pk_grid(doses: DataFrame, times: Sequence[float], *, ka: float = 1.2, ke: float = 0.18, vd: float = 1.0, f: float = 1.0) -> DataFrame:
    """SCA2: (dose, i, t, concentration) over a grid of times."""
    grid = doses.select("dose", F.posexplode(F.array(*(F.lit(float(t)) for t in times))).alias("i", "t"))
    return grid.withColumn("concentration", concentration(F.col("dose"), F.col("t"), ka, ke, vd, f))


def dose_summary(grid: DataFrame, emax: float, ec50: float, power: float) -> DataFrame:
    """WIN12: areas by the trapezoid rule with unit steps, largest and mean effect of each dose."""
    w = Window.partitionBy("dose").orderBy("i")
    rows = grid.withColumn("effect", hill(F.col("concentration"), emax, ec50, power))
    rows = rows.withColumns({f"_{c}": (F.col(c) + F.lag(c).over(w)) / 2 for c in ("concentration", "effect")})
    return rows.groupBy("dose").agg(F.sum("_concentration").alias("auc_concentration"), F.sum("_effect").alias("auc_effect"), F.max("effect").alias("max_effect"), F.avg("effect").alias("mean_effect"))


def bliss_excess(a: Column, b: Column, ab: Column) -> Column:
    """SCA3: what a pair's effect exceeds that of independent action by."""
    return ab - (a + b - a * b)


def bliss_effect(effects: Column) -> Column:
    """SCA3: 1 - product of (1 - effect) over an array."""
    return 1 - F.aggregate(effects, F.lit(1.0), lambda s, x: s * (1 - x))


def rank_combinations(effects: DataFrame, combos: DataFrame) -> DataFrame:
    """SRT4: combos (combo array, size) of names with effects (name, effect), by effect and excess, then by name."""
    parts = combos.select("combo", "size", F.posexplode("combo").alias("_i", "name")).join(effects, "name").groupBy("combo", "size").agg(F.array_sort(F.collect_list(F.struct("_i", "effect"))).alias("_e")).withColumn("_e", F.col("_e.effect"))
    e = bliss_effect(F.col("_e"))
    out = parts.select(F.array_join("combo", "+").alias("combo"), "size", F.round(e, 9).alias("effect"), F.when(F.col("size") == 2, F.round(bliss_excess(F.get("_e", F.lit(0)), F.get("_e", F.lit(1)), e), 9)).otherwise(0.0).alias("excess"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("effect").desc(), F.col("excess").desc(), "combo")).cast("bigint"))


def effect_summary(rows: DataFrame, gene: str = "gene", dose: str = "dose", effect: str = "effect_size") -> DataFrame:
    """AGG11: rows, mean, population deviation, and the mean by dose (a map) of each gene."""
    by_dose = rows.groupBy(gene, dose).agg(F.avg(effect).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(effect).alias("s"), F.sum(F.col(effect) * F.col(effect)).alias("q"))
    out = by_dose.groupBy(gene).agg(F.sum("n").alias("n_rows"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(dose).alias("dose"), F.col("m").alias("mean"))))).alias("dose_effect"))
    mean = F.col("_s") / F.col("n_rows")
    return out.select(gene, "n_rows", mean.alias("mean_effect"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("n_rows") - mean * mean)).alias("std_effect"), "dose_effect")


def calibrate(summary: DataFrame) -> DataFrame:
    """AGG12: emax, the mean size of effects, in [0.1, 2], and ec50, the mean of the doses next to half of each gene's
    largest effect (the lower of equals), in [0.05, 20]; 1 and 1 without genes."""
    entries = F.transform(F.map_entries("dose_effect"), lambda x: F.struct(x["key"].cast("double").alias("dose"), F.abs(x["value"]).alias("e")))
    rows = summary.select(F.abs("mean_effect").alias("m"), entries.alias("x")).withColumn("half", 0.5 * F.array_max(F.col("x.e")))
    rows = rows.select("m", F.array_min(F.transform("x", lambda v: F.struct(F.round(F.abs(v["e"] - F.col("half")), 9).alias("d"), v["dose"].alias("dose"))))["dose"].alias("dose"))
    held = lambda c, lo, hi: F.when(F.count(c) == 0, 1.0).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), F.avg(c))))
    return rows.agg(held("m", 0.1, 2.0).alias("emax"), held("dose", 0.05, 20.0).alias("ec50"))


def lagged_graph(series: DataFrame, max_lag: int, threshold: float) -> DataFrame:
    """WIN7: (a, b, lag, r) for ordered pairs of series whose best |corr(a[t], b[t + lag])| reaches the threshold.

    series: (name, t, value) with consecutive t. Of equal sizes the smaller lag counts.
    """
    a = series.select(F.col("name").alias("a"), "t", F.col("value").alias("x"))
    b = series.select(F.col("name").alias("b"), F.col("t").alias("_t"), F.col("value").alias("y"))
    lags = b.select("b", "y", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "_t").withColumn("t", F.col("_t") - F.col("lag")).drop("_t")
    pairs = a.join(lags, "t").filter("a <> b").groupBy("a", "b", "lag").agg(F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"))
    size = F.when((F.col("dx") >= 1e-12) & (F.col("dy") >= 1e-12), F.round(F.abs("r"), 9)).otherwise(0.0)
    best = pairs.withColumn("r", size).groupBy("a", "b").agg(F.max_by(F.struct("lag", "r"), F.struct("r", (-F.col("lag")).alias("l"))).alias("m"))
    return best.select("a", "b", "m.lag", "m.r").filter((F.col("r") >= threshold) & (F.col("r") > 0))


_NUMBER = r"\s+([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
STATEMENT = r"(?i)^\s*in\s+(.+?)\s+cells,\s+(.+?)\s+(increases|decreases)\s+(.+?)\s+with\s+an?\s+(hill|linear|step)\s+response"


def parse_rules(rules: DataFrame, statement: str = "statement") -> DataFrame:
    """SCA7: the parts of "In X cells, Y increases Z with a hill response, base .., max .., half-max .., hill .."."""
    s = F.col(statement)
    part = lambda i: F.regexp_extract(s, STATEMENT, i)
    # the last hill that is followed by a number is the power; "hill response" has none
    number = lambda names, default: F.coalesce(F.nullif(F.regexp_extract(s, rf"(?i)(?:{names}){_NUMBER}", 1), F.lit("")).cast("double"), F.lit(default))
    return rules.withColumns({"cell_type": part(1), "signal": part(2), "direction": F.lower(part(3)), "behavior": part(4), "response": F.lower(part(5)), "base": number("base", 0.0), "saturation": number(r"(?<![-_ ])max|saturation|, max", 1.0), "half_max": number(r"half[-_ ]max", 0.5), "hill_power": number(r"hill(?:[_ ]power)?", 1.0)})


def render_rules(rules: DataFrame, out: str = "statement") -> DataFrame:
    """SCA7: the sentence of parsed parts, numbers without trailing zeros."""
    number = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.col(c)), r"0+$", ""), r"\.$", "")
    return rules.withColumn(out, F.concat(F.lit("In "), "cell_type", F.lit(" cells, "), "signal", F.lit(" "), "direction", F.lit(" "), "behavior", F.lit(" with a "), "response", F.lit(" response, base "), number("base"), F.lit(", max "), number("saturation"), F.lit(", half-max "), number("half_max"), F.lit(", hill "), number("hill_power")))


def simulate(rules: DataFrame, signals: DataFrame, steps: int, dt: float, by: Sequence[str] = ()) -> DataFrame:
    """WIN11: (by, cell_type, step, population) under each type's rules, one after another in every step.

    rules: parsed rules with a sign column; signals: (cell_type, signal, value); either may have the columns `by`, variants
    that are simulated apart. A step multiplies a population by max(0, 1 + rate dt) for each rule, so after n steps it is
    the product's n-th power, and nothing is iterated.
    """
    shared = [c for c in by if c in rules.columns and c in signals.columns]
    both = rules.join(signals, ["cell_type", "signal", *shared])
    rate = response(F.col("value"), F.col("response"), F.col("direction"), F.col("base"), F.col("saturation"), F.col("half_max"), F.col("hill_power")) * F.col("sign")
    growth = both.groupBy(*by, "cell_type").agg(F.product(F.greatest(F.lit(0.0), 1.0 + rate * dt)).alias("_g"))
    grid = growth.select(*by, "cell_type", "_g", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    return grid.select(*by, "cell_type", "step", F.pow("_g", F.col("step").cast("double")).alias("population"))
