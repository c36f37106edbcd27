"""Rules of a study as columns: contracts, data scopes, protocol states, readiness, abundance tables, identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each phase may do with each scope; all else is refused.
SCOPES = {("pilot", "train"): "fit_allowed", ("pilot", "tune"): "selection_allowed", ("release", "train"): "fit_allowed", ("release", "tune"): "frozen_selection_evidence_only", ("release", "release_holdout"): "score_once_only"}
REDESIGN, FREEZE = "redesign_after_pilot_failure", "freeze_release"


def scope_decision(phase: Column, scope: Column, operation: Column) -> Column:
    """EVD12: what a phase may do with a scope of the data, or "refused"; a release's holdout is for scoring alone."""
    out = F.lit("refused")
    for (p, s), allowed in SCOPES.items():
        fits = (phase == p) & (scope == s)
        out = F.when(fits & (operation == "score") if s == "release_holdout" else fits, allowed).otherwise(out)
    return out


def protocol_states(events: DataFrame, run: str = "run", order: str = "seq", event: str = "event") -> DataFrame:
    """EVD12: (run, phase, redesigns, refused_at) after a run's events, taken in order up to the first that is refused.

    A run starts as a pilot. It may be redesigned once as such; freezing makes it release_ready; everything else, and
    anything after that, is refused. refused_at is the order of the refused event, null without one.
    """
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = lambda kind: F.coalesce(F.count_if(F.col(event) == kind).over(before), F.lit(0))
    rows = events.withColumns({"_r": n(REDESIGN), "_f": n(FREEZE)})
    bad = F.when(F.col(event) == REDESIGN, (F.col("_f") > 0) | (F.col("_r") > 0)).when(F.col(event) == FREEZE, F.col("_f") > 0).otherwise(True)
    first = rows.withColumn("_bad", bad).groupBy(run).agg(F.min(F.when(F.col("_bad"), F.col(order))).alias("refused_at"))
    taken = events.join(first, run).filter(F.col("refused_at").isNull() | (F.col(order) < F.col("refused_at")))
    counts = taken.groupBy(run).agg(F.count_if(F.col(event) == REDESIGN).alias("redesigns"), F.count_if(F.col(event) == FREEZE).alias("_f"))
    out = first.join(counts, run, "left")
    return out.select(run, F.when(F.coalesce("_f", F.lit(0)) > 0, "release_ready").otherwise("pilot").alias("phase"), F.coalesce("redesigns", F.lit(0)).cast("bigint").alias("redesigns"), "refused_at")


def contract_issues(tasks: DataFrame, metrics: Mapping[str, str], least_seeds: int = 3) -> DataFrame:
    """EVD12: tasks with their issues, an array of names, empty where a task keeps the contract.

    tasks: (task, title, metric, direction, baselines, seeds, min_coverage, max_abstention, external_holdout, improvement);
    metrics: the direction that each task's metric must have.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    share = lambda c: ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    wanted = F.create_map(*(F.lit(x) for kv in metrics.items() for x in kv))
    checks = [
        (blank("title"), "title"),
        (~F.coalesce(F.col("direction").isin("maximize", "minimize"), F.lit(False)), "direction"),
        (~F.coalesce(F.get(F.map_values(F.map_filter(wanted, lambda k, v: k == F.col("metric"))), F.lit(0)) == F.col("direction"), F.lit(False)), "metric"),
        (F.coalesce(F.size("baselines"), F.lit(0)) < 1, "baselines"),
        (F.coalesce(F.size(F.array_distinct("seeds")), F.lit(0)) < least_seeds, "seeds"),
        (F.coalesce(F.size(F.array_distinct("seeds")), F.lit(0)) != F.coalesce(F.size("seeds"), F.lit(0)), "repeated_seeds"),
        (share("min_coverage"), "min_coverage"),
        (share("max_abstention"), "max_abstention"),
        (~F.coalesce("external_holdout", F.lit(False)), "external_holdout"),
        (F.col("improvement").isNull() | F.isnan("improvement") | (F.abs("improvement") == float("inf")), "improvement"),
    ]
    return tasks.withColumn("issues", F.array_compact(F.array(*(F.when(c, n) for c, n in checks))))


def readiness(statuses: DataFrame, registry: Sequence[str], core: Sequence[str], interventional: Sequence[str], final: Sequence[str], gates: Mapping[str, bool], passed: str = "passed") -> DataFrame:
    """EVD13: one row: whether the core methods and one interventional method passed, whether exactly the registry is
    classified with final statuses, the given gates, and ready where all hold. statuses: (method, status)."""
    own = statuses.agg(
        (F.count_distinct(F.when(F.col("method").isin(*core) & (F.col("status") == passed), F.col("method"))) == len(set(core))).alias("core_methods"),
        (F.count_if(F.col("method").isin(*interventional) & (F.col("status") == passed)) > 0).alias("interventional_method"),
        ((F.count_distinct(F.when(F.col("method").isin(*registry), F.col("method"))) == len(set(registry))) & (F.count_if(~F.col("method").isin(*registry) | ~F.coalesce(F.col("status").isin(*final), F.lit(False))) == 0)).alias("all_methods_classified"),
    )
    out = own.withColumns({k: F.lit(v) for k, v in gates.items()})
    ready = F.lit(True)
    for c in out.columns:
        ready = ready & F.col(c)
    return out.withColumn("ready", ready)


def paired_collection(runs: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """EVD13: (method, missing, repeated, unexpected, complete) of each method's runs against the expected seeds."""
    per = runs.groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("seed").isin(*seeds)
    out = per.groupBy("method").agg((F.lit(len(set(seeds))) - F.count_if(known)).cast("bigint").alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~known).alias("unexpected"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("unexpected") == 0))


def doublet_weights(rows: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """EVD16: (spot, label, weight): a doublet with a known second label counts half for each, else the first counts whole.

    rows: (spot, first, second, kind), a kind that holds "doublet" in any case being one.
    """
    split = F.contains(F.lower(F.coalesce("kind", F.lit(""))), F.lit("doublet")) & (F.coalesce("second", F.lit(unknown)) != unknown)
    parts = F.array(F.struct(F.col("first").alias("label"), F.when(split, 0.5).otherwise(1.0).alias("weight")), F.struct(F.col("second").alias("label"), F.when(split, 0.5).otherwise(0.0).alias("weight")))
    return rows.select("spot", F.explode(parts).alias("p")).select("spot", "p.label", "p.weight").filter("weight > 0")


def abundance(weights: DataFrame, labels: Sequence[str]) -> DataFrame:
    """EVD16: one row for each spot with a column for each of the labels, the sum of its weights, 0 without any."""
    return weights.groupBy("spot").pivot("label", list(labels)).agg(F.sum("weight")).fillna(0.0)


def platform_audit(platforms: DataFrame, units: DataFrame, features: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """EVD17: one row for each declared platform: what it has, how many samples and units, and the wanted features it covers.

    platforms: (platform); units: (platform, sample, x, y, label); features: (platform, name), compared in upper case.
    """
    own = units.groupBy("platform").agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct("sample").alias("n_samples"), F.bool_or(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("has_coordinates"), F.bool_or(F.col("label").isNotNull()).alias("has_labels"))
    genes = features.select("platform", F.upper("name").alias("n")).filter(F.col("n").isin(*(w.upper() for w in wanted))).groupBy("platform").agg(F.array_join(F.array_sort(F.collect_set("n")), ";").alias("covered"))
    out = platforms.join(own, "platform", "left").join(genes, "platform", "left")
    return out.select("platform", (F.coalesce("n_units", F.lit(0)) > 0).alias("has_data"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_units", "n_samples")), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_coordinates", "has_labels")), F.coalesce("covered", F.lit("")).alias("covered"))


def canonical_json(*columns: str) -> Column:
    """SCA9: the columns as one JSON object without spaces, keys in order, nulls kept.

    Text, whole numbers, booleans and arrays of these have one form on every engine; a double has Spark's, so a hash over
    it holds within Spark.
    """
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_sha256(*columns: str) -> Column:
    """SCA9: the SHA-256 of canonical_json, as hex."""
    return F.sha2(canonical_json(*columns), 256)


def forbidden_issues(config: Mapping, keys: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """FIL14: what a run's configuration may not hold: lists of names under the keys, and paths whose file name starts with
    one of the prefixes, at any depth."""
    out = []

    def walk(value, at: str) -> None:
        if isinstance(value, Mapping):
            for k, v in value.items():
                if k in keys and v:
                    out.append(f"{at}{k}: names given by hand")
                walk(v, f"{at}{k}.")
        elif isinstance(value, (list, tuple)):
            for i, v in enumerate(value):
                walk(v, f"{at}{i}.")
        elif isinstance(value, str) and value.rsplit("/", 1)[-1].startswith(tuple(prefixes)):
            out.append(f"{at.rstrip('.')}: a result file: {value}")

    walk(config, "")
    return out
