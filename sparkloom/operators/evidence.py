"""Evidence tables: intervention effects, splits, stability, null controls, resampling, scores and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_by_draw


def draw(*keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the keys; the same keys give the same number on any engine."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def mean_difference(rows: DataFrame, control: str, min_cells: int, *, label: str = "label", target: str = "gene", value: str = "value", cell: str = "cell_id", excluded: str | None = None) -> DataFrame:
    """EVD1: (source, target, effect, score, n_intervention, n_control, source_rank) of labels with enough cells.

    Means are over all cells of a label, missing triples being zeros. A target equal to its source is left out; ranks
    go by size of the effect, then by name.
    """
    cells = rows.select(cell, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cells)
    cells = cells if excluded is None else cells.filter(F.col(label) != excluded)
    sums = rows.groupBy(label, target).agg(F.sum(value).alias("s"))
    targets = sums.select(F.col(target).alias("target")).distinct()
    base = cells.filter(F.col(label) == control).select(F.col("n").alias("n_control"))
    control_mean = targets.join(sums.filter(F.col(label) == control).select(F.col(target).alias("target"), "s"), "target", "left").crossJoin(F.broadcast(base)).select("target", "n_control", (F.coalesce("s", F.lit(0.0)) / F.col("n_control")).alias("m0"))
    sources = cells.filter(F.col(label) != control).select(F.col(label).alias("source"), F.col("n").alias("n_intervention"))
    full = sources.crossJoin(F.broadcast(control_mean))  # declared targets by declared labels, the size of the result
    full = full.join(sums.select(F.col(label).alias("source"), F.col(target).alias("target"), "s"), ["source", "target"], "left").filter("source <> target")
    effect = F.coalesce("s", F.lit(0.0)) / F.col("n_intervention") - F.col("m0")
    out = full.withColumn("effect", F.round(effect, 9)).withColumn("score", F.abs("effect"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("score").desc(), "target"))
    return out.select("source", "target", "effect", "score", "n_intervention", "n_control", rank.alias("source_rank"))


def split_units(units: DataFrame, key: str, seed: str, cuts: Sequence[tuple[str, float]]) -> DataFrame:
    """EVD3: each unit's part by its exact place in hash order; cuts are (name, upper share) and the last share is 1."""
    numbered = number_by_draw(units.select(key), draw(F.lit(seed), F.col(key)), [key], "_place")
    place = F.when(F.col("_n") > 1, F.col("_place") / (F.col("_n") - 1)).otherwise(0.0)
    out = F.lit(cuts[-1][0])
    for name, upper in reversed(cuts[:-1]):
        out = F.when(place < upper, name).otherwise(out)
    return numbered.select(key, out.alias("part"))


def spatial_holdout(points: DataFrame, step: float, span: int, buffer: int) -> DataFrame:
    """EVD4: tune cells of a grid up to `span`, a buffer around them, and train; by the cell's larger coordinate."""
    origin = points.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    cell = points.crossJoin(F.broadcast(origin)).withColumn("_c", F.greatest(F.floor((F.col("x") - F.col("_x")) / step), F.floor((F.col("y") - F.col("_y")) / step)))
    return cell.withColumn("part", F.when(F.col("_c") < span, "tune").when(F.col("_c") < span + buffer, "buffer").otherwise("train")).drop("_x", "_y", "_c")


def hierarchical_mean(rows: DataFrame, value: str, levels: Sequence[Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """AGG19: means of means; each step drops one list of dimensions, the last leaves `keep`.

    levels: the dimensions averaged out, in order. A flat mean would weigh large units more.
    """
    dims = [*keep, *(c for level in reversed(levels) for c in level)]
    out = rows.select(*dims, F.col(value).cast("double").alias(value))
    for level in levels:
        dims = [c for c in dims if c not in level]
        out = out.groupBy(*dims).agg(F.avg(value).alias(value))
    return out


def decay_baselines(rows: DataFrame, length: float = 1.0) -> DataFrame:
    """EVD9 and SCA4: own-only and distance-decay predictions of neighbours' effects.

    rows: (is_perturbed, distance, own, observed). Own-only gives neighbours 0; decay gives own * exp(-d / length). A
    null own effect abstains.
    """
    own = F.when(F.col("is_perturbed"), F.col("own")).otherwise(F.when(F.col("own").isNotNull(), 0.0))
    return rows.withColumns({"own_only": own, "decay": F.col("own") * F.exp(-F.col("distance") / length)})


def prediction_metrics(rows: DataFrame, predicted: str, observed: str, by: Sequence[str] = ()) -> DataFrame:
    """EVD8 and EVD10: RMSE, Pearson and sign accuracy of what was predicted, coverage and abstention."""
    p, o = F.col(predicted), F.col(observed)
    have = p.isNotNull()
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.when(have, (p - o) * (p - o)))).alias("rmse"), F.coalesce(F.corr(F.when(have, p), F.when(have, o)), F.lit(0.0)).alias("pearson"), F.avg(F.when(have, (F.signum(p) == F.signum(o)).cast("double"))).alias("sign_accuracy"), F.avg(have.cast("double")).alias("coverage")).withColumn("abstention", 1 - F.col("coverage"))


def quantile_bins(rows: DataFrame, value: str, bins: int = 4) -> DataFrame:
    """WIN10: adds bin, from 0, by right-closed quantile edges; equal edges make fewer bins."""
    q = rows.agg(F.array_distinct(F.transform(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(bins + 1)))), lambda x: F.round(x, 9))).alias("_e"))
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    return rows.crossJoin(F.broadcast(q)).withColumn("bin", F.size(F.filter(inner, lambda e: F.round(F.col(value), 9) > e))).drop("_e")


def calibration_error(rows: DataFrame, distance: str, predicted: str, observed: str, bins: int = 4) -> DataFrame:
    """WIN10's use: mean over distance bins of |mean prediction - mean observation|."""
    per = quantile_bins(rows, distance, bins).groupBy("bin").agg(F.abs(F.avg(predicted) - F.avg(observed)).alias("e"))
    return per.agg(F.count(F.lit(1)).alias("n_bins"), F.avg("e").alias("calibration_error"))


def stability_table(runs: DataFrame, threshold: float) -> DataFrame:
    """STA13: (src, dst, median_effect, selection_frequency, direction_agreement, score, abstains) of repeated fits.

    runs: (repeat, context, src, dst, value). Selected is a value above the threshold in size; agreement is the share of
    the more frequent sign among selected ones; score = |median| * frequency * agreement; an edge never selected abstains.
    """
    chosen = F.abs("value") > threshold
    out = runs.groupBy("src", "dst").agg(F.percentile("value", 0.5).alias("median_effect"), F.avg(chosen.cast("double")).alias("selection_frequency"), F.count_if(chosen).alias("_n"), F.count_if(chosen & (F.col("value") > 0)).alias("_p"))
    agreement = F.when(F.col("_n") > 0, F.greatest("_p", F.col("_n") - F.col("_p")) / F.col("_n")).otherwise(0.0)
    return out.select("src", "dst", "median_effect", "selection_frequency", agreement.alias("direction_agreement"), (F.abs("median_effect") * F.col("selection_frequency") * agreement).alias("score"), (F.col("_n") == 0).alias("abstains"))


def edge_stability(edges: DataFrame, repeats: DataFrame, nulls: DataFrame, threshold: float = 0.5, alpha: float = 0.10) -> DataFrame:
    """STA14: frequencies of edges over repeats against null frequencies, empirical p, q and a class.

    edges: (src, dst, base_edge); repeats, nulls: (run, src, dst, freq). p = (1 + nulls at least the mean) / (1 + nulls);
    q is Benjamini and Hochberg's over all edges; a control passes with ten nulls or more, a mean above the null's 95th
    percentile and q at most alpha.
    """
    from .ranking import benjamini_hochberg

    own = repeats.groupBy("src", "dst").agg(F.avg("freq").alias("mean_freq"), F.stddev_pop("freq").alias("sd_freq"), F.avg((F.col("freq") >= threshold).cast("double")).alias("seed_support"))
    rows = edges.join(own, ["src", "dst"], "left").fillna(0.0, ["mean_freq", "sd_freq", "seed_support"])
    null = nulls.join(rows.select("src", "dst", "mean_freq"), ["src", "dst"]).groupBy("src", "dst").agg(F.avg("freq").alias("null_mean"), F.percentile("freq", 0.95).alias("null_p95"), F.count(F.lit(1)).alias("n_nulls"), F.count_if(F.col("freq") >= F.col("mean_freq")).alias("_ge"))
    rows = rows.join(null, ["src", "dst"], "left").fillna(0, ["n_nulls", "_ge"]).fillna(0.0, ["null_mean", "null_p95"])
    rows = rows.withColumn("p", F.when(F.col("n_nulls") > 0, (F.col("_ge") + 1) / (F.col("n_nulls") + 1)).otherwise(1.0)).drop("_ge")
    rows = benjamini_hochberg(rows, "p")
    passed = (F.col("n_nulls") >= 10) & (F.col("mean_freq") > F.col("null_p95")) & (F.col("q") <= alpha)
    rows = rows.withColumn("control_pass", passed)
    kind = F.when(F.col("control_pass") & (F.col("seed_support") >= 0.8), "stable_candidate").when((F.col("n_nulls") == 0) & ((F.col("seed_support") >= 0.5) | F.col("base_edge")), "not_controlled_candidate").when(F.col("mean_freq") <= F.col("null_p95"), "null_like_edge").when(F.col("seed_support") >= 0.5, "context_specific_candidate").otherwise("unstable_candidate")
    return rows.withColumn("stability_class", kind)


def empirical_check(real: float, nulls: DataFrame, max_p: float = 0.05, min_advantage: float = 0.0, needed: int = 20) -> DataFrame:
    """STA16: p = (1 + nulls at least as large) / (1 + nulls) and whether it passes; nulls: (value)."""
    out = nulls.agg(F.count(F.lit(1)).alias("n_nulls"), F.count_if(F.col("value") >= real).alias("_ge"), F.avg("value").alias("null_mean"))
    out = out.select("n_nulls", "null_mean", ((F.col("_ge") + 1) / (F.col("n_nulls") + 1)).alias("p"), (F.lit(real) - F.col("null_mean")).alias("advantage"))
    return out.withColumn("passes", (F.col("n_nulls") >= needed) & (F.col("p") <= max_p) & (F.col("advantage") > min_advantage))


def permute_labels(rows: DataFrame, key: str, label: str, control: str, seed: str) -> DataFrame:
    """STA16: labels of rows that aren't controls, dealt out anew; their numbers stay.

    The n-th row in one hash order gets the label of the n-th row in another.
    """
    rest = rows.filter(F.col(label) != control).select(key, label)
    a = number_by_draw(rest, draw(F.lit(seed), F.lit("to"), F.col(key)), [key], "_rn").select(key, "_rn")
    b = number_by_draw(rest, draw(F.lit(seed), F.col(key)), [key], "_rn").select(F.col(label).alias("permuted"), "_rn")
    dealt = a.join(b, "_rn").select(key, "permuted")
    return rows.join(dealt, key, "left").withColumn("permuted", F.coalesce("permuted", F.col(label)))


def cluster_bootstrap(units: DataFrame, cluster: str, difference: str, repeats: int, seed: str) -> DataFrame:
    """STA17: estimate and 95 % interval of a mean difference, clusters drawn with replacement.

    In each repeat every cluster is drawn as often as slots fall on it: slot i of n takes the cluster whose place is
    floor(u * n). Only sums and counts of clusters take part.
    """
    sums = units.filter(F.col(difference).isNotNull()).groupBy(cluster).agg(F.sum(difference).alias("s"), F.count(F.lit(1)).alias("m"))
    placed = sums.withColumn("place", F.row_number().over(Window.orderBy(cluster)) - 1)
    n = placed.agg(F.count(F.lit(1)).alias("n"), (F.sum("s") / F.sum("m")).alias("estimate"))
    spark = units.sparkSession
    slots = spark.range(repeats).withColumnRenamed("id", "repeat").crossJoin(F.broadcast(n)).select("repeat", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("slot"))
    taken = slots.withColumn("place", F.floor(draw(F.lit(seed), F.col("repeat"), F.col("slot")) * F.col("n")).cast("int"))
    means = taken.join(placed, "place").groupBy("repeat").agg((F.sum("s") / F.sum("m")).alias("mean"))
    ends = means.agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))
    return n.crossJoin(ends).select(F.col("n").alias("n_clusters"), "estimate", "ci_low", "ci_high")


def nested_bootstrap(units: DataFrame, repeats: int, seed: str) -> DataFrame:
    """STA17: estimate and 95 % interval of a mean of strata's means of clusters' means of blocks.

    units: (stratum, cluster, block, value). In each repeat every stratum draws as many clusters as it has, with
    replacement, and each drawn cluster as many of its blocks; place k of n is floor(u * n) of a hash.
    """
    blocks = units.withColumn("_bp", F.row_number().over(Window.partitionBy("stratum", "cluster").orderBy("block")) - 1)
    clusters = units.groupBy("stratum", "cluster").agg(F.count(F.lit(1)).alias("_nb"))
    clusters = clusters.withColumns({"_cp": F.row_number().over(Window.partitionBy("stratum").orderBy("cluster")) - 1, "_nc": F.count(F.lit(1)).over(Window.partitionBy("stratum"))})
    runs = units.sparkSession.range(repeats).withColumnRenamed("id", "_r")
    slots = clusters.select("stratum", "_nc").distinct().crossJoin(runs).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nc") - 1)))  # repeats times clusters
    taken = slots.withColumn("_cp", F.floor(draw(F.lit(seed), F.col("_r"), F.col("stratum"), F.col("_slot")) * F.col("_nc")).cast("int")).join(clusters.drop("_nc"), ["stratum", "_cp"])
    inner = taken.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
    inner = inner.withColumn("_bp", F.floor(draw(F.lit(seed), F.col("_r"), F.col("stratum"), F.col("_slot"), F.col("_i")) * F.col("_nb")).cast("int"))
    means = inner.join(blocks.select("stratum", "cluster", "_bp", "value"), ["stratum", "cluster", "_bp"]).groupBy("_r", "stratum", "_slot").agg(F.avg("value").alias("value"))
    for by in (["_r", "stratum"], ["_r"]):
        means = means.groupBy(*by).agg(F.avg("value").alias("value"))
    whole = units.groupBy("stratum", "cluster").agg(F.avg("value").alias("value")).groupBy("stratum").agg(F.avg("value").alias("value")).agg(F.avg("value").alias("estimate"))
    return whole.crossJoin(means.agg(F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high")))


def precision_difference(rows: DataFrame, repeats: int, seed: str) -> DataFrame:
    """STA17: mean and 95 % interval of the difference of two scores' average precision, sources drawn with replacement.

    rows: (source, target, score_a, score_b, positive). A source drawn several times counts so often in every row of its
    own; only sources' places are drawn.
    """
    from .screening import weighted_metrics

    placed = rows.select("source").distinct().withColumn("_p", F.row_number().over(Window.orderBy("source")) - 1)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    slots = rows.sparkSession.range(repeats).withColumnRenamed("id", "_r").crossJoin(F.broadcast(n)).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    taken = slots.withColumn("_p", F.floor(draw(F.lit(seed), F.col("_r"), F.col("_slot")) * F.col("_n")).cast("int"))
    times = taken.join(placed, "_p").groupBy("_r", "source").agg(F.count(F.lit(1)).alias("_c"))
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"score_{k}").alias("score")) for k in "ab"))).alias("x")
    scored = weighted_metrics(times.join(rows, "source").select("_r", "_c", "positive", both).select("_r", "_c", "positive", "x.*"), "score", "positive", "_c", ["_r", "k"])
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("average_precision")))
    gaps = scored.groupBy("_r").agg((of("a") - of("b")).alias("_d"))
    return gaps.agg(F.avg("_d").alias("mean_difference"), F.percentile("_d", 0.025).alias("ci_low"), F.percentile("_d", 0.975).alias("ci_high"))


def null_frequencies(freq: DataFrame, names: DataFrame, runs: int, seed: str) -> DataFrame:
    """STA14: (run, src, dst, freq) of null matrices, by turns all values permuted, the nodes relabelled, and each row permuted.

    freq: (src, dst, freq), missing pairs being 0; names: (node), whose pairs are the matrix. Permutations are the hash
    order against the order of the names.
    """
    node = names.select("node")
    grid = node.toDF("src").join(node.toDF("dst"), F.col("src") != F.col("dst")).join(freq, ["src", "dst"], "left").select("src", "dst", F.coalesce("freq", F.lit(0.0)).alias("freq"))
    run = names.sparkSession.range(runs).withColumnRenamed("id", "run")
    cells = grid.crossJoin(run)  # the matrices themselves
    out = []
    for mode, by in ((0, ["run"]), (2, ["run", "src"])):
        own = Window.partitionBy(*by)
        part = cells.filter(F.col("run") % 3 == mode).select("run", "src", "dst", "freq", F.row_number().over(own.orderBy("src", "dst")).alias("_a"), F.row_number().over(own.orderBy(draw(F.lit(seed), F.col("run"), F.col("src"), F.col("dst")), "src", "dst")).alias("_b"))
        out.append(part.select("run", "src", "dst", "_a").join(part.select(*by, F.col("_b").alias("_a"), "freq"), [*by, "_a"]).select("run", "src", "dst", "freq"))
    own = Window.partitionBy("run")
    order = node.crossJoin(run.filter("run % 3 = 1")).select("run", "node", F.row_number().over(own.orderBy("node")).alias("_a"), F.row_number().over(own.orderBy(draw(F.lit(seed), F.col("run"), F.col("node")), "node")).alias("_b"))
    new = order.select("run", F.col("node").alias("old"), F.col("_b").alias("_a")).join(order.select("run", "_a", F.col("node").alias("new")), ["run", "_a"]).drop("_a")
    moved = grid.join(new.toDF("run", "src", "_s"), "src").join(new.toDF("run", "dst", "_d"), ["run", "dst"]).select("run", F.col("_s").alias("src"), F.col("_d").alias("dst"), "freq")
    return out[0].union(moved).union(out[1])


def edge_frequency(edges: DataFrame, n_samples: int, floor: float = 0.5) -> DataFrame:
    """AGG23: in what share of samples each edge (sample, src, dst) occurs, and whether that is above the floor."""
    return edges.select("sample", "src", "dst").distinct().groupBy("src", "dst").agg((F.count(F.lit(1)) / n_samples).alias("frequency")).withColumn("robust", F.col("frequency") > floor)


def sample_jaccard(edges: DataFrame) -> DataFrame:
    """AGG23 and AGG24: Jaccard index of the edge sets of each pair of samples."""
    e = edges.select("sample", "src", "dst").distinct()
    sizes = e.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    both = e.toDF("a", "src", "dst").join(e.toDF("b", "src", "dst"), ["src", "dst"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    pairs = sizes.toDF("a", "na").join(sizes.toDF("b", "nb"), F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    k = F.coalesce("k", F.lit(0))
    return pairs.select("a", "b", (k / (F.col("na") + F.col("nb") - k)).alias("jaccard"))


def group_edges(edges: DataFrame, n_groups: int) -> DataFrame:
    """AGG24: edges by the groups that have them; consensus if all do, specific if one does."""
    g = edges.select("sample", "src", "dst").distinct().groupBy("src", "dst").agg(F.array_sort(F.collect_set("sample")).alias("groups"))
    return g.select("src", "dst", F.array_join("groups", ";").alias("groups"), (F.size("groups") == n_groups).alias("consensus"), (F.size("groups") == 1).alias("specific"))


def claim_decisions(evidence: DataFrame, required: DataFrame, min_lower: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """EVD11: one decision for each claim: blocked, audit_only or admitted.

    evidence: (claim, comparator, ci_low, adjusted_p, attempted, completed, statuses); required: (claim, comparator). A
    missing or incomplete comparator blocks; an interval or p that fails leaves audit only.
    """
    rows = required.join(evidence, ["claim", "comparator"], "left")
    missing = F.col("attempted").isNull()
    incomplete = ~missing & ((F.col("attempted") != F.col("completed")) | F.exists("statuses", lambda s: s != "completed"))
    weak = ~missing & ~incomplete & (~F.coalesce(F.col("ci_low") > min_lower, F.lit(False)) | ~F.coalesce(F.col("adjusted_p") < alpha, F.lit(False)))
    out = rows.groupBy("claim").agg(F.count_if(missing).alias("n_missing"), F.count_if(incomplete).alias("n_incomplete"), F.count_if(weak).alias("n_inconclusive"))
    status = F.when(F.col("n_missing") + F.col("n_incomplete") > 0, "blocked").when(F.col("n_inconclusive") > 0, "audit_only").otherwise("admitted")
    return out.withColumn("status", status)


def joint_claim(decisions: DataFrame, first: str, second: str) -> DataFrame:
    """EVD11: admitted only if both are, blocked if either is."""
    pair = decisions.filter(F.col("claim").isin(first, second))
    n = lambda s: F.count_if(F.col("status") == s)
    return pair.agg(F.when((n("blocked") > 0) | (F.count(F.lit(1)) < 2), "blocked").when(n("admitted") == 2, "admitted").otherwise("audit_only").alias("status"))


def promotion(evidence: DataFrame, min_coverage: float, max_abstention: float, min_seeds: int, min_improvement: float) -> DataFrame:
    """EVD11: promoted if every gate holds; evidence: (task, coverage, abstention, seeds, gates, improvement)."""
    return evidence.withColumn("promoted", (F.col("coverage") >= min_coverage) & (F.col("abstention") <= max_abstention) & (F.col("seeds") >= min_seeds) & F.forall("gates", lambda g: g) & F.forall("improvement", lambda x: x > min_improvement))


def run_statuses(runs: DataFrame, method: str, status: str) -> DataFrame:
    """EVD13: runs by method and status, failures kept, and the share completed."""
    out = runs.groupBy(method).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col(status) == "completed").alias("completed"))
    return out.withColumn("completion", F.col("completed") / F.col("attempted"))


def same_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EVD9: how many keys each table has that the other lacks; both 0 means common rows."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("only_a")).crossJoin(right.join(left, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("only_b")))


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """STA19: n rows in all, shared out in proportion to the strata by largest remainders, drawn in hash order."""
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_m"))
    total = sizes.agg(F.sum("_m").alias("_all"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_exact", F.col("_m") * F.least(F.lit(n), F.col("_all")) / F.col("_all")).withColumn("_q", F.floor("_exact"))
    left = quota.agg((F.least(F.lit(n), F.max("_all")) - F.sum("_q")).alias("_left"))
    order = Window.orderBy(F.round(F.col("_exact") - F.col("_q"), 9).desc(), *strata)
    quota = quota.withColumn("_o", F.row_number().over(order)).crossJoin(F.broadcast(left)).withColumn("_q", F.col("_q") + F.when(F.col("_o") <= F.col("_left"), 1).otherwise(0)).select(*strata, "_q")
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(draw(F.lit(seed), F.col(key)), key)))
    return ranked.join(quota, list(strata)).filter(F.col("_rn") <= F.col("_q")).drop("_rn", "_q")


def capped_sample(rows: DataFrame, label: str, key: str, cap: int, seed: str) -> DataFrame:
    """STA19: at most `cap` rows of each label, in hash order."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(draw(F.lit(seed), F.col(key)), key)))
    return ranked.filter(F.col("_rn") <= cap).drop("_rn")


def enrichment(rows: DataFrame, niche: str, label: str) -> DataFrame:
    """GRA16: log2 of a label's share in a niche over its share in all, with 1e-9 added to both."""
    cells = rows.groupBy(niche, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(niche))
    overall = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_m"))
    total = overall.agg(F.sum("_m").alias("_all"))
    both = cells.withColumn("share", share).join(overall, label).crossJoin(F.broadcast(total))
    return both.select(niche, label, "n", F.log2((F.col("share") + 1e-9) / (F.col("_m") / F.col("_all") + 1e-9)).alias("log2_enrichment"))


def module_admission(metrics: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """AGG25: a row for each rule (module, metric, least value) over a one-row table of metrics."""
    rows = [F.struct(F.lit(m).alias("module"), F.col(c).cast("double").alias("metric"), F.coalesce(F.col(c) >= least, F.lit(False)).alias("ok")) for m, c, least in rules]
    out = metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("status", F.when(F.col("metric").isNull(), "missing").when(F.col("ok"), "admitted").otherwise("audit_only")).drop("ok")
