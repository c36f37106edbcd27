"""Signal flow over graphs of typed nodes: chains, mechanisms, counterfactuals, propagation in time and space.

Tables: edges (src, dst, w), nodes (node, node_type), values (node, gene, value), chains (ligand, receptor, tf, target,
source_type, target_type, pathway).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordering import running


def cluster_adjacency(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG9: summed weights between different clusters over (n_i * n_j + 1e-10), divided by the largest.

    edges: (src, dst, w) between points; labels: (id, cluster).
    """
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    a, b = labels.select(F.col("id").alias("src"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("dst"), F.col("cluster").alias("cj"))
    sums = edges.join(a, "src").join(b, "dst").filter("ci <> cj").groupBy("ci", "cj").agg(F.sum("w").alias("w"))
    na, nb = sizes.toDF("ci", "ni"), sizes.toDF("cj", "nj")
    out = sums.join(na, "ci").join(nb, "cj").select("ci", "cj", (F.col("w") / (F.col("ni") * F.col("nj") + 1e-10)).alias("w"))
    top = out.agg(F.max("w").alias("_top"))
    return out.crossJoin(F.broadcast(top)).select("ci", "cj", F.when(F.col("_top") > 0, F.col("w") / F.col("_top")).otherwise(0.0).alias("w"))


def communication(chains: DataFrame, nodes: DataFrame, values: DataFrame, spatial: DataFrame, distance: DataFrame, causal: DataFrame, *, alpha: float = 0.5, beta: float = 0.5, epsilon: float = 1.0) -> DataFrame:
    """JOI8: each chain between each pair of different nodes of its types, with flow and direction.

    flow = share of the chain's genes above 0 * exp(-(alpha * distance + beta * (1 - contact)) / epsilon), where the
    distance is divided by the largest and the contact held to [0, 1]. A gene that a node lacks counts as missing and 0.
    """
    pairs = chains.join(nodes.select(F.col("node").alias("src"), F.col("node_type").alias("source_type")), "source_type")
    pairs = pairs.join(nodes.select(F.col("node").alias("dst"), F.col("node_type").alias("target_type")), "target_type").filter("src <> dst")
    for gene, at in (("ligand", "src"), ("receptor", "dst"), ("tf", "dst"), ("target", "dst")):
        pairs = pairs.join(values.select(F.col("node").alias(at), F.col("gene").alias(gene), F.col("value").alias(f"{gene}_value")), [at, gene], "left")
    pairs = pairs.join(spatial.select("src", "dst", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w"))).alias("contact")), ["src", "dst"], "left")
    scale = distance.filter("w > 0").agg(F.coalesce(F.max("w"), F.lit(1.0)).alias("_scale"))
    pairs = pairs.join(distance.select("src", "dst", F.col("w").alias("_d")), ["src", "dst"], "left").crossJoin(F.broadcast(scale))
    forward = causal.filter("w > 0").select("src", "dst", F.lit(True).alias("forward"))
    pairs = pairs.join(forward, ["src", "dst"], "left").join(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("forward").alias("reverse")), ["src", "dst"], "left")
    genes = ("ligand", "receptor", "tf", "target")
    support = sum((F.when(F.col(f"{g}_value") > 0, 0.25).otherwise(0.0) for g in genes), F.lit(0.0))
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(f"{g}_value").isNull(), F.col(g)) for g in genes)), lambda x: x.isNotNull()), ";")
    contact, d = F.coalesce("contact", F.lit(0.0)), F.coalesce("_d", F.lit(0.0)) / F.greatest(F.col("_scale"), F.lit(1e-12))
    weight = F.exp(-(alpha * d + beta * (1 - contact)) / max(epsilon, 1e-12))
    status = F.when(F.col("forward") & F.col("reverse"), "ambiguous").when(F.col("forward"), "forward").when(F.col("reverse"), "reverse").otherwise("unresolved")
    out = pairs.select("pathway", *genes, "source_type", "target_type", "src", "dst", missing.alias("missing_genes"), weight.alias("weight"), (support * weight).alias("flow_score"), status.alias("direction_status"))
    top = out.agg(F.max("flow_score").alias("_top"))
    return out.crossJoin(F.broadcast(top)).withColumn("normalized_flow", F.when(F.col("_top") > 0, F.col("flow_score") / F.col("_top")).otherwise(0.0)).drop("_top")


def direction_consistency(edges: DataFrame) -> DataFrame:
    """AGG14: counts by direction, overall (pathway null) and by pathway; unresolved edges don't enter the rates."""
    status = F.col("direction_status")
    known = status.isin("forward", "reverse", "ambiguous")
    w = F.coalesce("flow_score", F.lit(0.0))
    out = edges.groupingSets([["pathway"], []], "pathway").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(known).alias("resolved"), *(F.count_if(status == s).alias(f"n_{s}") for s in ("forward", "reverse", "ambiguous")), F.sum(F.when(known, w)).alias("_den"), F.sum(F.when(status == "forward", w)).alias("_num"))
    rate = F.col("n_forward") / F.greatest(F.col("resolved"), F.lit(1))
    return out.withColumns({"n_unresolved": F.col("n_edges") - F.col("resolved"), "rate": rate, "weighted_rate": F.when(F.col("_den") > 0, F.coalesce("_num", F.lit(0.0)) / F.col("_den")).otherwise(0.0)}).drop("_den", "_num")


def pathway_summary(edges: DataFrame) -> DataFrame:
    """AGG13: flows of each pathway, the edge of the largest flow (then the smaller nodes), and its directions."""
    best = F.struct(F.round("flow_score", 9).alias("s"), (-F.col("src")).alias("a"), (-F.col("dst")).alias("b"))
    return edges.groupBy("pathway").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("flow_score").alias("total_flow"), F.avg("flow_score").alias("mean_flow"), F.max("flow_score").alias("max_flow"), F.max_by("src", best).alias("top_source"), F.max_by("dst", best).alias("top_target"))


def signal_flow(chains: DataFrame, nodes: DataFrame, values: DataFrame, causal: DataFrame, floor: float = 0.1) -> DataFrame:
    """JOI9: three layered edges for each chain whose types are joined by a causal edge.

    The weight is the largest such edge's, times the mean of 1 for each gene whose largest value over the type's nodes
    is above the floor and 0.3 for each other; the second and third edge get 0.8 and 0.6 of it.
    """
    types = nodes.select("node", "node_type")
    gated = causal.filter("w > 0").join(types.toDF("src", "source_type"), "src").join(types.toDF("dst", "target_type"), "dst").groupBy("source_type", "target_type").agg(F.max("w").alias("w"))
    highest = values.join(types, "node").groupBy("node_type", "gene").agg(F.max("value").alias("v"))
    rows = chains.join(gated, ["source_type", "target_type"])
    for gene, side in (("ligand", "source_type"), ("receptor", "target_type"), ("tf", "target_type"), ("target", "target_type")):
        rows = rows.join(highest.select(F.col("node_type").alias(side), F.col("gene").alias(gene), F.col("v").alias(f"{gene}_value")), [side, gene], "left").withColumn(f"{gene}_value", F.coalesce(f"{gene}_value", F.lit(0.0)))
    score = F.col("w") * sum((F.when(F.col(f"{g}_value") > floor, 0.25).otherwise(0.075) for g in ("ligand", "receptor", "tf", "target")), F.lit(0.0))
    layer = lambda i, a, b, part: F.struct(F.lit(i).alias("source_layer"), F.lit(i + 1).alias("target_layer"), F.col(a).alias("source"), F.col(b).alias("target_gene"), (score * part).alias("weight"), F.col(f"{a}_value").alias("source_value"), F.col(f"{b}_value").alias("target_value"))
    edges = F.array(layer(0, "ligand", "receptor", 1.0), layer(1, "receptor", "tf", 0.8), layer(2, "tf", "target", 0.6))
    out = rows.select("pathway", F.concat_ws("->", "source_type", "target_type").alias("causal_edge"), F.explode(edges).alias("e"))
    return out.select("pathway", "causal_edge", "e.*").withColumnRenamed("target_gene", "target")


def flow_completeness(edges: DataFrame) -> DataFrame:
    """AGG15: edges, mean weight and layers of each pathway; complete if all of layers 0 to 3 occur."""
    layers = F.array_sort(F.array_distinct(F.concat(F.collect_set("source_layer"), F.collect_set("target_layer"))))
    return edges.groupBy("pathway").agg(F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("mean_weight"), layers.alias("_l")).select("pathway", "n_edges", "mean_weight", (F.col("_l") == F.array(*map(F.lit, range(4)))).alias("complete"))


def mechanism_chains(edges: DataFrame) -> DataFrame:
    """JOI10: ligand, receptor, tf and target put together within pathway and causal edge; missing legs stay empty."""
    leg = lambda i, *names: edges.filter(F.col("source_layer") == i).select("pathway", "causal_edge", *(F.col(a).alias(b) for a, b in zip(("source", "target", "weight", "source_value", "target_value"), names, strict=True)))
    first = leg(0, "ligand", "receptor", "w0", "ligand_value", "receptor_value")
    second = leg(1, "receptor", "tf", "w1", "_a", "_b").drop("_a", "_b")
    third = leg(2, "tf", "downstream", "w2", "_c", "target_value").drop("_c")
    out = first.join(second, ["pathway", "causal_edge", "receptor"], "left").join(third, ["pathway", "causal_edge", "tf"], "left")
    legs = [F.col("w0"), F.col("w1"), F.col("w2")]
    n = sum((w.isNotNull().cast("int") for w in legs), F.lit(0))
    weight = sum((F.coalesce(w, F.lit(0.0)) for w in legs), F.lit(0.0)) / n
    return out.select("pathway", "causal_edge", "ligand", "receptor", *(F.coalesce(c, F.lit("")).alias(c) for c in ("tf", "downstream")), "ligand_value", "receptor_value", F.coalesce("target_value", F.lit(0.0)).alias("target_value"), weight.alias("edge_weight"))


def mechanism_evidence(ranking: DataFrame, chains: DataFrame, top: int, spatial: Column | None = None, niche: Column | None = None) -> DataFrame:
    """JOI11: the chains that hold one of the first `top` ranked genes, with a score that doesn't change the rank.

    0.20 + 0.25 * mean of the genes' parts + 0.25 * edge weight + 0.15 + 0.10 * spatial + 0.05 * niche, parts held to
    [0, 1]; a transcription factor's part is 1 if it is known.
    """
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    member = F.array_distinct(F.filter(F.array(*(F.upper(c) for c in ("ligand", "receptor", "tf", "downstream"))), lambda x: x != ""))
    held = chains.withColumn("_gene", F.explode(member))
    first = ranking.filter(F.col("rank") <= top).withColumn("_gene", F.upper("gene"))
    parts = unit(F.col("ligand_value")) + unit(F.col("receptor_value")) + F.when(F.col("tf") != "", 1.0).otherwise(0.0) + unit(F.col("target_value"))
    score = 0.20 + 0.25 * parts / 4 + 0.25 * unit(F.col("edge_weight")) + 0.15 + 0.10 * (spatial if spatial is not None else F.lit(0.0)) + 0.05 * unit(niche if niche is not None else F.lit(0.0))
    return first.join(held, "_gene").select("gene", "rank", "pathway", "causal_edge", "ligand", "receptor", "tf", "downstream", score.alias("mechanism_score"))


def append_best(ranking: DataFrame, evidence: DataFrame) -> DataFrame:
    """AGG17: each gene's largest mechanism score, 0 without one."""
    best = evidence.groupBy("gene").agg(F.max("mechanism_score").alias("mechanism_score"))
    return ranking.join(best, "gene", "left").withColumn("mechanism_score", F.coalesce("mechanism_score", F.lit(0.0)))


def known_axes(axes: DataFrame, nodes: DataFrame, causal: DataFrame) -> DataFrame:
    """GRA9: whether an axis (source_type, target_type) has an edge forward and backward."""
    types = nodes.select("node", "node_type")
    by_type = causal.filter("w > 0").join(types.toDF("src", "source_type"), "src").join(types.toDF("dst", "target_type"), "dst").select("source_type", "target_type").distinct()
    out = axes.join(by_type.withColumn("_f", F.lit(True)), ["source_type", "target_type"], "left")
    out = out.join(by_type.select(F.col("target_type").alias("source_type"), F.col("source_type").alias("target_type"), F.lit(True).alias("_r")), ["source_type", "target_type"], "left")
    return out.select("source_type", "target_type", F.coalesce("_f", F.lit(False)).alias("found"), F.coalesce("_r", F.lit(False)).alias("reverse_found"))


def inject_prior(causal: DataFrame, prior: DataFrame) -> DataFrame:
    """GRA10: prior edges (src, dst, w) where the graph has neither direction."""
    either = causal.select("src", "dst").union(causal.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return causal.select("src", "dst", "w", F.lit(False).alias("is_prior")).union(prior.join(either, ["src", "dst"], "left_anti").select("src", "dst", "w", F.lit(True)))


def symmetric_if_empty(causal: DataFrame, flow: DataFrame) -> DataFrame:
    """GRA11: the graph with reversed edges added (the larger weight counts) where the flow has no row."""
    empty = flow.agg((F.count(F.lit(1)) == 0).alias("_empty"))
    back = causal.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w").crossJoin(F.broadcast(empty)).filter("_empty").drop("_empty")
    return causal.select("src", "dst", "w").union(back).groupBy("src", "dst").agg(F.max("w").alias("w"))


def knockout(values: DataFrame, nodes: DataFrame, gene: str, source_type: str, receptor: str, target_type: str, strength: float) -> DataFrame:
    """GRA22: the gene times (1 - s) in the source type and its receptor times (1 - s / 2) in the target type."""
    typed = values.join(nodes.select("node", "node_type"), "node")
    factor = F.when((F.col("gene") == gene) & (F.col("node_type") == source_type), 1 - strength).when((F.col("gene") == receptor) & (F.col("node_type") == target_type), 1 - strength / 2).otherwise(1.0)
    return typed.select("node", "node_type", "gene", "value", (F.col("value") * factor).alias("counterfactual"))


def counterfactual_rank(edges: DataFrame, changed: DataFrame, prior: DataFrame, floor: float = 0.01, k: int | None = 50) -> DataFrame:
    """GRA23 and SRT3: first-layer edges by weight * (|change of ligand| + |change of receptor|) * 1.25 if known before.

    Changes are means over the nodes of the edge's type where it has any, else over all nodes; smaller sums go.
    """
    by_type = changed.groupBy("node_type", F.upper("gene").alias("gene")).agg((F.avg("counterfactual") - F.avg("value")).alias("d"))
    overall = changed.groupBy(F.upper("gene").alias("gene")).agg((F.avg("counterfactual") - F.avg("value")).alias("g"))
    rows = edges.filter("source_layer = 0").select("pathway", "causal_edge", F.upper("source").alias("ligand"), F.upper("target").alias("receptor"), "weight", *(F.trim(F.split("causal_edge", "->|→")[i]).alias(n) for i, n in ((0, "source_type"), (1, "target_type"))))
    for gene, side in (("ligand", "source_type"), ("receptor", "target_type")):
        rows = rows.join(by_type.select(F.col("node_type").alias(side), F.col("gene").alias(gene), F.col("d").alias("_d")), [side, gene], "left").join(overall.select(F.col("gene").alias(gene), F.col("g").alias("_g")), gene, "left").withColumn(f"delta_{gene}", F.coalesce("_d", "_g", F.lit(0.0))).drop("_d", "_g")
    size = F.abs("delta_ligand") + F.abs("delta_receptor")
    rows = rows.withColumn("combined_delta", size).filter(F.col("combined_delta") >= floor)
    rows = rows.join(prior.select(F.upper("ligand").alias("ligand"), F.upper("receptor").alias("receptor"), F.lit(True).alias("prior_hit")).distinct(), ["ligand", "receptor"], "left").withColumn("prior_hit", F.coalesce("prior_hit", F.lit(False)))
    rows = rows.withColumn("score", F.col("weight") * F.col("combined_delta") * F.when(F.col("prior_hit"), 1.25).otherwise(1.0))
    order = [F.col("score").desc(), F.col("combined_delta").desc(), F.col("ligand"), F.col("receptor"), F.col("causal_edge")]
    out = rows.select("ligand", "receptor", "causal_edge", "pathway", "delta_ligand", "delta_receptor", "combined_delta", "prior_hit", "score")
    return out if k is None else out.orderBy(*order).limit(k)


def false_positive_filter(ranked: DataFrame, score: str = "score", size: str = "combined_delta", *, min_score: float = 0.02, max_fdr: float = 0.25, rule: bool = True) -> DataFrame:
    """STA15: empirical false discovery rate and the filter's flags.

    Permuting centred scores doesn't change them as a set, so the rate has a closed form: the share of centred scores
    at least as large over the share of scores at least as large, both as sizes, held to [0, 1].
    """
    stats = ranked.agg(F.avg(score).alias("_m"), F.percentile(size, 0.7).alias("_cut"), F.count(F.lit(1)).alias("_n"))
    rows = ranked.crossJoin(F.broadcast(stats))
    # sizes of both kinds in one order give all counts by a running sum
    tagged = rows.select(F.explode(F.array(F.struct(F.abs(score).alias("v"), F.lit(0).alias("null"), F.lit(1).alias("own")), F.struct(F.abs(F.col(score) - F.col("_m")).alias("v"), F.lit(1).alias("null"), F.lit(0).alias("own")))).alias("t")).groupBy("t.v").agg(F.sum("t.null").alias("a"), F.sum("t.own").alias("b"))
    counts = running(tagged, "v", {"_fp": "a", "_tp": "b"}, descending=True).select("v", "_fp", "_tp")
    rows = rows.withColumn("_v", F.abs(score)).join(counts, F.col("_v") == F.col("v"))
    fdr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_fp") / F.col("_n")) / F.greatest(F.col("_tp") / F.col("_n"), F.lit(1e-8))))
    bio = (F.col("prior_hit") | (F.col(size) >= F.col("_cut"))) if rule else F.lit(True)
    out = rows.withColumns({"empirical_fdr": fdr, "pass_score": F.col(score) >= min_score, "pass_bio_rule": bio})
    out = out.withColumn("pass_fdr", F.col("empirical_fdr") <= max_fdr).withColumn("pass_filter", F.col("pass_score") & F.col("pass_fdr") & F.col("pass_bio_rule"))
    return out.drop("_m", "_cut", "_n", "_v", "v", "_fp", "_tp")


def row_normalized(edges: DataFrame) -> DataFrame:
    """Weights over the sum of what leaves src."""
    s = edges.groupBy("src").agg(F.sum("w").alias("_s"))
    return edges.join(s, "src").select("src", "dst", F.when(F.col("_s") != 0, F.col("w") / F.col("_s")).otherwise(0.0).alias("w"))


def temporal_spread(start: DataFrame, times: list[float], causal: DataFrame, spatial: DataFrame | None = None, *, diffusion: float = 0.35, decay: float = 0.08, top: float = 1.0) -> DataFrame:
    """GRA7: (step, node, effect) by x' = (1 - decay dt) x + diffusion dt A^T x, held to [0, top].

    start: (node, effect), all nodes. A is the row-normalised graph, or 0.7 of it and 0.3 of the spatial one. Every
    fourth step is written, so that the plan stays short.
    """
    a = row_normalized(causal)
    if spatial is not None:
        a = a.select("src", "dst", (F.col("w") * 0.7).alias("w")).union(row_normalized(spatial).select("src", "dst", (F.col("w") * 0.3).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    a = written(a, "steps")  # every step reads it
    x = start.select("node", F.col("effect").cast("double").alias("effect"))
    out = x.select(F.lit(0).alias("step"), "node", "effect")
    for i in range(1, len(times)):
        dt = max(times[i] - times[i - 1], 1e-6)
        got = a.join(x, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("effect")).alias("_g"))
        moved = F.col("effect") * (1 - decay * dt) + diffusion * dt * F.coalesce("_g", F.lit(0.0))
        x = x.join(got, "node", "left").select("node", F.least(F.lit(top), F.greatest(F.lit(0.0), moved)).alias("effect"))
        if i % 4 == 0:
            x = written(x, "step")
        out = out.union(x.select(F.lit(i).alias("step"), "node", "effect"))
    return out


def hop_propagation(causal: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """GRA6 without coordinates: (node, hop, effect), a node's effect being the mean over all its parents.

    sources: (node, effect). Nodes are taken hop by hop; parents not reached before count as 0. Within a hop nodes see
    only earlier hops, which differs from a node by node order where parents lie in the same hop.
    """
    seen = sources.select("node", F.lit(0).alias("hop"), F.col("effect").cast("double").alias("effect"))
    parents = causal.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    for i in range(1, depth + 1):
        reached = causal.join(seen, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum("effect").alias("_s"), F.max("hop").alias("_h")).filter(F.col("_h") == i - 1)
        new = reached.join(seen.select("node"), "node", "left_anti").join(parents, "node").select("node", F.lit(i).alias("hop"), (F.col("_s") / F.col("_n")).alias("effect"))
        seen = seen.union(new)
    return seen


def weighted_degree(edges: DataFrame, floor: float = 1e-6) -> DataFrame:
    """SRT9: a gene's score, the weights it sends plus half of those it receives, edges counting at least the floor."""
    w = F.greatest(F.col("weight"), F.lit(floor))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("gene"), w.alias("s")), F.struct(F.col("target").alias("gene"), (w * 0.5).alias("s")))).alias("e"))
    return ends.groupBy("e.gene").agg(F.sum("e.s").alias("score"))


def best_node(values: DataFrame) -> DataFrame:
    """GRA25: each gene's node of the largest value, the first of equals."""
    return values.groupBy("gene").agg(F.max_by("node", F.struct(F.round("value", 9).alias("v"), (-F.col("node")).alias("n"))).alias("node"), F.max("value").alias("value"))


def known_relations(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """SET2: how many edges (src, dst) of a graph neither of two others has, and the shares."""
    ab = a.select("src", "dst").distinct().join(b.select("src", "dst").distinct().withColumn("_b", F.lit(1)), ["src", "dst"], "left").join(c.select("src", "dst").distinct().withColumn("_c", F.lit(1)), ["src", "dst"], "left")
    return ab.agg(F.count(F.lit(1)).alias("n_edges"), F.count("_b").alias("in_baseline"), F.count("_c").alias("in_spatial"), F.count_if(F.col("_b").isNull()).alias("only_causal"))
