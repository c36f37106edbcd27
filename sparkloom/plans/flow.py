"""Queries over signal flow, counterfactuals, doses and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dosing as D
from ..operators import flow as G
from ..operators import summary as S
from ._register import query
from .bindings import CAUSAL, CHAINS_SQL, FLOW, NODE_EXPR, NODES, causal, chains, flow, node_expr, nodes, table, traffic
from .expression import rounded

SPATIAL = f"SELECT src, dst, n / (max(n) OVER ())::DOUBLE AS w FROM ({FLOW}) WHERE src <> dst"
DISTANCE = "SELECT a.n_nationkey AS src, b.n_nationkey AS dst, abs(a.n_nationkey - b.n_nationkey)::DOUBLE AS w FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey"


def spatial(spark, d, base=None):
    f = flow(spark, d, base).filter("src <> dst")
    return f.crossJoin(F.broadcast(f.agg(F.max("n").alias("m")))).select("src", "dst", (F.col("n") / F.col("m")).alias("w"))


def distance(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    return n.join(n.toDF("dst"), F.col("src") != F.col("dst")).select("src", "dst", F.abs(F.col("src") - F.col("dst")).cast("double").alias("w"))


COMM = f"""WITH nodes AS ({NODES}), v AS ({NODE_EXPR}), sp AS ({SPATIAL}), di AS ({DISTANCE}), ca AS ({CAUSAL}),
p AS (SELECT lr.*, a.node AS src, b.node AS dst FROM {CHAINS_SQL} JOIN nodes a ON a.node_type = source_type JOIN nodes b ON b.node_type = target_type WHERE a.node <> b.node),
e AS (SELECT p.*, ((coalesce(v1.value, 0) > 0)::INT + (coalesce(v2.value, 0) > 0)::INT + (coalesce(v3.value, 0) > 0)::INT + (coalesce(v4.value, 0) > 0)::INT) / 4.0::DOUBLE AS support,
exp(-(0.5 * di.w / (SELECT max(w) FROM di) + 0.5 * (1 - coalesce(sp.w, 0)))) AS weight, f.src IS NOT NULL AS fwd, r.src IS NOT NULL AS rev,
concat_ws(';', CASE WHEN v1.value IS NULL THEN ligand END, CASE WHEN v2.value IS NULL THEN receptor END, CASE WHEN v3.value IS NULL THEN tf END, CASE WHEN v4.value IS NULL THEN target END) AS missing_genes
FROM p LEFT JOIN v v1 ON v1.node = p.src AND v1.gene = ligand LEFT JOIN v v2 ON v2.node = p.dst AND v2.gene = receptor LEFT JOIN v v3 ON v3.node = p.dst AND v3.gene = tf LEFT JOIN v v4 ON v4.node = p.dst AND v4.gene = target
LEFT JOIN sp ON sp.src = p.src AND sp.dst = p.dst LEFT JOIN di ON di.src = p.src AND di.dst = p.dst LEFT JOIN ca f ON f.src = p.src AND f.dst = p.dst LEFT JOIN ca r ON r.src = p.dst AND r.dst = p.src),
edges AS (SELECT *, support * weight AS flow_score, CASE WHEN fwd AND rev THEN 'ambiguous' WHEN fwd THEN 'forward' WHEN rev THEN 'reverse' ELSE 'unresolved' END AS direction_status FROM e)"""


def communication(spark, d):
    base = traffic(spark, d)
    return G.communication(chains(spark), nodes(spark, d), node_expr(spark, d, base), spatial(spark, d, base), distance(spark, d), causal(spark, d, base=base))


@query("communication_flow", f"{COMM} SELECT pathway, ligand, receptor, tf, target, src, dst, missing_genes, round(flow_score, 6) AS flow_score, round(flow_score / max(flow_score) OVER (), 6) AS normalized_flow, direction_status FROM edges")
def communication_flow(spark, d):
    return rounded(communication(spark, d).select("pathway", "ligand", "receptor", "tf", "target", "src", "dst", "missing_genes", "flow_score", "normalized_flow", "direction_status"))


@query("direction_consistency", f"{COMM}, s AS (SELECT pathway, count(*)::BIGINT AS n_edges, count(*) FILTER (direction_status <> 'unresolved')::BIGINT AS resolved, count(*) FILTER (direction_status = 'forward')::BIGINT AS n_forward, count(*) FILTER (direction_status = 'reverse')::BIGINT AS n_reverse, count(*) FILTER (direction_status = 'ambiguous')::BIGINT AS n_ambiguous, count(*) FILTER (direction_status = 'unresolved')::BIGINT AS n_unresolved, coalesce(sum(flow_score) FILTER (direction_status = 'forward'), 0) AS num, sum(flow_score) FILTER (direction_status <> 'unresolved') AS den FROM edges GROUP BY GROUPING SETS ((pathway), ())) SELECT pathway, n_edges, resolved, n_forward, n_reverse, n_ambiguous, n_unresolved, round(n_forward / greatest(resolved, 1)::DOUBLE, 6) AS rate, round(CASE WHEN den > 0 THEN num / den ELSE 0 END, 6) AS weighted_rate FROM s")
def direction_consistency(spark, d):
    out = G.direction_consistency(communication(spark, d))
    return rounded(out.select("pathway", "n_edges", "resolved", "n_forward", "n_reverse", "n_ambiguous", "n_unresolved", "rate", "weighted_rate"))


@query("pathway_summary", f"{COMM} SELECT pathway, count(*)::BIGINT AS n_edges, round(sum(flow_score), 5) AS total_flow, round(avg(flow_score), 6) AS mean_flow, round(max(flow_score), 6) AS max_flow, arg_max(src, (round(flow_score, 9), -src, -dst)) AS top_source, arg_max(dst, (round(flow_score, 9), -src, -dst)) AS top_target FROM edges GROUP BY pathway")
def pathway_summary(spark, d):
    out = G.pathway_summary(communication(spark, d))
    return out.select("pathway", "n_edges", F.round("total_flow", 5).alias("total_flow"), F.round("mean_flow", 6).alias("mean_flow"), F.round("max_flow", 6).alias("max_flow"), "top_source", "top_target")


SIGNAL = f"""WITH nodes AS ({NODES}), ca AS ({CAUSAL}), h AS (SELECT node_type, gene, max(value) AS v FROM ({NODE_EXPR}) JOIN nodes USING (node) GROUP BY ALL),
g AS (SELECT a.node_type AS source_type, b.node_type AS target_type, max(w) AS w FROM ca JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst GROUP BY ALL),
r AS (SELECT lr.*, w, coalesce(h1.v, 0) AS v1, coalesce(h2.v, 0) AS v2, coalesce(h3.v, 0) AS v3, coalesce(h4.v, 0) AS v4 FROM {CHAINS_SQL} JOIN g USING (source_type, target_type) LEFT JOIN h h1 ON h1.node_type = source_type AND h1.gene = ligand LEFT JOIN h h2 ON h2.node_type = target_type AND h2.gene = receptor LEFT JOIN h h3 ON h3.node_type = target_type AND h3.gene = tf LEFT JOIN h h4 ON h4.node_type = target_type AND h4.gene = target),
s AS (SELECT *, w * ((CASE WHEN v1 > 0.1 THEN 1 ELSE 0.3 END) + (CASE WHEN v2 > 0.1 THEN 1 ELSE 0.3 END) + (CASE WHEN v3 > 0.1 THEN 1 ELSE 0.3 END) + (CASE WHEN v4 > 0.1 THEN 1 ELSE 0.3 END)) / 4 AS s, source_type || '->' || target_type AS causal_edge FROM r),
edges AS (SELECT pathway, causal_edge, 0 AS source_layer, 1 AS target_layer, ligand AS source, receptor AS target, s AS weight, v1 AS source_value, v2 AS target_value FROM s UNION ALL SELECT pathway, causal_edge, 1, 2, receptor, tf, s * 0.8, v2, v3 FROM s UNION ALL SELECT pathway, causal_edge, 2, 3, tf, target, s * 0.6, v3, v4 FROM s)"""


def signal(spark, d, base=None):
    base = traffic(spark, d) if base is None else base
    return G.signal_flow(chains(spark), nodes(spark, d), node_expr(spark, d, base), causal(spark, d, base=base))


@query("signal_flow_edges", f"{SIGNAL} SELECT pathway, causal_edge, source_layer, target_layer, source, target, round(weight, 6) AS weight FROM edges")
def signal_flow_edges(spark, d):
    return rounded(signal(spark, d).select("pathway", "causal_edge", "source_layer", "target_layer", "source", "target", "weight"))


@query("flow_completeness", f"{SIGNAL} SELECT pathway, count(*)::BIGINT AS n_edges, round(avg(weight), 6) AS mean_weight, bool_or(source_layer = 0) AND bool_or(source_layer = 1) AND bool_or(source_layer = 2) AND bool_or(target_layer = 3) AS complete FROM edges GROUP BY pathway")
def flow_completeness(spark, d):
    return rounded(G.flow_completeness(signal(spark, d)))


MECH = f"""{SIGNAL}, c AS (SELECT a.pathway, a.causal_edge, a.source AS ligand, a.target AS receptor, coalesce(b.target, '') AS tf, coalesce(t.target, '') AS downstream, a.source_value AS lv, a.target_value AS rv, coalesce(t.target_value, 0) AS tv, (a.weight + coalesce(b.weight, 0) + coalesce(t.weight, 0)) / (1 + (b.weight IS NOT NULL)::INT + (t.weight IS NOT NULL)::INT) AS edge_weight FROM edges a LEFT JOIN edges b ON b.source_layer = 1 AND b.pathway = a.pathway AND b.causal_edge = a.causal_edge AND b.source = a.target LEFT JOIN edges t ON t.source_layer = 2 AND t.pathway = a.pathway AND t.causal_edge = a.causal_edge AND t.source = b.target WHERE a.source_layer = 0)"""


@query("mechanism_chains", f"{MECH} SELECT pathway, causal_edge, ligand, receptor, tf, downstream, round(edge_weight, 6) AS edge_weight FROM c")
def mechanism_chains(spark, d):
    return rounded(G.mechanism_chains(signal(spark, d)).select("pathway", "causal_edge", "ligand", "receptor", "tf", "downstream", "edge_weight"))


RANKING = "SELECT p_brand AS gene, row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS rank FROM part GROUP BY p_brand"
EVIDENCE = f"""{MECH}, rk AS ({RANKING}), m AS (SELECT DISTINCT gene, rank, c.* FROM rk JOIN c ON gene IN (ligand, receptor, tf, downstream) WHERE rank <= 12),
ev AS (SELECT gene, rank, pathway, causal_edge, ligand, receptor, tf, downstream, 0.35 + 0.25 * (least(1, greatest(0, lv)) + least(1, greatest(0, rv)) + (tf <> '')::INT + least(1, greatest(0, tv))) / 4 + 0.25 * least(1, greatest(0, edge_weight)) AS mechanism_score FROM m)"""


def ranking(spark, d):
    from pyspark.sql import Window

    means = table(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.avg("p_retailprice").alias("v"))
    return means.select("gene", F.row_number().over(Window.orderBy(F.col("v").desc(), "gene")).alias("rank"))


def evidence(spark, d):
    return G.mechanism_evidence(ranking(spark, d), G.mechanism_chains(signal(spark, d)), 12)


@query("mechanism_evidence", f"{EVIDENCE} SELECT gene, rank, pathway, ligand, receptor, tf, downstream, round(mechanism_score, 6) AS mechanism_score FROM ev")
def mechanism_evidence(spark, d):
    return rounded(evidence(spark, d).drop("causal_edge")).withColumn("rank", F.col("rank").cast("bigint"))


@query("mechanism_scores", f"{EVIDENCE} SELECT rk.gene, rk.rank::BIGINT AS rank, round(coalesce(max(mechanism_score), 0), 6) AS mechanism_score FROM rk LEFT JOIN ev ON ev.gene = rk.gene GROUP BY rk.gene, rk.rank")
def mechanism_scores(spark, d):
    return rounded(G.append_best(ranking(spark, d), evidence(spark, d))).withColumn("rank", F.col("rank").cast("bigint"))


AXES = "SELECT source_type, target_type FROM (VALUES ('ASIA', 'EUROPE'), ('EUROPE', 'AMERICA'), ('AFRICA', 'ASIA'), ('AMERICA', 'MIDDLE EAST')) AS v(source_type, target_type)"


@query("known_axes", f"WITH nodes AS ({NODES}), ca AS ({CAUSAL}), t AS (SELECT DISTINCT a.node_type AS s, b.node_type AS t FROM ca JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst) SELECT source_type, target_type, (source_type, target_type) IN (SELECT (s, t) FROM t) AS found, (target_type, source_type) IN (SELECT (s, t) FROM t) AS reverse_found FROM ({AXES})")
def known_axes(spark, d):
    axes = spark.createDataFrame([("ASIA", "EUROPE"), ("EUROPE", "AMERICA"), ("AFRICA", "ASIA"), ("AMERICA", "MIDDLE EAST")], "source_type string, target_type string")
    return G.known_axes(axes, nodes(spark, d), causal(spark, d))


PRIOR = "SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 0.3::DOUBLE AS w FROM nation"


@query("prior_injection", f"WITH ca AS ({CAUSAL}) SELECT src, dst, round(w, 6) AS w, false AS is_prior FROM ca UNION ALL SELECT src, dst, w, true FROM ({PRIOR}) WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ca) AND (dst, src) NOT IN (SELECT (src, dst) FROM ca)")
def prior_injection(spark, d):
    prior = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"), F.lit(0.3).alias("w"))
    return rounded(G.inject_prior(causal(spark, d), prior))


KNOCK = f"SELECT node, node_type, gene, value, value * CASE WHEN gene = 'Brand#1' AND node_type = 'ASIA' THEN 0.2 WHEN gene = 'Brand#2' AND node_type = 'EUROPE' THEN 0.6 ELSE 1 END AS counterfactual FROM ({NODE_EXPR}) JOIN ({NODES}) USING (node)"


def knocked(spark, d, base=None):
    return G.knockout(node_expr(spark, d, base), nodes(spark, d), "Brand#1", "ASIA", "Brand#2", "EUROPE", 0.8)


@query("knockout_effects", f"SELECT node_type, gene, round(avg(counterfactual) - avg(value), 6) + 0.0 AS delta FROM ({KNOCK}) GROUP BY ALL HAVING abs(avg(counterfactual) - avg(value)) > 1e-9")
def knockout_effects(spark, d):
    out = knocked(spark, d).groupBy("node_type", "gene").agg((F.avg("counterfactual") - F.avg("value")).alias("delta")).filter(F.abs("delta") > 1e-9)
    return out.withColumn("delta", F.round("delta", 6) + 0.0)


CF = f"""{SIGNAL}, kn AS ({KNOCK}), t AS (SELECT node_type, gene, avg(counterfactual) - avg(value) AS d FROM kn GROUP BY ALL), a AS (SELECT gene, avg(counterfactual) - avg(value) AS d FROM kn GROUP BY ALL),
z AS (SELECT e.*, coalesce(t1.d, a1.d, 0) AS dl, coalesce(t2.d, a2.d, 0) AS dr FROM edges e LEFT JOIN t t1 ON t1.gene = source AND t1.node_type = split_part(causal_edge, '->', 1) LEFT JOIN t t2 ON t2.gene = target AND t2.node_type = split_part(causal_edge, '->', 2) LEFT JOIN a a1 ON a1.gene = source LEFT JOIN a a2 ON a2.gene = target WHERE source_layer = 0),
cf AS (SELECT upper(source) AS ligand, upper(target) AS receptor, causal_edge, pathway, abs(dl) + abs(dr) AS combined_delta, source = 'Brand#1' AND target = 'Brand#2' AS prior_hit, weight * (abs(dl) + abs(dr)) * CASE WHEN source = 'Brand#1' AND target = 'Brand#2' THEN 1.25 ELSE 1 END AS score FROM z WHERE abs(dl) + abs(dr) >= 1e-4)"""



def ranked_cf(spark, d):
    prior = spark.createDataFrame([("Brand#1", "Brand#2")], "ligand string, receptor string")
    base = traffic(spark, d)
    return G.counterfactual_rank(signal(spark, d, base), knocked(spark, d, base), prior, 1e-4, 50)


@query("counterfactual_ranking", f"{CF} SELECT ligand, receptor, causal_edge, round(combined_delta, 6) AS combined_delta, prior_hit, round(score, 6) AS score FROM cf")
def counterfactual_ranking(spark, d):
    return rounded(ranked_cf(spark, d).select("ligand", "receptor", "causal_edge", "combined_delta", "prior_hit", "score"))


FDR_IN = f"SELECT src, dst, qty / 1000.0 - 2 AS score, n::DOUBLE AS size, (src + dst) % 11 = 0 AS prior_hit FROM ({FLOW})"


@query("fdr_filter", f"WITH r AS ({FDR_IN}), s AS (SELECT avg(score) AS m, quantile_cont(size, 0.7) AS cut, count(*)::DOUBLE AS n FROM r), f AS (SELECT r.*, cut, least(1, greatest(0, (SELECT count(*) FROM r x, s WHERE abs(x.score - s.m) >= abs(r.score)) / n / greatest((SELECT count(*) FROM r x WHERE abs(x.score) >= abs(r.score)) / n, 1e-8))) AS fdr FROM r, s) SELECT src, dst, round(fdr, 5) AS empirical_fdr, score >= 0.02 AND fdr <= 0.9 AND (prior_hit OR size >= cut) AS pass_filter FROM f")
def fdr_filter(spark, d):
    rows = flow(spark, d).select("src", "dst", (F.col("qty") / 1000.0 - 2).alias("score"), F.col("n").cast("double").alias("size"), ((F.col("src") + F.col("dst")) % 11 == 0).alias("prior_hit"))
    return G.false_positive_filter(rows, "score", "size", max_fdr=0.9).select("src", "dst", F.round("empirical_fdr", 5).alias("empirical_fdr"), "pass_filter")


NORM = f"(SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM ({CAUSAL}))"
NORM_SP = f"(SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM ({SPATIAL}))"
STEPS = [0.0, 1.0, 2.0, 4.0]


def _spread_sql() -> str:
    parts = [f"a AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 0.7 * w AS w FROM {NORM} UNION ALL SELECT src, dst, 0.3 * w FROM {NORM_SP}) GROUP BY ALL)", "x0 AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS effect FROM nation)"]
    for i in range(1, len(STEPS)):
        dt = STEPS[i] - STEPS[i - 1]
        parts.append(f"x{i} AS (SELECT x.node, least(1, greatest(0, effect * (1 - 0.08 * {dt}) + 0.35 * {dt} * coalesce(g, 0))) AS effect FROM x{i - 1} x LEFT JOIN (SELECT dst AS node, sum(w * effect) AS g FROM a JOIN x{i - 1} ON src = node GROUP BY dst) USING (node))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {i} AS step, node, round(effect, 6) AS effect FROM x{i}" for i in range(len(STEPS)))


@query("temporal_diffusion", _spread_sql())
def temporal_diffusion(spark, d):
    start = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 5 == 0, 1.0).otherwise(0.0).alias("effect"))
    base = traffic(spark, d)
    return rounded(G.temporal_spread(start, STEPS, causal(spark, d, base=base), spatial(spark, d, base)))


@query("hop_propagation", f"WITH ca AS (SELECT src, dst FROM ({CAUSAL}) WHERE w > 0.045), n AS (SELECT dst AS node, count(*) AS n FROM ca GROUP BY dst), h0 AS (SELECT 0 AS node, 0 AS hop, 1.0::DOUBLE AS effect), h1 AS (SELECT dst AS node, 1 AS hop, sum(effect) / any_value(n.n) AS effect FROM ca JOIN h0 ON src = h0.node JOIN n ON n.node = dst WHERE dst NOT IN (SELECT node FROM h0) GROUP BY dst), s1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1), h2 AS (SELECT dst AS node, 2 AS hop, sum(effect) / any_value(n.n) AS effect FROM ca JOIN s1 ON src = s1.node JOIN n ON n.node = dst WHERE dst NOT IN (SELECT node FROM s1) GROUP BY dst) SELECT node, hop, round(effect, 6) AS effect FROM s1 UNION ALL SELECT node, hop, round(effect, 6) FROM h2")
def hop_propagation(spark, d):
    start = spark.createDataFrame([(0, 1.0)], "node int, effect double")
    return rounded(G.hop_propagation(causal(spark, d).filter("w > 0.045").select("src", "dst"), start, 2))


@query("relaxed_flow", f"WITH ca AS ({CAUSAL}), k AS (SELECT src, dst, w FROM ca WHERE w > 0.045), b AS (SELECT 1 AS part, src, dst, w FROM k UNION ALL SELECT 1, dst, src, w FROM k UNION ALL SELECT 2, src, dst, w FROM k) SELECT part, src, dst, round(max(w), 6) AS w FROM b GROUP BY ALL")
def relaxed_flow(spark, d):
    """GRA11: a graph whose flow found nothing gets its edges turned round (part 1), another is left as it is (part 2)."""
    base = traffic(spark, d)
    edges = causal(spark, d, 0.045, base)
    none, some = (flow(spark, d, base).filter(c) for c in ("qty < 0", "qty > 0"))
    return rounded(G.symmetric_if_empty(edges, none).withColumn("part", F.lit(1)).union(G.symmetric_if_empty(edges, some).withColumn("part", F.lit(2))))


@query("cluster_adjacency", f"WITH f AS (SELECT src, dst, n::DOUBLE AS w FROM ({FLOW})), c AS (SELECT node, node_type FROM ({NODES})), k AS (SELECT node_type, count(*) AS k FROM c GROUP BY ALL), s AS (SELECT a.node_type AS ci, b.node_type AS cj, sum(w) AS w FROM f JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.node_type <> b.node_type GROUP BY ALL), v AS (SELECT ci, cj, w / (ka.k * kb.k + 1e-10) AS w FROM s JOIN k ka ON ka.node_type = ci JOIN k kb ON kb.node_type = cj) SELECT ci, cj, round(w / max(w) OVER (), 6) AS w FROM v")
def cluster_adjacency(spark, d):
    edges = flow(spark, d).select("src", "dst", F.col("n").cast("double").alias("w"))
    return rounded(G.cluster_adjacency(edges, nodes(spark, d).select(F.col("node").alias("id"), F.col("node_type").alias("cluster"))))


@query("weighted_degree_targets", f"{SIGNAL} SELECT gene, round(sum(s), 6) AS score FROM (SELECT source AS gene, greatest(weight, 1e-6) AS s FROM edges UNION ALL SELECT target, 0.5 * greatest(weight, 1e-6) FROM edges) GROUP BY gene")
def weighted_degree_targets(spark, d):
    return rounded(G.weighted_degree(signal(spark, d)))


@query("niche_map", f"SELECT gene, arg_max(node, (round(value, 9), -node)) AS node, round(max(value), 6) AS value FROM ({NODE_EXPR}) GROUP BY gene")
def niche_map(spark, d):
    return rounded(G.best_node(node_expr(spark, d)))


@query("graph_comparison", f"WITH a AS (SELECT src, dst FROM ({CAUSAL})), b AS (SELECT src, dst FROM ({FLOW}) WHERE qty > 2500), c AS (SELECT src, dst FROM ({DISTANCE}) WHERE w <= 3) SELECT count(*)::BIGINT AS n_edges, count(*) FILTER ((src, dst) IN (SELECT (src, dst) FROM b))::BIGINT AS in_baseline, count(*) FILTER ((src, dst) IN (SELECT (src, dst) FROM c))::BIGINT AS in_spatial, count(*) FILTER ((src, dst) NOT IN (SELECT (src, dst) FROM b))::BIGINT AS only_causal FROM a")
def graph_comparison(spark, d):
    return G.known_relations(causal(spark, d), flow(spark, d).filter("qty > 2500"), distance(spark, d).filter("w <= 3"))


DOSES = [0.5, 1.0, 2.0, 4.0]
TIMES = [0.0, 1.0, 2.0, 4.0, 8.0, 12.0, 24.0]
PK = f"SELECT dose, i, t, greatest(0, dose * 1.2 / (1.2 - 0.18) * (exp(-0.18 * t) - exp(-1.2 * t))) AS c FROM (SELECT unnest({DOSES}::DOUBLE[]) AS dose) CROSS JOIN (SELECT unnest(range({len(TIMES)})) AS i, unnest({TIMES}::DOUBLE[]) AS t)"


def grid(spark):
    return D.pk_grid(spark.createDataFrame([(x,) for x in DOSES], "dose double"), TIMES)


@query("pkpd_grid", f"SELECT dose, t, round(c, 6) AS concentration, round(pow(c, 1.2) / (pow(0.8, 1.2) + pow(c, 1.2) + 1e-12), 6) AS effect FROM ({PK})")
def pkpd_grid(spark, d):
    return rounded(grid(spark).select("dose", "t", "concentration", D.hill(F.col("concentration"), 1.0, 0.8, 1.2).alias("effect")))


@query("dose_response_summary", f"WITH g AS (SELECT dose, i, c, pow(c, 1.2) / (pow(0.8, 1.2) + pow(c, 1.2) + 1e-12) AS e FROM ({PK})), l AS (SELECT *, (c + lag(c) OVER w) / 2 AS ac, (e + lag(e) OVER w) / 2 AS ae FROM g WINDOW w AS (PARTITION BY dose ORDER BY i)) SELECT dose, round(sum(ac), 6) AS auc_concentration, round(sum(ae), 6) AS auc_effect, round(max(e), 6) AS max_effect, round(avg(e), 6) AS mean_effect FROM l GROUP BY dose")
def dose_response_summary(spark, d):
    return rounded(D.dose_summary(grid(spark), 1.0, 0.8, 1.2))


@query("combination_ranking", "WITH e AS (SELECT r_name AS name, (r_regionkey + 1) / 7.0::DOUBLE AS e FROM region), c AS (SELECT name AS combo, 1 AS size, e AS effect, 0.0::DOUBLE AS excess FROM e UNION ALL SELECT a.name || '+' || b.name, 2, 1 - (1 - a.e) * (1 - b.e), 1 - (1 - a.e) * (1 - b.e) - (a.e + b.e - a.e * b.e) FROM e a JOIN e b ON a.name < b.name), r AS (SELECT combo, size, round(effect, 9) AS effect, round(excess, 9) AS excess FROM c) SELECT combo, size, round(effect, 6) AS effect, row_number() OVER (ORDER BY effect DESC, excess DESC, combo)::BIGINT AS rank FROM r")
def combination_ranking(spark, d):
    r = table(spark, d, "region")
    e = r.select(F.col("r_name").alias("name"), ((F.col("r_regionkey") + 1) / 7.0).alias("effect"))
    out = D.rank_combinations(e, S.combinations(r.select(F.col("r_name").alias("name")), 2))
    return out.select("combo", "size", F.round("effect", 6).alias("effect"), "rank")


TRIP = "SELECT event_type AS gene, (json_extract(props, '$.k')::INT % 10 + 1)::DOUBLE AS dose, value / 100 AS effect_size FROM events"


def roundtrip(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("gene"), (F.get_json_object("props", "$.k").cast("int") % 10 + 1).cast("double").alias("dose"), (F.col("value") / 100).alias("effect_size"))


@query("roundtrip_effects", f"SELECT gene, count(*)::BIGINT AS n_rows, round(avg(effect_size), 6) AS mean_effect, round(stddev_pop(effect_size), 6) AS std_effect, (SELECT round(avg(effect_size), 6) FROM ({TRIP}) x WHERE x.gene = t.gene AND dose = 3) AS effect_at_3 FROM ({TRIP}) t GROUP BY gene")
def roundtrip_effects(spark, d):
    out = D.effect_summary(roundtrip(spark, d))
    return rounded(out.withColumn("effect_at_3", F.element_at("dose_effect", F.lit(3.0))).drop("dose_effect"))


@query("roundtrip_calibration", f"WITH m AS (SELECT gene, dose, avg(effect_size) AS e FROM ({TRIP}) GROUP BY ALL), h AS (SELECT gene, dose, round(abs(abs(e) - 0.5 * max(abs(e)) OVER (PARTITION BY gene)), 9) AS d FROM m), b AS (SELECT gene, arg_min(dose, (d, dose)) AS dose FROM h GROUP BY gene), g AS (SELECT gene, abs(avg(effect_size)) AS m FROM ({TRIP}) GROUP BY gene) SELECT round(least(2.0, greatest(0.1, (SELECT avg(m) FROM g))), 6) AS emax, round(least(20.0, greatest(0.05, (SELECT avg(dose) FROM b))), 6) AS ec50")
def roundtrip_calibration(spark, d):
    return rounded(D.calibrate(D.effect_summary(roundtrip(spark, d))))


SERIES = "SELECT event_type AS name, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS t, sum(value) AS value FROM events GROUP BY ALL"


@query("lagged_graph", f"WITH s AS ({SERIES}), p AS (SELECT a.name AS a, b.name AS b, lag, corr(a.value, b.value) AS r FROM s a CROSS JOIN (SELECT unnest([1, 2]) AS lag) JOIN s b ON b.t = a.t + lag AND a.name <> b.name GROUP BY a.name, b.name, lag), m AS (SELECT a, b, arg_max(lag, (round(abs(r), 9), -lag)) AS lag, max(round(abs(r), 9)) AS r FROM p GROUP BY a, b) SELECT a, b, lag, round(r, 5) AS r FROM m WHERE r >= 0.05")
def lagged_graph(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy(F.col("event_type").alias("name"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("t")).agg(F.sum("value").alias("value"))
    return rounded(D.lagged_graph(s, 2, 0.05), 5)


RULES = ["In ASIA cells, Brand#1 increases migration with a hill response, base 0.1, max 0.9, half-max 10, hill 2", "In EUROPE cells, Brand#2 decreases growth with a linear response, base 0, max 1, half-max 30, hill 1", "In AFRICA cells, Brand#3 decreases growth with a step response, base 0.2, max 0.8, half-max 25.5, hill 1"]


def rules(spark):
    return D.parse_rules(spark.createDataFrame([(r,) for r in RULES], "statement string"))


#: A rule for each nation and one of eight brands, as columns and as a sentence; numbers as both engines write them.
RULE_TABLE = "SELECT n_name AS cell_type, 'Brand#' || (1 + k) AS signal, CASE WHEN (n_nationkey + k) % 2 = 0 THEN 'increases' ELSE 'decreases' END AS direction, CASE (n_nationkey + k) % 3 WHEN 0 THEN 'migration' WHEN 1 THEN 'cell growth' ELSE 'exhaustion' END AS behavior, CASE k % 3 WHEN 0 THEN 'hill' WHEN 1 THEN 'linear' ELSE 'step' END AS response, n_regionkey / 8.0::DOUBLE AS base, 1 + k / 4.0::DOUBLE AS saturation, n_nationkey + 0.5::DOUBLE AS half_max, 1.0::DOUBLE + k AS hill_power FROM nation, (SELECT unnest(range(8)) AS k)"
SHORT = "regexp_replace(regexp_replace(printf('%.6f', {}), '0+$', ''), '\\.$', '')"


def rule_table(spark, d):
    n, k = F.col("n_nationkey"), F.col("k")
    rows = table(spark, d, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return rows.select(F.col("n_name").alias("cell_type"), F.concat(F.lit("Brand#"), (k + 1).cast("string")).alias("signal"), F.when((n + k) % 2 == 0, "increases").otherwise("decreases").alias("direction"), F.when((n + k) % 3 == 0, "migration").when((n + k) % 3 == 1, "cell growth").otherwise("exhaustion").alias("behavior"), F.when(k % 3 == 0, "hill").when(k % 3 == 1, "linear").otherwise("step").alias("response"), (F.col("n_regionkey") / 8.0).alias("base"), (1 + k / 4.0).alias("saturation"), (n + 0.5).alias("half_max"), (k + 1.0).alias("hill_power"))


@query("rule_parsing", RULE_TABLE)
def rule_parsing(spark, d):
    """SCA7: the columns that are read back from each rule's sentence."""
    r = rule_table(spark, d)
    number = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("In "), "cell_type", F.lit(" cells, "), "signal", F.lit(" "), "direction", F.lit(" "), "behavior", F.lit(" with a "), "response", F.lit(" response, base "), number("base"), F.lit(", max "), number("saturation"), F.lit(", half-max "), number("half_max"), F.lit(", hill "), number("hill_power"))
    return D.parse_rules(r.select(text.alias("statement"))).drop("statement")


@query("rule_rendering", "SELECT 'In ' || cell_type || ' cells, ' || signal || ' ' || direction || ' ' || behavior || ' with a ' || response || ' response, base ' || " + SHORT.format("base") + " || ', max ' || " + SHORT.format("saturation") + " || ', half-max ' || " + SHORT.format("half_max") + " || ', hill ' || " + SHORT.format("hill_power") + f" AS statement FROM ({RULE_TABLE})")
def rule_rendering(spark, d):
    """SCA7: each rule's sentence, read and written again."""
    return D.render_rules(D.parse_rules(D.render_rules(rule_table(spark, d)).select("statement")).drop("statement")).select("statement")


@query("rule_responses", f"WITH v AS ({NODE_EXPR}) SELECT node, gene, round(CASE gene WHEN 'Brand#1' THEN 0.1 + 0.8 * pow(value, 2) / (pow(10, 2) + pow(value, 2) + 1e-12) WHEN 'Brand#2' THEN 1 - least(1, value / 30) ELSE 0.2 + 0.6 * (value < 25.5)::INT END, 6) AS response_value FROM v WHERE gene IN ('Brand#1', 'Brand#2', 'Brand#3')")
def rule_responses(spark, d):
    both = node_expr(spark, d).join(F.broadcast(rules(spark)), F.col("gene") == F.col("signal"))
    value = D.response(F.col("value"), F.col("response"), F.col("direction"), F.col("base"), F.col("saturation"), F.col("half_max"), F.col("hill_power"))
    return both.select("node", "gene", F.round(value, 6).alias("response_value"))
