"""Queries over the end of a discovery run: hubs, combinations, type flows, rules and what-if runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import dosing
from ._register import query
from .bindings import FLOW, NODE_EXPR, NODES, RAW, flow, node_expr, nodes, raw_values, table
from .expression import rounded
from .flow import rules

RANK_ROWS = f"SELECT gene, source, row_number() OVER (ORDER BY sum(value) DESC, gene, source) AS rank FROM ({RAW}) GROUP BY gene, source"


def rank_rows(spark, d):
    from pyspark.sql import Window

    sums = raw_values(spark, d).groupBy("gene", "source").agg(F.sum("value").alias("s"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("s").desc(), "gene", "source")).cast("bigint")).drop("s")


@query("retained_hubs", f"SELECT gene, min(rank)::BIGINT AS rank FROM ({RANK_ROWS}) WHERE rank <= 30 GROUP BY gene")
def retained_hubs(spark, d):
    return D.hubs(rank_rows(spark, d))


RESULTS = f"SELECT src AS trigger_target, src || '->' || dst AS causal_edge, qty * (1 + dst % 3) AS target_priority_score, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS place FROM ({FLOW})"


def results(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "dst"))
    return flow(spark, d).select(F.col("src").alias("trigger_target"), F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")).alias("causal_edge"), (F.col("qty") * (1 + F.col("dst") % 3)).alias("target_priority_score"), place.alias("place"))


@query("target_combinations", f"SELECT trigger_target, causal_edge, target_priority_score, rank() OVER (ORDER BY target_priority_score DESC, trigger_target, causal_edge)::BIGINT AS combo_rank FROM ({RESULTS}) WHERE place <= 20")
def target_combinations(spark, d):
    return D.combinations(results(spark, d)).drop("place").withColumn("combo_rank", F.col("combo_rank").cast("bigint"))


EDGE_TEXT = f"SELECT src, dst, CASE (src + dst) % 3 WHEN 0 THEN src || '->' || dst || '->x' WHEN 1 THEN src || '→' || dst ELSE 'n' || src END AS edge, CASE WHEN n % 7 = 0 THEN NULL ELSE repeat('a;', (n % 4)::INT) || ';b' END AS parts FROM ({FLOW})"


@query("arrow_strings", f"SELECT src, dst, CASE WHEN contains(edge, '->') THEN substr(edge, 1, strpos(edge, '->') - 1) WHEN contains(edge, '→') THEN substr(edge, 1, strpos(edge, '→') - 1) ELSE edge END AS source_type, CASE WHEN contains(edge, '->') THEN substr(edge, strpos(edge, '->') + 2) WHEN contains(edge, '→') THEN substr(edge, strpos(edge, '→') + 1) ELSE '' END AS target_type, upper(array_to_string(list_filter(string_split(coalesce(parts, ''), ';'), lambda x: x <> ''), '+')) AS parts FROM ({EDGE_TEXT})")
def arrow_strings(spark, d):
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    kind = (F.col("src") + F.col("dst")) % 3
    edge = F.when(kind == 0, F.concat(a, F.lit("->"), b, F.lit("->x"))).when(kind == 1, F.concat(a, F.lit("→"), b)).otherwise(F.concat(F.lit("n"), a))
    parts = F.when(F.col("n") % 7 != 0, F.concat(F.repeat(F.lit("a;"), (F.col("n") % 4).cast("int")), F.lit(";b")))
    first, second = D.edge_ends(F.col("edge"))
    return flow(spark, d).select("src", "dst", edge.alias("edge"), parts.alias("p")).select("src", "dst", first.alias("source_type"), second.alias("target_type"), F.upper(F.array_join(D.list_parts(F.col("p")), "+")).alias("parts"))


TYPED_FLOW = f"SELECT a.node_type AS source_type, b.node_type AS target_type, CASE WHEN n % 5 <> 0 THEN n END AS w, qty - 2000 AS s, CASE WHEN n % 7 <> 0 THEN (n % 7) / 7.0::DOUBLE END AS x FROM ({FLOW}) JOIN ({NODES}) a ON a.node = src JOIN ({NODES}) b ON b.node = dst"


@query("type_flow_weights", f"SELECT source_type, target_type, round(sum(coalesce(w, 1) * greatest(coalesce(s, 0), 0) * greatest(coalesce(x, 0), 1e-6)), 4) AS flow FROM ({TYPED_FLOW}) GROUP BY ALL HAVING sum(coalesce(w, 1) * greatest(coalesce(s, 0), 0) * greatest(coalesce(x, 0), 1e-6)) > 0")
def type_flow_weights(spark, d):
    t = nodes(spark, d).select("node", "node_type")
    rows = flow(spark, d).join(t.toDF("src", "source_type"), "src").join(t.toDF("dst", "target_type"), "dst")
    rows = rows.select("source_type", "target_type", F.when(F.col("n") % 5 != 0, F.col("n")).alias("w"), (F.col("qty") - 2000).alias("s"), F.when(F.col("n") % 7 != 0, (F.col("n") % 7) / 7.0).alias("x"))
    return rounded(D.type_flow(rows, "w", "s", "x"), 4)


NICHES = f"SELECT gene, name AS niche, node FROM ({NODE_EXPR}) JOIN ({NODES}) USING (node) WHERE value > 25.5"
SCORED = f"SELECT gene, CASE WHEN count(*) % 4 <> 0 THEN sum(value) END AS final_score FROM ({RAW}) GROUP BY gene"


@query("ranking_with_niches", f"WITH s AS ({SCORED}), n AS (SELECT gene, arg_min(niche, node) AS niche FROM ({NICHES}) GROUP BY gene) SELECT gene, final_score, niche, row_number() OVER (ORDER BY final_score DESC NULLS LAST, gene)::BIGINT AS place FROM s LEFT JOIN n USING (gene)")
def ranking_with_niches(spark, d):
    scored = raw_values(spark, d).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).select("gene", F.when(F.col("n") % 4 != 0, F.col("s")).alias("final_score"))
    niches = node_expr(spark, d).filter("value > 25.5").join(nodes(spark, d), "node").select("gene", F.col("name").alias("niche"), "node")
    return D.ranking_with_niches(scored, niches, "node").withColumn("place", F.col("place").cast("bigint"))


#: Names of signals for the sizes of parts, in their order; further sizes are signals without a class.
NAMES = [n for names, _, _ in D.CLASSES for n in names]
GENE = f"coalesce(list_extract([{', '.join(repr(n) for n in NAMES)}], p_size), 'g' || p_size)"
NICHE = "CASE p_size % 4 WHEN 0 THEN 'Cd8 zone;x' WHEN 1 THEN NULL WHEN 2 THEN 'stromal' ELSE 'core' END"
SIZES = f"SELECT p_size, {GENE} AS gene, {NICHE} AS niche, (count(*) % 23) / 23.0::DOUBLE AS final_score FROM part GROUP BY p_size"
RULE_EDGES = f"SELECT {GENE} AS ligand, 'g' || (p_size + 1) AS receptor, 'S' || p_size AS source, 'T' || p_size AS target FROM (SELECT DISTINCT p_size FROM part WHERE p_size % 3 = 0)"


def _behavior_sql() -> str:
    out = []
    for names, mark, kind in D.CLASSES:
        fits = f"upper(gene) IN ({', '.join(repr(n) for n in names)})" + (f" OR contains(words, '{mark}')" if mark else "")
        value = f"CASE WHEN upper(gene) IN ({', '.join(repr(n) for n in D.ATTACK)}) THEN 'attack' ELSE '{kind}' END" if mark == "CD8" else f"'{kind}'"
        out.append(f"WHEN {fits} THEN {value}")
    return "CASE " + " ".join(out) + " WHEN source IS NOT NULL THEN 'secretion' ELSE 'transition' END"


RULES_SQL = f"""WITH r AS (SELECT * FROM ({SIZES}) ORDER BY final_score DESC, gene LIMIT 30), e AS ({RULE_EDGES}), x AS (SELECT upper(ligand) AS g, source, target FROM e UNION ALL SELECT upper(receptor), source, target FROM e),
i AS (SELECT g, min(struct_pack(source := source, target := target)) AS e FROM x GROUP BY g),
j AS (SELECT r.*, e.source AS source, upper(concat_ws(' ', gene, niche, e.source, e.target)) AS words FROM r LEFT JOIN i ON g = upper(gene)), b AS (SELECT *, {_behavior_sql()} AS behavior FROM j),
f AS (SELECT *, CASE WHEN behavior <> 'exhaustion' AND upper(gene) IN ({', '.join(repr(n) for n in D.FALLING)}) THEN 'decreases' ELSE 'increases' END AS direction FROM b)
SELECT coalesce(nullif(trim(string_split(niche, ';')[1]), ''), source, 'TME_cell') AS cell_type, gene AS signal, direction, behavior, 'hill' AS response, CASE direction WHEN 'increases' THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END AS base,
round(greatest(0.2::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + final_score)), 6) AS saturation, round(greatest(0.05::DOUBLE, 1 - least(final_score, 0.95::DOUBLE)), 6) AS half_max, 2.0::DOUBLE AS hill_power FROM f"""


@query("rules_from_ranking", RULES_SQL)
def rules_from_ranking(spark, d):
    size = F.col("p_size")
    named = lambda s: F.coalesce(F.get(F.array(*(F.lit(n) for n in NAMES)), s - 1), F.concat(F.lit("g"), s.cast("string")))
    niche = F.when(size % 4 == 0, "Cd8 zone;x").when(size % 4 == 2, "stromal").when(size % 4 == 3, "core")
    parts = table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    ranking = parts.select(named(size).alias("gene"), niche.alias("niche"), ((F.col("n") % 23) / 23.0).alias("final_score"))
    text = lambda mark, s: F.concat(F.lit(mark), s.cast("string"))
    edges = parts.filter(size % 3 == 0).select(named(size).alias("ligand"), text("g", size + 1).alias("receptor"), text("S", size).alias("source"), text("T", size).alias("target"))
    return rounded(D.rules_from_ranking(ranking, edges))


SIGNALS = f"SELECT node_type AS cell_type, gene AS signal, avg(value) AS value FROM ({NODE_EXPR}) JOIN ({NODES}) USING (node) GROUP BY ALL"
#: The three rules of flow.RULES: rule, type, signal, base, saturation.
RULE_ROWS = "(VALUES (0, 'ASIA', 'Brand#1', 0.1::DOUBLE, 0.9::DOUBLE), (1, 'EUROPE', 'Brand#2', 0::DOUBLE, 1::DOUBLE), (2, 'AFRICA', 'Brand#3', 0.2::DOUBLE, 0.8::DOUBLE)) AS r(rule, cell_type, signal, base, top)"


def _rate(top: str = "top", value: str = "value") -> str:
    return f"CASE rule WHEN 0 THEN base + ({top} - base) * pow({value}, 2) / (pow(10, 2) + pow({value}, 2) + 1e-12) WHEN 1 THEN -({top} - ({top} - base) * least(1, {value} / 30)) ELSE -(base + ({top} - base) * ({value} < 25.5)::INT) END"


def signals(spark, d):
    return node_expr(spark, d).join(nodes(spark, d), "node").groupBy(F.col("node_type").alias("cell_type"), F.col("gene").alias("signal")).agg(F.avg("value").alias("value"))


def signed_rules(spark):
    r = rules(spark)
    key = F.when(F.col("signal") == "Brand#1", 0).when(F.col("signal") == "Brand#2", 1).otherwise(2)
    return r.withColumns({"sign": F.when(F.col("behavior") == "growth", -1.0).otherwise(1.0), "rule": key})


@query("tissue_simulation", f"SELECT cell_type, step::INT AS step, round(pow(greatest(0, 1 + {_rate()} * 0.1), step), 6) AS population FROM {RULE_ROWS} JOIN ({SIGNALS}) USING (cell_type, signal), (SELECT unnest(range(11)) AS step)")
def tissue_simulation(spark, d):
    """Populations over time under the parsed rules."""
    return rounded(dosing.simulate(signed_rules(spark), signals(spark, d), 10, 0.1))


@query("rule_sensitivity", f"""WITH r AS (SELECT * FROM {RULE_ROWS} JOIN ({SIGNALS}) USING (cell_type, signal)), v AS (SELECT x.rule AS of, r.*, k, CASE WHEN r.rule <> x.rule THEN top WHEN k = 'plus' THEN top * 1.1 ELSE top * 0.9 END AS t FROM r CROSS JOIN (SELECT DISTINCT rule FROM r) x CROSS JOIN (SELECT unnest(['plus', 'minus']) AS k)),
p AS (SELECT of, k, sum(pow(greatest(0, 1 + {_rate('t')} * 0.1), 10)) AS n FROM v GROUP BY ALL), b AS (SELECT sum(pow(greatest(0, 1 + {_rate()} * 0.1), 10)) AS baseline FROM r), q AS (SELECT of AS rule, max(n) FILTER (k = 'plus') AS plus, max(n) FILTER (k = 'minus') AS minus FROM p GROUP BY of)
SELECT rule::INT AS rule, round(baseline, 6) AS baseline, round(plus, 6) AS plus, round(minus, 6) AS minus, round((plus - minus) / (2 * 0.1 * baseline), 6) AS sensitivity FROM q, b""")
def rule_sensitivity(spark, d):
    return rounded(D.sensitivity(signed_rules(spark), signals(spark, d), 10, 0.1))


SCENARIOS = {"none": {}, "half": {"Brand#1": 0.5}, "both": {"Brand#1": 2.0, "Brand#3": 0.5}}
FACTORS = "(VALUES " + ", ".join(f"('{s}', '{g}', {f}::DOUBLE)" for s, by in SCENARIOS.items() for g, f in by.items()) + ") AS f(scenario, signal, factor)"


@query("intervention_scenarios", f"WITH s AS (SELECT scenario, cell_type, signal, value * coalesce(factor, 1) AS v FROM ({SIGNALS}) CROSS JOIN (SELECT unnest(['none', 'half', 'both']) AS scenario) LEFT JOIN {FACTORS} USING (scenario, signal)) SELECT scenario, cell_type, round(pow(greatest(0, 1 + {_rate(value='v')} * 0.1), 10), 6) AS population FROM {RULE_ROWS} JOIN s USING (cell_type, signal)")
def intervention_scenarios(spark, d):
    return rounded(D.scenarios(signed_rules(spark), signals(spark, d), SCENARIOS, 10, 0.1))
