"""Queries over candidate pools and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ._register import query
from .bindings import CELLS, RAW, cells, raw_values, table

SOURCES = ("A", "N", "R")
EFFECTS = f"""SELECT gene, cell_type, source, avg(CASE WHEN response = 'F' THEN value END) - avg(CASE WHEN response = 'O' THEN value END) AS effect,
count(*) AS n FROM ({RAW}) JOIN ({CELLS}) USING (cell_id) WHERE response IN ('F', 'O') GROUP BY ALL
HAVING count(CASE WHEN response = 'F' THEN 1 END) > 0 AND count(CASE WHEN response = 'O' THEN 1 END) > 0"""
POOL = f"""SELECT gene, {', '.join(f"count(DISTINCT CASE WHEN source = '{s}' THEN cell_type END)::BIGINT AS n_groups_{s}" for s in SOURCES)},
(max(source = 'A')::INT + max(source = 'N')::INT + max(source = 'R')::INT) AS source_count, avg(effect) AS mean_effect, avg(abs(effect)) AS mean_abs_effect,
min(1 / (1 + abs(effect) * n)) AS min_p,
CASE WHEN sum(sign(effect)) > 0 THEN avg((effect > 0)::INT) WHEN sum(sign(effect)) < 0 THEN avg((effect < 0)::INT) ELSE 0.5 END AS direction_consistency
FROM ({EFFECTS}) GROUP BY gene"""


def effects(spark, d):
    """(gene, cell_type, source, effect, p): mean of cases less mean of controls; p falls with effect and rows."""
    rows = raw_values(spark, d).join(cells(spark, d).filter("response in ('F', 'O')"), "cell_id")
    case, control = F.when(F.col("response") == "F", F.col("value")), F.when(F.col("response") == "O", F.col("value"))
    out = rows.groupBy("gene", "cell_type", "source").agg((F.avg(case) - F.avg(control)).alias("effect"), F.count(F.lit(1)).alias("n"), F.count(case).alias("_f"), F.count(control).alias("_o"))
    out = out.filter("_f > 0 and _o > 0").drop("_f", "_o")
    return out.withColumn("p", 1 / (1 + F.abs("effect") * F.col("n")))


def pool(spark, d):
    return R.candidate_pool(effects(spark, d), sources=SOURCES)


@query("candidate_pool", f"SELECT gene, n_groups_A, n_groups_N, n_groups_R, source_count, round(mean_effect, 6) AS mean_effect, round(mean_abs_effect, 6) AS mean_abs_effect, round(min_p, 6) AS min_p, round(direction_consistency, 6) AS direction_consistency FROM ({POOL})")
def candidate_pool(spark, d):
    return pool(spark, d).select("gene", *(f"n_groups_{s}" for s in SOURCES), "source_count", *(F.round(c, 6).alias(c) for c in ("mean_effect", "mean_abs_effect", "min_p", "direction_consistency")))


RANKED = f"""SELECT gene, source_count, direction_consistency, round(-log10(greatest(min_p, 1e-300)), 9) AS neg_log10_p, round(mean_abs_effect, 9) AS mean_abs_effect FROM ({POOL})"""


@query("evidence_gated_ranking", f"""WITH p AS ({RANKED}), r AS (SELECT *, row_number() OVER (ORDER BY source_count DESC, direction_consistency DESC, neg_log10_p DESC, mean_abs_effect DESC, gene) AS rank, count(*) OVER () AS n FROM p)
SELECT gene, rank::BIGINT AS rank, source_count, CASE WHEN source_count >= 3 THEN 'three_source' WHEN source_count = 2 THEN 'two_source' WHEN source_count = 1 THEN 'single_source' ELSE 'unknown' END AS support_tier,
round(direction_consistency, 6) AS direction_consistency, round(neg_log10_p, 6) AS neg_log10_p, round(mean_abs_effect, 6) AS mean_abs_effect, round((n - rank + 1) / n::DOUBLE, 6) AS final_score FROM r""")
def evidence_gated_ranking(spark, d):
    """The flagship: candidates of three sources ranked by evidence alone."""
    rounded = pool(spark, d).withColumns({"neg_log10_p": F.round("neg_log10_p", 9), "mean_abs_effect": F.round("mean_abs_effect", 9)})
    out = R.evidence_gated_rank(rounded)
    return out.select("gene", "rank", "source_count", "support_tier", *(F.round(c, 6).alias(c) for c in ("direction_consistency", "neg_log10_p", "mean_abs_effect", "final_score")))


@query("legacy_weighted_ranking", f"""WITH p AS (SELECT *, -log10(greatest(min_p, 1e-300)) AS nl FROM ({POOL})), m AS (SELECT gene,
(nl - min(nl) OVER ()) / nullif(max(nl) OVER () - min(nl) OVER (), 0) AS a, (mean_abs_effect - min(mean_abs_effect) OVER ()) / nullif(max(mean_abs_effect) OVER () - min(mean_abs_effect) OVER (), 0) AS b, direction_consistency AS c FROM p),
s AS (SELECT gene, round(0.25 * a + 0.25 * b + 0.25 * c + 0.10 * a + 0.15 * b, 9) AS s FROM m)
SELECT gene, row_number() OVER (ORDER BY s DESC, gene)::BIGINT AS rank, round(s, 6) AS final_score FROM s""")
def legacy_weighted_ranking(spark, d):
    scaled = R.minmax_by(pool(spark, d), {"a": F.col("neg_log10_p"), "b": F.col("mean_abs_effect")})
    ranked = R.legacy_rank(scaled, {"causal": "a", "spatial": "b", "consistency": "direction_consistency", "actionability": "a", "niche": "b"})
    return ranked.select("gene", "rank", F.round("final_score", 6).alias("final_score"))


@query("initial_pool_score", f"""WITH p AS (SELECT *, -log10(greatest(min_p, 1e-300)) AS nl FROM ({POOL}))
SELECT gene, round(source_count * 2 + 1.5 * coalesce((mean_abs_effect - min(mean_abs_effect) OVER ()) / nullif(max(mean_abs_effect) OVER () - min(mean_abs_effect) OVER (), 0), 0)
+ 1.5 * coalesce((nl - min(nl) OVER ()) / nullif(max(nl) OVER () - min(nl) OVER (), 0), 0) + direction_consistency
+ 0.5 * coalesce((n_groups_A - min(n_groups_A) OVER ()) / nullif(max(n_groups_A) OVER () - min(n_groups_A) OVER (), 0)::DOUBLE, 0)
+ 0.5 * coalesce((n_groups_R - min(n_groups_R) OVER ()) / nullif(max(n_groups_R) OVER () - min(n_groups_R) OVER (), 0)::DOUBLE, 0), 5) AS init_score FROM p""")
def initial_pool_score(spark, d):
    return R.initial_score(pool(spark, d), "A", "R").select("gene", F.round("init_score", 5).alias("init_score"))


@query("topk_per_source", f"""SELECT source, gene, source_rank, round(score, 6) AS score FROM (SELECT source, gene, row_number() OVER (PARTITION BY source ORDER BY score DESC, gene) AS source_rank, score
FROM (SELECT source, gene, round(max(abs(effect)), 9) AS score FROM ({EFFECTS}) GROUP BY ALL)) WHERE source_rank <= 5""")
def topk_per_source(spark, d):
    best = effects(spark, d).groupBy("source", "gene").agg(F.round(F.max(F.abs("effect")), 9).alias("score"))
    return R.top_per_group(best, ["source"], [F.col("score").desc(), F.col("gene")], 5, "source_rank").select("source", "gene", "source_rank", F.round("score", 6).alias("score"))


PVALUES = "SELECT event_type, event_id, least(1.0, value / 400) AS p FROM events"


def pvalues(spark, d):
    return table(spark, d, "events").select("event_type", "event_id", F.least(F.lit(1.0), F.col("value") / 400).alias("p"))


@query("bh_adjusted", f"""WITH v AS ({PVALUES}), c AS (SELECT event_type, p, count(*) AS m FROM v GROUP BY ALL),
r AS (SELECT event_type, p, p * sum(m) OVER (PARTITION BY event_type) / sum(m) OVER (PARTITION BY event_type ORDER BY p) AS raw FROM c),
q AS (SELECT event_type, p, least(1, min(raw) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT event_id, round(q, 6) AS q FROM v JOIN q USING (event_type, p)""")
def bh_adjusted(spark, d):
    return R.benjamini_hochberg(pvalues(spark, d), "p", ["event_type"]).select("event_id", F.round("q", 6).alias("q"))


@query("holm_adjusted", """WITH v AS (SELECT user_id, event_type, min(value) / 40 AS p FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) AS rk, count(*) OVER (PARTITION BY user_id) AS m FROM v)
SELECT user_id, event_type, round(max(least(1.0, (m - rk + 1) * p)) OVER (PARTITION BY user_id ORDER BY rk ROWS UNBOUNDED PRECEDING), 6) AS adjusted_p FROM r""")
def holm_adjusted(spark, d):
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.min("value") / 40).alias("p"))
    return R.holm(v, "p", ["user_id"], [F.col("event_type")]).select("user_id", "event_type", F.round("adjusted_p", 6).alias("adjusted_p"))


SCORED = "SELECT doc_id, lang, (n_chars % 500)::DOUBLE AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)"


def scored(spark, d):
    """Labelled documents with a score that has many ties."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 500).cast("double").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("positive")), "doc_id")


@query("edge_metrics", f"""WITH s AS ({SCORED}), b AS (SELECT lang, score, count(*) AS m, count(*) FILTER (positive) AS t FROM s GROUP BY ALL),
c AS (SELECT *, sum(t) OVER w AS tp, sum(m) OVER w AS seen, sum(t) OVER (PARTITION BY lang) AS p, sum(m) OVER (PARTITION BY lang) AS total FROM b WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, sum(m)::BIGINT AS n, sum(t)::BIGINT AS positives, round(sum(t) / sum(m)::DOUBLE, 6) AS prevalence, round(coalesce(sum(t / nullif(p, 0)::DOUBLE * tp / seen), 0), 6) AS average_precision,
round(CASE WHEN sum(t) > 0 AND sum(m) > sum(t) THEN sum(t * ((total - seen - (p - tp)) + (m - t) / 2.0))::DOUBLE / (sum(t) * (sum(m) - sum(t))) END, 6) AS auroc FROM c GROUP BY lang""")
def edge_metrics(spark, d):
    out = R.ranking_metrics(scored(spark, d), "score", "positive", ["lang"])
    return out.select("lang", "n", "positives", *(F.round(c, 6).alias(c) for c in ("prevalence", "average_precision", "auroc")))


@query("precision_at_k", f"""WITH s AS ({SCORED}), t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 25), f AS (SELECT count(*) AS k, count(*) FILTER (positive) AS hits, min(score) AS cut FROM t)
SELECT k, round(hits / k::DOUBLE, 6) AS precision, round((count(*) FILTER (score > cut AND positive) + (k - count(*) FILTER (score > cut)) * (count(*) FILTER (score = cut AND positive))::DOUBLE / (count(*) FILTER (score = cut))) / k, 6) AS tie_aware_precision FROM s, f GROUP BY k, hits""")
def precision_at_k(spark, d):
    out = R.precision_at_k(scored(spark, d), "score", "positive", ["doc_id"], 25)
    return out.select("k", F.round("precision", 6).alias("precision"), F.round("tie_aware_precision", 6).alias("tie_aware_precision"))


@query("position_scores", "SELECT event_id, (count(*) OVER (PARTITION BY user_id) - (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1))::BIGINT AS position_score FROM events")
def position_scores(spark, d):
    return R.position_score(table(spark, d, "events").select("user_id", "event_id", "value"), [F.col("value").desc(), F.col("event_id")], ["user_id"]).select("event_id", "position_score")


@query("perturbation_targets", f"""WITH p AS ({RANKED}), r AS (SELECT gene, row_number() OVER (ORDER BY source_count DESC, direction_consistency DESC, neg_log10_p DESC, mean_abs_effect DESC, gene) AS rank FROM p)
SELECT gene, rank::BIGINT AS rank FROM r WHERE gene IN (SELECT p_brand FROM part WHERE p_size > 45) ORDER BY rank LIMIT 8""")
def perturbation_targets(spark, d):
    expressed = table(spark, d, "part").filter("p_size > 45").select(F.col("p_brand").alias("gene"))
    rounded = pool(spark, d).withColumns({"neg_log10_p": F.round("neg_log10_p", 9), "mean_abs_effect": F.round("mean_abs_effect", 9)})
    return R.first_targets(R.evidence_gated_rank(rounded), expressed, 8)


@query("support_tiers", f"SELECT CASE WHEN source_count >= 3 THEN 'three_source' WHEN source_count = 2 THEN 'two_source' WHEN source_count = 1 THEN 'single_source' ELSE 'unknown' END AS support_tier, count(*)::BIGINT AS n FROM ({POOL}) GROUP BY ALL")
def support_tiers(spark, d):
    return pool(spark, d).groupBy(R.support_tier(F.col("source_count")).alias("support_tier")).agg(F.count(F.lit(1)).alias("n"))
