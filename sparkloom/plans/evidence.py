"""Queries over evidence: effects, splits, stability, scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ._register import query
from .bindings import CELLS, EXPR, FLOW, POINTS, cells, expr, flow, nation_lines, points, table
from .expression import rounded

DRAW = "(('0x' || substr(md5(concat_ws('|', {})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
LABELLED = f"SELECT cell_id, label, gene, value FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id)"


def labelled(spark, d):
    return expr(spark, d).join(cells(spark, d), "cell_id").select("cell_id", "label", "gene", "value")


@query("mean_difference_edges", f"""WITH r AS ({LABELLED}), n AS (SELECT label, count(DISTINCT cell_id)::BIGINT AS n FROM r GROUP BY label HAVING count(DISTINCT cell_id) >= 50), s AS (SELECT label, gene, sum(value) AS s FROM r GROUP BY ALL), t AS (SELECT DISTINCT gene FROM s),
e AS (SELECT a.label AS source, t.gene AS target, round(coalesce(x.s, 0) / a.n - coalesce(c.s, 0) / b.n, 9) AS effect, a.n AS n_intervention, b.n AS n_control FROM n a JOIN n b ON b.label = '5-LOW' AND a.label <> '5-LOW' CROSS JOIN t LEFT JOIN s x ON x.label = a.label AND x.gene = t.gene LEFT JOIN s c ON c.label = b.label AND c.gene = t.gene)
SELECT source, target, round(effect, 6) + 0.0 AS effect, n_intervention, n_control, row_number() OVER (PARTITION BY source ORDER BY abs(effect) DESC, target) AS source_rank FROM e""")
def mean_difference_edges(spark, d):
    out = E.mean_difference(labelled(spark, d), "5-LOW", 50)
    return out.select("source", "target", (F.round("effect", 6) + 0.0).alias("effect"), "n_intervention", "n_control", "source_rank")


@query("source_split", f"WITH u AS (SELECT c_custkey AS donor, percent_rank() OVER (ORDER BY {DRAW.format(chr(39) + 'split' + chr(39) + ', c_custkey::VARCHAR')}, c_custkey) AS p FROM customer) SELECT donor, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'tune' ELSE 'test' END AS part FROM u")
def source_split(spark, d):
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("donor"))
    return E.split_units(units, "donor", "split", [("train", 0.6), ("tune", 0.8), ("test", 1.0)])


@query("spatial_holdout", f"WITH p AS ({POINTS}), c AS (SELECT id, greatest(floor((x - (SELECT min(x) FROM p)) / 100), floor((y - (SELECT min(y) FROM p)) / 100)) AS c FROM p) SELECT id, CASE WHEN c < 4 THEN 'tune' WHEN c < 5 THEN 'buffer' ELSE 'train' END AS part FROM c")
def spatial_holdout(spark, d):
    return E.spatial_holdout(points(spark, d), 100.0, 4, 1).select("id", "part")


SCORES = "SELECT c_nationkey AS animal, c_mktsegment AS cell_type, c_custkey % 4 AS band, c_custkey % 3 AS perturbation, c_acctbal AS value FROM customer"


@query("hierarchical_score", f"WITH s AS ({SCORES}), a AS (SELECT animal, band, perturbation, cell_type, avg(value) AS v FROM s GROUP BY ALL), b AS (SELECT animal, band, perturbation, avg(v) AS v FROM a GROUP BY ALL), c AS (SELECT animal, band, avg(v) AS v FROM b GROUP BY ALL) SELECT animal, round(avg(v), 7) AS value FROM c GROUP BY animal")
def hierarchical_score(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("animal"), F.col("c_mktsegment").alias("cell_type"), (F.col("c_custkey") % 4).alias("band"), (F.col("c_custkey") % 3).alias("perturbation"), F.col("c_custkey").alias("gene"), F.col("c_acctbal").alias("value"))
    return rounded(E.hierarchical_mean(rows, "value", [["gene"], ["cell_type"], ["perturbation"], ["band"]], ["animal"]), 7)


UNITS = "SELECT event_id, event_type, event_id % 5 = 0 AS is_perturbed, (event_id % 7)::DOUBLE AS distance, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS own, value * exp(-(event_id % 7) / 2.0) + 0.1 AS observed FROM events"


def units(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", "event_type", (i % 5 == 0).alias("is_perturbed"), (i % 7).cast("double").alias("distance"), F.when(i % 11 != 0, F.col("value")).alias("own"), (F.col("value") * F.exp(-(i % 7) / 2.0) + 0.1).alias("observed"))


@query("decay_baseline_metrics", f"WITH u AS (SELECT event_type, own * exp(-distance / 2.0) AS p, observed AS o FROM ({UNITS})) SELECT event_type, count(*)::BIGINT AS n, round(sqrt(avg((p - o) ** 2)), 6) AS rmse, round(corr(p, o) FILTER (p IS NOT NULL), 6) AS pearson, round(avg((sign(p) = sign(o))::INT) FILTER (p IS NOT NULL), 6) AS sign_accuracy, round(avg((p IS NOT NULL)::INT), 6) AS coverage, round(1 - avg((p IS NOT NULL)::INT), 6) AS abstention FROM u GROUP BY event_type")
def decay_baseline_metrics(spark, d):
    return rounded(E.prediction_metrics(E.decay_baselines(units(spark, d), 2.0), "decay", "observed", ["event_type"]))


@query("own_only_metrics", f"WITH u AS (SELECT event_type, CASE WHEN is_perturbed THEN own WHEN own IS NOT NULL THEN 0 END AS p, observed AS o FROM ({UNITS})) SELECT event_type, count(*)::BIGINT AS n, round(sqrt(avg((p - o) ** 2)), 6) AS rmse, round(avg((p IS NOT NULL)::INT), 6) AS coverage FROM u GROUP BY event_type")
def own_only_metrics(spark, d):
    return rounded(E.prediction_metrics(E.decay_baselines(units(spark, d), 2.0), "own_only", "observed", ["event_type"]).select("event_type", "n", "rmse", "coverage"))


@query("distance_calibration", "WITH v AS (SELECT value AS x, value * 0.9 AS p, value + (event_id % 3) AS o FROM events), q AS (SELECT list_transform(quantile_cont(x, [0.25, 0.5, 0.75]), lambda e: round(e, 9)) AS e FROM v), b AS (SELECT len(list_filter(e, lambda t: round(x, 9) > t)) AS bin, p, o FROM v, q), m AS (SELECT bin, abs(avg(p) - avg(o)) AS e FROM b GROUP BY bin) SELECT count(*)::BIGINT AS n_bins, round(avg(e), 6) AS calibration_error FROM m")
def distance_calibration(spark, d):
    v = table(spark, d, "events").select(F.col("value").alias("x"), (F.col("value") * 0.9).alias("p"), (F.col("value") + F.col("event_id") % 3).alias("o"))
    return rounded(E.calibration_error(v, "x", "p", "o"))


YEARS = f"SELECT y AS repeat, src, dst, n / (sum(n) OVER (PARTITION BY y, src))::DOUBLE AS freq FROM (SELECT year(l_shipdate) AS y, c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey JOIN supplier s ON l_suppkey = s.s_suppkey GROUP BY ALL)"


def yearly(spark, d):
    from pyspark.sql import Window

    n = nation_lines(spark, d).groupBy(F.year("l_shipdate").alias("repeat"), "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return n.select("repeat", "src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("repeat", "src"))).alias("freq"))


@query("edge_stability_fits", f"WITH v AS (SELECT src, dst, freq - 0.04 AS value FROM ({YEARS})), s AS (SELECT src, dst, quantile_cont(value, 0.5) AS m, avg((abs(value) > 0.01)::INT) AS f, count(*) FILTER (abs(value) > 0.01) AS n, count(*) FILTER (value > 0.01) AS p FROM v GROUP BY ALL) SELECT src, dst, round(m, 6) AS median_effect, round(f, 6) AS selection_frequency, round(CASE WHEN n > 0 THEN greatest(p, n - p) / n::DOUBLE ELSE 0 END, 6) AS direction_agreement, round(abs(m) * f * CASE WHEN n > 0 THEN greatest(p, n - p) / n::DOUBLE ELSE 0 END, 6) AS score, n = 0 AS abstains FROM s")
def edge_stability_fits(spark, d):
    runs = yearly(spark, d).select("repeat", F.lit("all").alias("context"), "src", "dst", (F.col("freq") - 0.04).alias("value"))
    return rounded(E.stability_table(runs, 0.01))


STAB = f"""WITH y AS ({YEARS}), nu AS (SELECT r AS run, src, dst, {DRAW.format("'null', r::VARCHAR, src::VARCHAR, dst::VARCHAR")} * 0.08 AS freq FROM (SELECT DISTINCT src, dst FROM y) CROSS JOIN (SELECT unnest(range(12)) AS r)),
o AS (SELECT src, dst, avg(freq) AS m, stddev_pop(freq) AS sd, avg((freq >= 0.035)::INT) AS ss FROM y GROUP BY ALL), n AS (SELECT nu.src, nu.dst, avg(freq) AS nm, quantile_cont(freq, 0.95) AS p95, count(*)::BIGINT AS k, count(*) FILTER (freq >= m) AS ge FROM nu JOIN o ON o.src = nu.src AND o.dst = nu.dst GROUP BY ALL),
p AS (SELECT o.*, n.nm, n.p95, n.k, (ge + 1) / (k + 1)::DOUBLE AS p FROM o JOIN n ON o.src = n.src AND o.dst = n.dst), r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk, count(*) OVER () AS total FROM p), q AS (SELECT *, least(1, min(p * total / rk) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)"""


@query("edge_stability_table", f"{STAB} SELECT src, dst, round(m, 6) AS mean_freq, round(ss, 6) AS seed_support, round(p95, 6) AS null_p95, k AS n_nulls, round(p, 6) AS p, round(q, 6) AS q, k >= 10 AND m > p95 AND q <= 0.5 AS control_pass, CASE WHEN k >= 10 AND m > p95 AND q <= 0.5 AND ss >= 0.8 THEN 'stable_candidate' WHEN m <= p95 THEN 'null_like_edge' WHEN ss >= 0.5 THEN 'context_specific_candidate' ELSE 'unstable_candidate' END AS stability_class FROM q")
def edge_stability_table(spark, d):
    y = yearly(spark, d)
    pairs = y.select("src", "dst").distinct()
    nulls = pairs.crossJoin(spark.range(12).withColumnRenamed("id", "run")).select("run", "src", "dst", (E.draw(F.lit("null"), F.col("run"), F.col("src"), F.col("dst")) * 0.08).alias("freq"))
    out = E.edge_stability(pairs.withColumn("base_edge", F.lit(True)), y, nulls, 0.035, 0.5)
    return rounded(out.select("src", "dst", "mean_freq", "seed_support", "null_p95", "n_nulls", "p", "q", "control_pass", "stability_class"))


@query("null_check", "SELECT count(*)::BIGINT AS n_nulls, round(avg(v), 6) AS null_mean, round((count(*) FILTER (v >= 11) + 1) / (count(*) + 1)::DOUBLE, 6) AS p, round(11 - avg(v), 6) AS advantage, (count(*) FILTER (v >= 11) + 1) / (count(*) + 1)::DOUBLE <= 0.3 AND 11 - avg(v) > 0 AS passes FROM (SELECT avg(value) AS v FROM events GROUP BY user_id)")
def null_check(spark, d):
    nulls = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("value")).select("value")
    return rounded(E.empirical_check(11.0, nulls, max_p=0.3))


@query("label_permutation", f"WITH c AS ({CELLS}), r AS (SELECT cell_id, label FROM c WHERE label <> '5-LOW'), a AS (SELECT cell_id, row_number() OVER (ORDER BY {DRAW.format(chr(39) + 'perm' + chr(39) + ', ' + chr(39) + 'to' + chr(39) + ', cell_id::VARCHAR')}, cell_id) AS rn FROM r), b AS (SELECT label AS permuted, row_number() OVER (ORDER BY {DRAW.format(chr(39) + 'perm' + chr(39) + ', cell_id::VARCHAR')}, cell_id) AS rn FROM r) SELECT cell_id, permuted FROM a JOIN b USING (rn) UNION ALL SELECT cell_id, label FROM c WHERE label = '5-LOW'")
def label_permutation(spark, d):
    return E.permute_labels(cells(spark, d).select("cell_id", "label"), "cell_id", "label", "5-LOW", "perm").select("cell_id", "permuted")


BOOT = f"WITH s AS (SELECT c_nationkey AS k, sum(c_acctbal - 4500) AS s, count(*) AS m, row_number() OVER (ORDER BY c_nationkey) - 1 AS place FROM customer GROUP BY c_nationkey), n AS (SELECT count(*)::BIGINT AS n, sum(s) / sum(m) AS estimate FROM s), t AS (SELECT r, floor({DRAW.format(chr(39) + 'boot' + chr(39) + ', r::VARCHAR, slot::VARCHAR')} * n) AS place FROM n, (SELECT unnest(range(200)) AS r), (SELECT unnest(range(25)) AS slot) WHERE slot < n), m AS (SELECT r, sum(s) / sum(m) AS mean FROM t JOIN s USING (place) GROUP BY r) SELECT n AS n_clusters, round(estimate, 4) AS estimate, round((SELECT quantile_cont(mean, 0.025) FROM m), 4) AS ci_low, round((SELECT quantile_cont(mean, 0.975) FROM m), 4) AS ci_high FROM n"


@query("cluster_bootstrap", BOOT)
def cluster_bootstrap(spark, d):
    u = table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") - 4500).alias("x"))
    return rounded(E.cluster_bootstrap(u, "c_nationkey", "x", 200, "boot"), 4)


SAMPLES = f"SELECT DISTINCT repeat AS sample, src, dst FROM ({YEARS}) WHERE freq > 0.045"


def samples(spark, d):
    return yearly(spark, d).filter("freq > 0.045").select(F.col("repeat").alias("sample"), "src", "dst")


@query("cross_sample_edges", f"SELECT src, dst, round(count(*) / 7.0::DOUBLE, 6) AS frequency, count(*) / 7.0 > 0.5 AS robust FROM ({SAMPLES}) GROUP BY ALL")
def cross_sample_edges(spark, d):
    return rounded(E.edge_frequency(samples(spark, d), 7))


@query("sample_jaccard", f"WITH e AS ({SAMPLES}), n AS (SELECT sample, count(*) AS n FROM e GROUP BY sample) SELECT a.sample AS a, b.sample AS b, round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0))::DOUBLE, 6) AS jaccard FROM n a JOIN n b ON a.sample < b.sample LEFT JOIN (SELECT x.sample AS a, y.sample AS b, count(*) AS k FROM e x JOIN e y USING (src, dst) WHERE x.sample < y.sample GROUP BY ALL) j ON j.a = a.sample AND j.b = b.sample")
def sample_jaccard(spark, d):
    return rounded(E.sample_jaccard(samples(spark, d)))


@query("group_edges", f"SELECT src, dst, array_to_string(list_sort(list(sample::VARCHAR)), ';') AS groups, count(*) = 7 AS consensus, count(*) = 1 AS specific FROM ({SAMPLES}) GROUP BY ALL")
def group_edges(spark, d):
    return E.group_edges(samples(spark, d).withColumn("sample", F.col("sample").cast("string")), 7)


@query("run_statuses", f"SELECT cell_type, count(*)::BIGINT AS attempted, count(*) FILTER (response = 'F')::BIGINT AS completed, round(avg((response = 'F')::INT), 6) AS completion FROM ({CELLS}) GROUP BY cell_type")
def run_statuses(spark, d):
    runs = cells(spark, d).withColumn("status", F.when(F.col("response") == "F", "completed").otherwise("failed"))
    return rounded(E.run_statuses(runs, "cell_type", "status"))


@query("common_rows", f"WITH a AS (SELECT src, dst FROM ({FLOW}) WHERE qty > 2500), b AS (SELECT src, dst FROM ({FLOW}) WHERE n > 100) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b))::BIGINT AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a))::BIGINT AS only_b")
def common_rows(spark, d):
    f = flow(spark, d)
    return E.same_rows(f.filter("qty > 2500"), f.filter("n > 100"), ["src", "dst"])


@query("stratified_sample", f"WITH c AS ({CELLS}), s AS (SELECT cell_type, response, count(*) AS m FROM c GROUP BY ALL), q AS (SELECT *, m * least(500, sum(m) OVER ()) / (sum(m) OVER ())::DOUBLE AS x FROM s), f AS (SELECT *, floor(x) AS q, 500 - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, cell_type, response) AS o FROM q), r AS (SELECT cell_id, cell_type, response, row_number() OVER (PARTITION BY cell_type, response ORDER BY {DRAW.format(chr(39) + 'str' + chr(39) + ', cell_id::VARCHAR')}, cell_id) AS rn FROM c) SELECT cell_id FROM r JOIN f USING (cell_type, response) WHERE rn <= q + CASE WHEN o <= rest THEN 1 ELSE 0 END")
def stratified_sample(spark, d):
    return E.stratified_sample(cells(spark, d), ["cell_type", "response"], "cell_id", 500, "str").select("cell_id")


@query("capped_sample", f"SELECT cell_id FROM (SELECT cell_id, row_number() OVER (PARTITION BY cell_type ORDER BY {DRAW.format(chr(39) + 'cap' + chr(39) + ', cell_id::VARCHAR')}, cell_id) AS rn FROM ({CELLS})) WHERE rn <= 40")
def capped_sample(spark, d):
    return E.capped_sample(cells(spark, d), "cell_type", "cell_id", 40, "cap").select("cell_id")


@query("niche_enrichment", "WITH r AS (SELECT c_nationkey % 4 AS niche, c_mktsegment AS label FROM customer), c AS (SELECT niche, label, count(*)::BIGINT AS n FROM r GROUP BY ALL), s AS (SELECT *, n / (sum(n) OVER (PARTITION BY niche))::DOUBLE AS a, (sum(n) OVER (PARTITION BY label)) / (sum(n) OVER ())::DOUBLE AS b FROM c) SELECT niche, label, n, round(log2((a + 1e-9) / (b + 1e-9)), 6) AS log2_enrichment FROM s")
def niche_enrichment(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("niche"), F.col("c_mktsegment").alias("label"))
    return rounded(E.enrichment(rows, "niche", "label"))
