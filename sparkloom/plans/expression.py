"""Queries over sparse measurement triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as X
from ..operators import ranking as R
from ._register import query
from .bindings import CELLS, EXPR, cells, expr, table


def rounded(df, digits=6, **columns):
    return df.select(*(F.round(c, digits).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns))


BULK = f"SELECT cell_type, response, gene, sum(value) AS total FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) GROUP BY ALL"


@query("pseudobulk_sum", f"SELECT cell_type, response, gene, round(total, 4) AS total, n_cells FROM ({BULK}) JOIN (SELECT cell_type, response, count(*)::BIGINT AS n_cells FROM ({CELLS}) GROUP BY ALL) USING (cell_type, response)")
def pseudobulk_sum(spark, d):
    return rounded(X.pseudobulk(expr(spark, d), cells(spark, d), ["cell_type", "response"]), 4)


@query("pseudobulk_log_cpm", f"SELECT cell_type, response, gene, round(ln(1 + total / sum(total) OVER (PARTITION BY cell_type, response) * 1e6), 6) AS log_value FROM ({BULK})")
def pseudobulk_log_cpm(spark, d):
    bulk = X.pseudobulk(expr(spark, d), cells(spark, d), ["cell_type", "response"])
    return rounded(X.log_normalized(bulk, ["cell_type", "response"], "total").select("cell_type", "response", "gene", "log_value"))


@query("sparse_group_mean", f"SELECT cell_type, gene, round(s / n, 6) AS mean FROM (SELECT cell_type, gene, sum(value) AS s FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) GROUP BY ALL) JOIN (SELECT cell_type, count(*)::DOUBLE AS n FROM ({CELLS}) GROUP BY ALL) USING (cell_type)")
def sparse_group_mean(spark, d):
    return rounded(X.group_means(expr(spark, d), cells(spark, d), "cell_type"))


@query("effective_donors", f"SELECT cell_type, response, count(*)::BIGINT AS n_donors, round(sum(n) * sum(n) / sum(n * n)::DOUBLE, 6) AS effective_donors, round(max(n) / sum(n)::DOUBLE, 6) AS max_share FROM (SELECT cell_type, response, donor, count(*)::BIGINT AS n FROM ({CELLS}) GROUP BY ALL) GROUP BY ALL")
def effective_donors(spark, d):
    return rounded(X.effective_donors(cells(spark, d), ["cell_type", "response"]))


BY_DONOR = f"SELECT gene, cell_type, donor, response, value FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id)"


def donor_values(spark, d):
    return expr(spark, d).join(cells(spark, d), "cell_id")


@query("donor_direction_consistency", f"""WITH m AS (SELECT gene, donor, response, avg(value) AS m FROM ({BY_DONOR}) WHERE response IN ('F', 'O') GROUP BY ALL),
o AS (SELECT gene, sign(avg(m) FILTER (response = 'F') - avg(m) FILTER (response = 'O')) AS s FROM m GROUP BY gene)
SELECT a.gene, count(*)::BIGINT AS n_pairs, round(avg((sign(a.m - b.m) = o.s)::INT), 6) AS consistency FROM m a JOIN m b ON a.gene = b.gene AND a.response = 'F' AND b.response = 'O' JOIN o ON o.gene = a.gene GROUP BY a.gene""")
def donor_direction_consistency(spark, d):
    return rounded(X.donor_direction(donor_values(spark, d), ["gene"], case="F", control="O"))


UP, DOWN = ("Brand#11", "Brand#12", "Brand#13"), ("Brand#21", "Brand#22", "Brand#99")
SIG = f"""WITH n AS (SELECT cell_type, count(*)::DOUBLE AS n FROM ({CELLS}) GROUP BY ALL), x AS (SELECT cell_type, gene, ln(1 + value) AS x FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) WHERE gene IN {UP + DOWN}),
s AS (SELECT cell_type, sum(x) FILTER (gene IN {UP}) AS a, sum(x) FILTER (gene IN {DOWN}) AS b, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL)
SELECT cell_type, a / (n * 3) AS mean_up, b / (n * 2) AS mean_down, (a / (n * 3) - b / (n * 2)) / sqrt(q / (n * 5) - (s / (n * 5)) ** 2) AS score, 5 / 6.0::DOUBLE AS coverage FROM n JOIN s USING (cell_type)"""


@query("signature_score", f"SELECT cell_type, round(mean_up, 6) AS mean_up, round(mean_down, 6) AS mean_down, round(score, 6) AS score, round(coverage, 6) AS coverage, CASE WHEN score >= 0.3 THEN 'up' WHEN score <= -0.3 THEN 'down' ELSE 'Unknown' END AS status, CASE WHEN abs(score) < 0.3 THEN 'low' WHEN abs(score) >= 0.8 THEN 'high' WHEN abs(score) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM ({SIG})")
def signature_score(spark, d):
    out = X.signature_score(expr(spark, d), cells(spark, d), UP, DOWN, "cell_type")
    status, sure = X.status_band(F.col("score"))
    return rounded(out.withColumns({"status": status, "confidence": sure}))


TWO = f"SELECT gene, cell_type, response, value FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) WHERE response IN ('F', 'O')"


def two_groups(spark, d):
    return expr(spark, d).join(cells(spark, d).filter("response in ('F', 'O')"), "cell_id")


WELCH = f"""SELECT gene, cell_type, a AS n_case, b AS n_control, ma AS mean_case, mb AS mean_control, (ma - mb) / sqrt(va / a + vb / b) AS t, (va / a + vb / b) ** 2 / ((va / a) ** 2 / (a - 1) + (vb / b) ** 2 / (b - 1)) AS dof
FROM (SELECT gene, cell_type, count(*) FILTER (response = 'F') AS a, count(*) FILTER (response = 'O') AS b, avg(value) FILTER (response = 'F') AS ma, avg(value) FILTER (response = 'O') AS mb, var_samp(value) FILTER (response = 'F') AS va, var_samp(value) FILTER (response = 'O') AS vb FROM ({TWO}) GROUP BY ALL) WHERE a > 1 AND b > 1"""


@query("welch_statistics", f"SELECT gene, cell_type, n_case, n_control, round(mean_case, 6) AS mean_case, round(mean_control, 6) AS mean_control, round(t, 6) AS t, round(dof, 4) AS dof FROM ({WELCH})")
def welch_statistics(spark, d):
    out = X.welch(two_groups(spark, d), ["gene", "cell_type"], "response", "value", "F", "O")
    return out.select("gene", "cell_type", "n_case", "n_control", *(F.round(c, 6).alias(c) for c in ("mean_case", "mean_control", "t")), F.round("dof", 4).alias("dof"))


RANKSUM = f"""WITH v AS ({TWO}), r AS (SELECT gene, cell_type, response, rank() OVER (PARTITION BY gene, cell_type ORDER BY value) + (count(*) OVER (PARTITION BY gene, cell_type, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, cell_type, value) AS m FROM v),
s AS (SELECT gene, cell_type, count(*) FILTER (response = 'F')::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(r) FILTER (response = 'F')::DOUBLE AS r, sum(m * m - 1)::DOUBLE AS t FROM r GROUP BY ALL),
u AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2 AS u FROM s WHERE n1 > 0 AND n > n1)
SELECT gene, cell_type, n1::BIGINT AS n_case, n2::BIGINT AS n_control, round(u, 4) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))), 6) AS z FROM u"""


@query("rank_sum_statistics", RANKSUM)
def rank_sum_statistics(spark, d):
    out = X.rank_sum(two_groups(spark, d), ["gene", "cell_type"], "response", "value", "F", "O")
    return out.select("gene", "cell_type", "n_case", "n_control", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"))


@query("control_standardized", f"WITH v AS (SELECT cell_id, gene, value, response = 'O' AS control FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id)), s AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS d FROM v WHERE control GROUP BY gene) SELECT gene, control, round(avg((value - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END), 6) + 0.0 AS mean_z, count(*)::BIGINT AS n FROM v JOIN s USING (gene) GROUP BY ALL")
def control_standardized(spark, d):
    rows = donor_values(spark, d).withColumn("control", F.col("response") == "O")
    z = X.standardize(rows, F.col("control"), ["gene"], "value")
    return z.groupBy("gene", "control").agg((F.round(F.avg("z"), 6) + 0.0).alias("mean_z"), F.count(F.lit(1)).alias("n"))


@query("robust_scaled", "WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events GROUP BY ALL) SELECT event_id, round(least(1.0, greatest(0.0, (value - a) / (b - a))), 6) AS scaled FROM events JOIN q USING (event_type)")
def robust_scaled(spark, d):
    return X.robust_scale(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("top_variable_genes", f"SELECT gene, round(avg(v), 4) AS variance FROM (SELECT cell_type, gene, var_pop(value) AS v FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) WHERE response = 'O' GROUP BY ALL) GROUP BY gene ORDER BY avg(v) DESC, gene LIMIT 8")
def top_variable_genes(spark, d):
    rows = expr(spark, d).join(cells(spark, d).filter("response = 'O'"), "cell_id")
    return rounded(X.top_variable(rows, "cell_type", "gene", "value", 8), 4)


@query("highly_variable_genes", f"WITH s AS (SELECT gene, avg(value) AS m, var_samp(value) / avg(value) AS d FROM ({EXPR}) GROUP BY gene), b AS (SELECT *, least(4, floor((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * 5)) AS bin FROM s), z AS (SELECT gene, CASE WHEN stddev_samp(d) OVER (PARTITION BY bin) > 0 THEN (d - avg(d) OVER (PARTITION BY bin)) / stddev_samp(d) OVER (PARTITION BY bin) ELSE 1 END AS z FROM b) SELECT gene, round(z, 5) AS dispersion_z FROM z ORDER BY round(z, 9) DESC, gene LIMIT 6")
def highly_variable_genes(spark, d):
    return rounded(X.variable_genes(expr(spark, d), "gene", "value", 6, bins=5), 5)


@query("fallback_target_score", f"SELECT gene, round(avg(abs(value)) + var_samp(value), 4) AS score FROM ({EXPR}) GROUP BY gene")
def fallback_target_score(spark, d):
    return rounded(X.fallback_score(expr(spark, d), "gene", "value"), 4)


PAIRS = "SELECT event_type, value AS a, value * 0.8 + (event_id % 7) AS b, (event_id % 5) + 1.0 AS w FROM events"


def paired_events(spark, d):
    return table(spark, d, "events").select("event_type", F.col("value").alias("a"), (F.col("value") * 0.8 + F.col("event_id") % 7).alias("b"), (F.col("event_id") % 5 + 1.0).alias("w"))


@query("agreement_metrics", f"SELECT event_type, count(*)::BIGINT AS n, round(corr(a, b), 6) AS pearson, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(1 - sum((a - b) ** 2) / (var_pop(a) * count(*)), 6) AS r2, round((sum(w * a * b) - sum(w * a) * sum(w * b) / sum(w)) / sqrt((sum(w * a * a) - sum(w * a) ** 2 / sum(w)) * (sum(w * b * b) - sum(w * b) ** 2 / sum(w))), 6) AS weighted_pearson FROM ({PAIRS}) GROUP BY event_type")
def agreement_metrics(spark, d):
    return rounded(X.agreement(paired_events(spark, d), "a", "b", ["event_type"], "w"))


@query("spearman_correlation", f"WITH p AS ({PAIRS}), r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY event_type ORDER BY b) + (count(*) OVER (PARTITION BY event_type, b) - 1) / 2.0 AS rb FROM p) SELECT event_type, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY event_type")
def spearman_correlation(spark, d):
    return rounded(X.spearman(paired_events(spark, d), "a", "b", ["event_type"]))


@query("direction_accuracy", f"SELECT event_type, round(avg((CASE WHEN b > a THEN 1 ELSE -1 END = CASE WHEN w > 2 THEN 1 ELSE -1 END)::INT), 6) AS direction_accuracy FROM ({PAIRS}) GROUP BY event_type")
def direction_accuracy(spark, d):
    pairs = paired_events(spark, d).withColumn("e", F.when(F.col("w") > 2, 1).otherwise(-1))
    return rounded(X.direction_accuracy(pairs, "a", "b", "e", ["event_type"]))


@query("decay_fit", "SELECT event_type, count(*)::BIGINT AS n, round(regr_slope(ln(value), x), 6) AS slope, round(CASE WHEN regr_slope(ln(value), x) < -1e-12 THEN -1 / regr_slope(ln(value), x) ELSE 0 END, 3) AS length, round(regr_r2(ln(value), x), 6) AS r2 FROM (SELECT event_type, value, (event_id % 50)::DOUBLE AS x FROM events WHERE value > 1e-12) GROUP BY event_type")
def decay_fit(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", (F.col("event_id") % 50).cast("double").alias("x"))
    out = X.log_linear_decay(rows, "x", "value", ["event_type"])
    return out.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("length", 3).alias("length"), F.round("r2", 6).alias("r2"))
