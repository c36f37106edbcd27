"""Queries over screens, name universes, trial selection and resampled comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_sf, t_two_sided
from ..operators import evidence as E
from ..operators import expression as X
from ..operators import ranking as R
from ..operators import screening as S
from ._register import query
from .bindings import CAUSAL, CELLS, EXPR, RAW, causal, cells, expr, raw_values, table
from .evidence import DRAW, YEARS, yearly
from .expression import RANKSUM, WELCH, rounded, two_groups
from .tails import two_sided_normal, two_sided_t


def bh(rows: str, by: str = "") -> str:
    """Rows with a column p, with q added."""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, least(1, min(p * m / rk) OVER ({part}ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, count(*) OVER ({part}ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk, count(*) OVER ({part.strip()}) AS m FROM ({rows}))"


WELCH_P = f"SELECT gene, cell_type, t, {two_sided_t('t', 'dof')} AS p FROM ({WELCH})"


@query("welch_p_values", f"SELECT gene, cell_type, round(t, 6) AS t, round(p, 7) AS p, round(q, 7) AS q FROM ({bh(WELCH_P, 'cell_type')})")
def welch_p_values(spark, d):
    """Two-sided p and q of Welch's test."""
    out = X.welch(two_groups(spark, d), ["gene", "cell_type"], "response", "value", "F", "O")
    out = out.withColumn("p", F.coalesce(t_two_sided("t", "dof"), F.lit(1.0)))
    return R.benjamini_hochberg(out, "p", ["cell_type"]).select("gene", "cell_type", F.round("t", 6).alias("t"), F.round("p", 7).alias("p"), F.round("q", 7).alias("q"))


Z = RANKSUM.replace("round((greatest", "(greatest").replace("(n * (n - 1)))), 6) AS z", "(n * (n - 1)))) AS z")
RANKSUM_P = f"SELECT gene, cell_type, z, {two_sided_normal('z')} AS p FROM ({Z})"


@query("rank_sum_p_values", f"SELECT gene, cell_type, round(z, 6) AS z, round(p, 7) AS p, round(q, 7) AS q FROM ({bh(RANKSUM_P, 'cell_type')})")
def rank_sum_p_values(spark, d):
    """Two-sided asymptotic p and q of the rank-sum test."""
    out = X.rank_sum(two_groups(spark, d), ["gene", "cell_type"], "response", "value", "F", "O")
    out = out.withColumn("p", F.least(F.lit(1.0), 2 * normal_sf(F.coalesce(F.col("z"), F.lit(0.0)))))
    return R.benjamini_hochberg(out, "p", ["cell_type"]).select("gene", "cell_type", F.round("z", 6).alias("z"), F.round("p", 7).alias("p"), F.round("q", 7).alias("q"))


STRATA = f"SELECT gene, response, value FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) WHERE response IN ('F', 'P')"


@query("stratified_rank_sum", f"""WITH v AS ({STRATA}), r AS (SELECT gene, response, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, value) AS m FROM v),
s AS (SELECT gene, count(*) FILTER (response = 'F')::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(r) FILTER (response = 'F')::DOUBLE AS r, sum(m * m - 1)::DOUBLE AS t, avg(value) FILTER (response = 'F') AS a, avg(value) FILTER (response = 'P') AS b FROM r GROUP BY gene),
u AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2 AS u FROM s), w AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u WHERE n1 >= 3 AND n2 >= 3 AND (t > 0 OR least(n1, n2) > 8))
SELECT gene, n1::BIGINT AS n_first, n2::BIGINT AS n_second, round(u, 4) AS u, round({two_sided_normal('z')}, 7) AS p, round(a, 6) AS mean_first, round(b, 6) AS mean_second, round(log2((a + 1e-6) / (b + 1e-6)), 6) AS log2fc FROM w""")
def stratified_rank_sum(spark, d):
    """Genes whose p is by the corrected z: with equal values, or more than 8 values in both strata."""
    rows = expr(spark, d).join(cells(spark, d), "cell_id").filter("response in ('F', 'P')")
    out = S.stratified_rank_sum(rows, ["gene"], "response", "value", "F", "P")
    return out.select("gene", F.col("n_case").alias("n_first"), F.col("n_control").alias("n_second"), F.round("u", 4).alias("u"), F.round("p", 7).alias("p"), *(F.round(c, 6).alias(c) for c in ("mean_first", "mean_second", "log2fc")))


LABELS = f"SELECT cell_id, label FROM ({CELLS})"
RESPONSE = f"""WITH c AS ({LABELS}), n AS (SELECT label, count(*) AS n FROM c GROUP BY label HAVING count(*) >= 5), g AS (SELECT DISTINCT gene FROM ({EXPR})), v AS (SELECT c.label, c.cell_id, g.gene, coalesce(e.value, 0) AS value FROM c JOIN n USING (label) CROSS JOIN g LEFT JOIN ({EXPR}) e ON e.cell_id = c.cell_id AND e.gene = g.gene),
s AS (SELECT label AS source FROM n WHERE label <> '5-LOW'), w AS (SELECT source, gene AS target, value, (label = source) AS a FROM s JOIN v ON label = source OR label = '5-LOW'),
k AS (SELECT source, target, value, count(*) FILTER (a) AS a, count(*) AS m FROM w GROUP BY ALL), r AS (SELECT *, sum(m) OVER (PARTITION BY source, target ORDER BY value) - (m - 1) / 2.0 AS r FROM k),
t AS (SELECT source, target, sum(a)::DOUBLE AS n1, sum(m)::DOUBLE AS n, sum(a * r)::DOUBLE AS r, sum(m::DOUBLE * m * m - m) AS t FROM r GROUP BY ALL), u AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2 AS u FROM t),
z AS (SELECT source, target, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u)"""


@query("response_edges", f"{RESPONSE}, p AS (SELECT *, {two_sided_normal('z')} AS p FROM z), q AS ({bh('SELECT * FROM p')}) SELECT source, target, round(u, 2) AS u, round(p, 7) AS p, round(q, 7) AS q, q <= 0.1 AS responds FROM q")
def response_edges(spark, d):
    out = S.response_edges(expr(spark, d), cells(spark, d).select("cell_id", "label"), "5-LOW")
    return out.select("source", "target", F.round("u", 2).alias("u"), F.round("p", 7).alias("p"), F.round("q", 7).alias("q"), "responds")


TRIALS = f"WITH t AS (SELECT repeat::INT AS trial, src AS source, dst AS target, round(freq, 9) AS score FROM ({YEARS}) WHERE src <> dst), c AS (SELECT src AS source, dst AS target FROM ({CAUSAL})), m AS (SELECT t.*, c.source IS NOT NULL AS hit FROM t LEFT JOIN c ON c.source = t.source AND c.target = t.target)"


@query("selected_trial", f"{TRIALS}, b AS (SELECT trial, score, count(*) AS m, count(*) FILTER (hit) AS h FROM m GROUP BY ALL), s AS (SELECT trial, h, sum(h) OVER w AS tp, sum(m) OVER w AS seen, sum(h) OVER (PARTITION BY trial) AS p FROM b WINDOW w AS (PARTITION BY trial ORDER BY score DESC)), a AS (SELECT trial, sum(h / p::DOUBLE * tp / seen::DOUBLE) AS ap FROM s GROUP BY trial) SELECT trial, round(ap, 9) AS average_precision, (SELECT count(*) FROM a)::BIGINT AS n_trials FROM a ORDER BY round(ap, 12) DESC, trial LIMIT 1")
def selected_trial(spark, d):
    trials = yearly(spark, d).filter("src <> dst").select(F.col("repeat").cast("int").alias("trial"), F.col("src").alias("source"), F.col("dst").alias("target"), F.round("freq", 9).alias("score"))
    return rounded(S.best_trial(trials, causal(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"))), 9)


@query("merged_contexts", f"WITH v AS (SELECT response, label, gene, value FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id) WHERE response IN ('F', 'O')), s AS (SELECT response, gene, avg(value) AS m, stddev_pop(value) AS d FROM v WHERE label = '5-LOW' GROUP BY ALL) SELECT response AS environment, label, gene, count(*)::BIGINT AS n, round(avg((value - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END), 6) + 0.0 AS mean_z FROM v JOIN s USING (response, gene) GROUP BY ALL")
def merged_contexts(spark, d):
    rows = expr(spark, d).join(cells(spark, d), "cell_id")
    merged = S.merged_contexts({c: rows.filter(F.col("response") == c).select("cell_id", "label", "gene", "value") for c in ("F", "O")}, "label", "5-LOW")
    return merged.groupBy("environment", "label", "gene").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("z"), 6) + 0.0).alias("mean_z"))


@query("shared_names", f"SELECT gene FROM ({RAW}) WHERE source = 'A' AND value > 48 INTERSECT SELECT gene FROM ({RAW}) WHERE source = 'N' AND value > 49 INTERSECT SELECT gene FROM ({RAW}) WHERE source = 'R' AND value > 48")
def shared_names(spark, d):
    r = raw_values(spark, d)
    return S.shared_names([r.filter((F.col("source") == s) & (F.col("value") > v)) for s, v in (("A", 48), ("N", 49), ("R", 48))], "gene")


@query("eligible_sources", "SELECT c_nationkey AS label, count(*)::BIGINT AS n FROM customer WHERE c_nationkey <> 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -900) GROUP BY 1 HAVING count(*) >= 6")
def eligible_sources(spark, d):
    names = table(spark, d, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("name"))
    held = table(spark, d, "supplier").filter("s_acctbal < -900").select(F.col("s_nationkey").alias("label")).distinct()
    return S.eligible_sources(table(spark, d, "customer").select(F.col("c_nationkey").alias("label")), names, held, 0, 6)


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return S.union_by_name([a, b])


BASE = f"SELECT src, dst, freq FROM ({YEARS}) WHERE repeat = 1996 AND src <> dst"
GRID = f"WITH f AS ({BASE}), n AS (SELECT n_nationkey AS k FROM nation), g AS (SELECT a.k AS src, b.k AS dst, coalesce(freq, 0) AS freq FROM n a JOIN n b ON a.k <> b.k LEFT JOIN f ON f.src = a.k AND f.dst = b.k), r AS (SELECT unnest(range(12))::BIGINT AS run)"


@query("null_frequencies", f"""{GRID}, m AS (SELECT run, src, dst, freq, row_number() OVER (PARTITION BY run ORDER BY src, dst) AS a, row_number() OVER (PARTITION BY run ORDER BY {DRAW.format("'null', run::VARCHAR, src::VARCHAR, dst::VARCHAR")}, src, dst) AS b FROM g, r WHERE run % 3 = 0),
o AS (SELECT run, src, dst, freq, row_number() OVER (PARTITION BY run, src ORDER BY dst) AS a, row_number() OVER (PARTITION BY run, src ORDER BY {DRAW.format("'null', run::VARCHAR, src::VARCHAR, dst::VARCHAR")}, dst) AS b FROM g, r WHERE run % 3 = 2),
p AS (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k) AS a, row_number() OVER (PARTITION BY run ORDER BY {DRAW.format("'null', run::VARCHAR, k::VARCHAR")}, k) AS b FROM n, r WHERE run % 3 = 1), q AS (SELECT x.run, x.k AS old, y.k AS new FROM p x JOIN p y ON x.run = y.run AND x.b = y.a)
SELECT x.run, x.src, x.dst, round(y.freq, 9) AS freq FROM m x JOIN m y ON x.run = y.run AND x.a = y.b UNION ALL SELECT x.run, x.src, x.dst, round(y.freq, 9) FROM o x JOIN o y ON x.run = y.run AND x.src = y.src AND x.a = y.b
UNION ALL SELECT s.run, s.new, t.new, round(g.freq, 9) FROM g JOIN q s ON s.old = g.src JOIN q t ON t.old = g.dst AND t.run = s.run""")
def null_frequencies(spark, d):
    f = yearly(spark, d).filter("repeat = 1996 and src <> dst").select("src", "dst", "freq")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return rounded(E.null_frequencies(f, names, 12, "null"), 9)


NESTED = "SELECT c_mktsegment AS stratum, c_nationkey AS cluster, c_custkey % 4 AS block, avg(c_acctbal) AS v FROM customer GROUP BY ALL"


@query("nested_bootstrap", f"""WITH u AS ({NESTED}), c AS (SELECT stratum, cluster, count(*) AS nb, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS cp, count(*) OVER (PARTITION BY stratum) AS nc FROM u GROUP BY stratum, cluster), b AS (SELECT *, row_number() OVER (PARTITION BY stratum, cluster ORDER BY block) - 1 AS bp FROM u), r AS (SELECT unnest(range(100)) AS r),
s AS (SELECT r, stratum, x.slot, floor({DRAW.format("'nest', r::VARCHAR, stratum, x.slot::VARCHAR")} * nc) AS cp FROM r, (SELECT DISTINCT stratum, nc FROM c) k, LATERAL (SELECT unnest(range(nc)) AS slot) x), t AS (SELECT s.r, s.stratum, s.slot, c.cluster, c.nb FROM s JOIN c ON c.stratum = s.stratum AND c.cp = s.cp),
w AS (SELECT r, stratum, slot, cluster, floor({DRAW.format("'nest', r::VARCHAR, stratum, slot::VARCHAR, y.i::VARCHAR")} * nb) AS bp FROM t, LATERAL (SELECT unnest(range(nb)) AS i) y), m AS (SELECT w.r, w.stratum, w.slot, avg(v) AS v FROM w JOIN b ON b.stratum = w.stratum AND b.cluster = w.cluster AND b.bp = w.bp GROUP BY ALL),
e AS (SELECT r, avg(v) AS v FROM (SELECT r, stratum, avg(v) AS v FROM m GROUP BY ALL) GROUP BY r) SELECT round((SELECT avg(v) FROM (SELECT stratum, avg(v) AS v FROM (SELECT stratum, cluster, avg(v) AS v FROM u GROUP BY ALL) GROUP BY stratum)), 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS ci_low, round(quantile_cont(v, 0.975), 4) AS ci_high FROM e""")
def nested_bootstrap(spark, d):
    c = table(spark, d, "customer")
    u = c.groupBy(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("cluster"), (F.col("c_custkey") % 4).alias("block")).agg(F.avg("c_acctbal").alias("value"))
    return rounded(E.nested_bootstrap(u, 100, "nest"), 4)


PAIRED = f"SELECT a.source, a.target, a.score AS a, b.score AS b, a.hit FROM m a JOIN m b ON a.source = b.source AND a.target = b.target AND a.trial = 1994 AND b.trial = 1996"


@query("precision_difference", f"""{TRIALS}, x AS ({PAIRED}), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS place FROM (SELECT DISTINCT source FROM x)), n AS (SELECT count(*) AS n FROM s), k AS (SELECT r, floor({DRAW.format("'apd', r::VARCHAR, slot::VARCHAR")} * n) AS place FROM n, (SELECT unnest(range(60)) AS r), (SELECT unnest(range(25)) AS slot) WHERE slot < n), w AS (SELECT r, source, count(*) AS c FROM k JOIN s USING (place) GROUP BY ALL),
y AS (SELECT r, c, unnest([{{'k': 'a', 'score': a}}, {{'k': 'b', 'score': b}}]) AS z, hit FROM w JOIN x USING (source)), l AS (SELECT r, z.k AS k, z.score AS score, sum(c) AS m, coalesce(sum(c) FILTER (hit), 0) AS h FROM y GROUP BY ALL), v AS (SELECT r, k, h, sum(h) OVER o AS tp, sum(m) OVER o AS seen, sum(h) OVER (PARTITION BY r, k) AS p FROM l WINDOW o AS (PARTITION BY r, k ORDER BY score DESC)), ap AS (SELECT r, k, coalesce(sum(CASE WHEN p > 0 THEN h / p::DOUBLE * tp / seen::DOUBLE END), 0) AS ap FROM v GROUP BY ALL),
e AS (SELECT r, max(ap) FILTER (k = 'a') - max(ap) FILTER (k = 'b') AS d FROM ap GROUP BY r) SELECT round(avg(d), 7) AS mean_difference, round(quantile_cont(d, 0.025), 7) AS ci_low, round(quantile_cont(d, 0.975), 7) AS ci_high FROM e""")
def precision_difference(spark, d):
    y = yearly(spark, d).filter("src <> dst").select("repeat", F.col("src").alias("source"), F.col("dst").alias("target"), F.round("freq", 9).alias("score"))
    one, two = (y.filter(F.col("repeat") == r).select("source", "target", F.col("score").alias(n)) for r, n in ((1994, "score_a"), (1996, "score_b")))
    hits = causal(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(True).alias("_h"))
    rows = one.join(two, ["source", "target"]).join(hits, ["source", "target"], "left").withColumn("positive", F.coalesce("_h", F.lit(False))).drop("_h")
    return rounded(E.precision_difference(rows, 60, "apd"), 7)
