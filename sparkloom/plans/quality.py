"""Queries over checks, label maps, joins and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summary as S
from ..operators import validate as V
from ._register import query
from .bindings import CELLS, EXPR, FLOW, POINTS, cells, expr, flow, nodes, points, table

#: An ordered taxonomy over part types.
TYPE_RULES = [(["standard", "economy"], "basic_plain"), (["promo"], "basic_offer"), (["large", "medium"], "sized")]
TYPE_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p_type), '{t}')" for t in ts) + f" THEN '{n}'" for ts, n in TYPE_RULES) + " ELSE 'Unknown' END"


@query("duplicate_key_report", "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS n_keys, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS n_duplicates FROM lineitem")
def duplicate_key_report(spark, d):
    return V.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("null_report", "SELECT 'l_quantity' AS column_name, count(*) FILTER (l_quantity IS NULL OR isnan(l_quantity))::BIGINT AS n_missing FROM lineitem UNION ALL SELECT 'l_shipdate', count(*) FILTER (l_shipdate IS NULL)::BIGINT FROM lineitem")
def null_report(spark, d):
    return V.null_report(table(spark, d, "lineitem"), ["l_quantity", "l_shipdate"])


@query("label_taxonomy_map", f"SELECT {TYPE_CASE} AS level1, CASE {TYPE_CASE} WHEN 'basic_plain' THEN 'basic' WHEN 'basic_offer' THEN 'basic' ELSE {TYPE_CASE} END AS level0, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def label_taxonomy_map(spark, d):
    parts = table(spark, d, "part").withColumn("level1", V.label_by_rules(F.col("p_type"), TYPE_RULES))
    return V.map_names(parts, "level1", {"basic_plain": "basic", "basic_offer": "basic"}, "level0").groupBy("level1", "level0").agg(F.count(F.lit(1)).alias("n"))


@query("first_nonempty_label", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN 'NA' ELSE p_brand END), CASE WHEN p_size % 3 = 1 THEN 'NA' ELSE '' END), p_type) AS label FROM part")
def first_nonempty_label(spark, d):
    p = table(spark, d, "part")
    noisy = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, "NA").otherwise(F.col("p_brand"))
    return p.select("p_partkey", V.first_nonempty(noisy, F.col("p_type")).alias("label"))


@query("cohort_selection", f"SELECT cell_id FROM ({CELLS}) WHERE cell_type IN ('BUILDING', 'MACHINERY') AND label ILIKE '%high%' AND response IS NOT NULL AND length(label) > 0")
def cohort_selection(spark, d):
    """FIL7: membership, text within text in any case, and values that are there."""
    c = cells(spark, d)
    return c.filter(F.col("cell_type").isin("BUILDING", "MACHINERY") & F.col("label").ilike("%high%") & F.col("response").isNotNull() & (F.length("label") > 0)).select("cell_id")


@query("unique_feature_names", "SELECT p_partkey, CASE WHEN k = 0 THEN p_brand ELSE p_brand || '.' || k END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)")
def unique_feature_names(spark, d):
    return V.unique_names(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("integer_count_audit", "SELECT round(avg((c_acctbal <> floor(c_acctbal))::INT), 6) AS fraction_non_integer, count(*) FILTER (c_acctbal < 0)::BIGINT AS n_negative, round(sum(c_acctbal), 2) AS sum_before, sum(round_even(greatest(c_acctbal, 0), 0))::BIGINT AS sum_after FROM customer")
def integer_count_audit(spark, d):
    out = V.integer_audit(table(spark, d, "customer"), "c_acctbal")
    return out.select(F.round("fraction_non_integer", 6).alias("fraction_non_integer"), "n_negative", F.round("sum_before", 2).alias("sum_before"), "sum_after")


@query("boolean_coercion", "SELECT quality = 1 AS flag, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def boolean_coercion(spark, d):
    return table(spark, d, "labels").groupBy(V.to_boolean(F.col("quality")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("significance_filter", "SELECT event_id FROM events WHERE value / 400 < 0.05 AND abs(value - 10) > 0.5")
def significance_filter(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 400).alias("p"), (F.col("value") - 10).alias("x"))
    return V.significant(e, "x", "p").select("event_id")


@query("nan_tolerant_filter", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'nan'::DOUBLE ELSE value / 400 END AS p, value - 10 AS x FROM events) WHERE NOT ((NOT isnan(p) AND p > 0.05) OR abs(x) < 0.3)")
def nan_tolerant_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value") / 400).alias("p"), (F.col("value") - 10).alias("x"))
    return V.not_insignificant(e, "x", "p").select("event_id")


QC = f"""WITH e AS ({EXPR}), c AS (SELECT cell_id, count(*) FILTER (value <> 0) AS n, sum(value) AS t, coalesce(sum(value) FILTER (gene LIKE 'Brand#1%'), 0) AS m FROM e GROUP BY cell_id),
k AS (SELECT * FROM e WHERE cell_id IN (SELECT cell_id FROM c WHERE n >= 2 AND n < 7 AND 100 * m / t < 60)), f AS (SELECT gene FROM k GROUP BY gene HAVING count(*) FILTER (value <> 0) >= 100)"""


@query("cell_feature_qc", f"{QC} SELECT gene, count(*)::BIGINT AS n_cells, round(sum(value), 2) AS total FROM k WHERE gene IN (SELECT gene FROM f) GROUP BY gene")
def cell_feature_qc(spark, d):
    kept = V.filter_cells_features(expr(spark, d), min_features=2, max_features=7, max_marked_share=60, marked=F.col("gene").startswith("Brand#1"), min_cells=100)
    return kept.groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("value"), 2).alias("total"))


@query("first_row_per_key", "SELECT donor, cell_id FROM (SELECT o_custkey AS donor, o_orderkey AS cell_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_row_per_key(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("donor"), F.col("o_orderkey").alias("cell_id"), "o_totalprice")
    return V.first_row(o, ["donor"], [F.col("o_totalprice").desc(), F.col("cell_id")]).select("donor", "cell_id")


@query("star_metadata_merge", "SELECT o_orderkey AS cell_id, c_mktsegment AS cell_type, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def star_metadata_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("cell_type"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"), "n_regionkey")
    return V.star_merge(o, c, n, "c_custkey", "n_nationkey", F.col("n_regionkey") == 2).select("cell_id", "cell_type", "nation")


@query("method_comparison", f"SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.qty, 0)::DOUBLE AS value_a, coalesce(b.n, 0)::DOUBLE AS value_b FROM (SELECT * FROM ({FLOW}) WHERE qty > 2500) a FULL JOIN (SELECT * FROM ({FLOW}) WHERE n > 100) b ON a.src = b.src AND a.dst = b.dst")
def method_comparison(spark, d):
    f = flow(spark, d)
    return V.outer_compare(f.filter("qty > 2500").withColumn("v", F.col("qty").cast("double")), f.filter("n > 100").withColumn("v", F.col("n").cast("double")), ["src", "dst"], "v")


RAW_EDGES = f"SELECT src, dst, max(qty / 1000.0) AS score FROM ({FLOW}) WHERE src <> dst AND qty > 2000 GROUP BY ALL"
UNIVERSE = f"SELECT a.n_nationkey AS source, b.n_nationkey AS target, coalesce(score, 0) AS score, score IS NOT NULL AS returned FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey LEFT JOIN ({RAW_EDGES}) ON src = a.n_nationkey AND dst = b.n_nationkey"


def universe(spark, d, floor=2000):
    raw = flow(spark, d).filter(F.col("qty") > floor).select(F.col("src").alias("source"), F.col("dst").alias("target"), (F.col("qty") / 1000.0).alias("score"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_nationkey").alias("place"))
    return V.complete_universe(raw, names)


@query("complete_universe", f"SELECT source, target, round(score, 6) AS score, returned FROM ({UNIVERSE})")
def complete_universe(spark, d):
    return universe(spark, d).select("source", "target", F.round("score", 6).alias("score"), "returned")


@query("paired_universe", f"SELECT a.source, a.target, round(a.score, 6) AS score_a, round(b.score, 6) AS score_b, (a.source + a.target) % 7 = 0 AS is_reference, a.source % 2 = 0 AS is_eligible FROM ({UNIVERSE}) a JOIN ({UNIVERSE.replace('2000', '3000')}) b ON a.source = b.source AND a.target = b.target")
def paired_universe(spark, d):
    a = universe(spark, d)
    reference = a.filter((F.col("source") + F.col("target")) % 7 == 0)
    out = V.paired_universe(a, universe(spark, d, 3000), reference, a.filter(F.col("source") % 2 == 0))
    return out.select("source", "target", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"), "is_reference", "is_eligible")


@query("label_fallback_join", "SELECT c_name AS key, s_name AS label FROM customer LEFT JOIN supplier ON substring(c_name, 10) = substring(s_name, 10)")
def label_fallback_join(spark, d):
    rows = table(spark, d, "customer").select(F.regexp_replace("c_name", "#", "_").alias("key"))
    labels = table(spark, d, "supplier").select(F.regexp_replace("s_name", "#", "_").alias("key"), F.col("s_name").alias("label"))
    return V.join_or_fallback(rows, labels, "key", "label").select(F.regexp_replace("key", "_", "#").alias("key"), "label")


@query("first_match_lookup", "SELECT n_name AS key, payload FROM nation LEFT JOIN (SELECT key, arg_min(p_partkey, (p_partkey, pos)) AS payload FROM (SELECT p_partkey, 0 AS pos, n_name AS key FROM part JOIN nation ON p_size % 25 = n_nationkey UNION ALL SELECT p_partkey, 1, n_name FROM part JOIN nation ON p_partkey % 25 = n_nationkey) GROUP BY key) ON key = n_name")
def first_match_lookup(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).alias("a"), (F.col("p_partkey") % 25).cast("int").alias("b"))
    named = p.join(n.toDF("a", "name_a"), "a").join(n.toDF("b", "name_b"), "b").withColumn("payload", F.col("p_partkey"))
    return V.first_match(n.select(F.col("n_name").alias("key")), named, ["name_a", "name_b"], "p_partkey")


@query("type_summary", f"SELECT cell_type, response, count(*)::BIGINT AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS fraction FROM ({CELLS}) GROUP BY ALL")
def type_summary(spark, d):
    return S.counts_and_shares(cells(spark, d), ["cell_type", "response"]).withColumn("fraction", F.round("fraction", 6))


@query("donor_qc_summary", f"SELECT donor, count(*)::BIGINT AS total, count(*) FILTER (response <> 'P')::BIGINT AS kept, count(*) FILTER (response = 'P')::BIGINT AS removed FROM ({CELLS}) GROUP BY donor")
def donor_qc_summary(spark, d):
    return S.kept_removed(cells(spark, d), ["donor"], F.col("response") != "P")


@query("type_crosstab", f"SELECT cell_type, count(*) FILTER (response = 'F')::BIGINT AS \"F\", count(*) FILTER (response = 'O')::BIGINT AS \"O\", count(*) FILTER (response = 'P')::BIGINT AS \"P\" FROM ({CELLS}) GROUP BY cell_type")
def type_crosstab(spark, d):
    return S.crosstab(cells(spark, d), "cell_type", "response", ["F", "O", "P"])


@query("area_ratio_summary", "SELECT count(*)::BIGINT AS n, round(avg(a), 4) AS mean_a, round(quantile_cont(a, 0.5), 4) AS median_a, round(avg(b), 4) AS mean_b, round(quantile_cont(b, 0.5), 4) AS median_b, round(avg(b / nullif(a, 0)), 6) AS mean_ratio FROM (SELECT o_orderkey, sum(l_quantity) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) JOIN (SELECT l_orderkey, sum(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) ON o_orderkey = l_orderkey")
def area_ratio_summary(spark, d):
    items = table(spark, d, "lineitem")
    both = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(items, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"))
    inner = items.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"))
    out = S.area_summary(both, inner, "l_orderkey", "area")
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("mean_a", "median_a", "mean_b", "median_b")), F.round("mean_ratio", 6).alias("mean_ratio"))


GRID = "SELECT floor((x - (SELECT min(x) FROM p)) / 100)::BIGINT AS gx, floor((y - (SELECT min(y) FROM p)) / 100)::BIGINT AS gy, count(*)::BIGINT AS n, round(avg(value), 4) AS value FROM p GROUP BY ALL"


@query("grid_means", f"WITH p AS ({POINTS}) {GRID}")
def grid_means(spark, d):
    return S.grid_means(points(spark, d), "x", "y", 100.0, ["value"]).withColumn("value", F.round("value", 4))


GRID_LABEL = "SELECT gx, gy, round(avg(v), 6) AS value, CASE WHEN avg(a) >= avg(b) THEN 'a' ELSE 'b' END AS label FROM (SELECT floor(x / 100) AS gx, floor(y / 100) AS gy, {} AS v, (cell_type = '{}')::INT AS a, (cell_type = '{}')::INT AS b FROM p) GROUP BY ALL"


@query("grid_concordance", f"WITH p AS ({POINTS}), a AS ({GRID_LABEL.format('value', 'BUILDING', 'MACHINERY')}), b AS ({GRID_LABEL.format('x + y', 'HOUSEHOLD', 'FURNITURE')}) SELECT count(*)::BIGINT AS n, round(corr(a.value, b.value), 6) AS pearson, round(avg((a.label = b.label)::INT), 6) AS concordance FROM a JOIN b USING (gx, gy)")
def grid_concordance(spark, d):
    """Two annotations of one grid: a value and a dominant label of two types each."""
    def side(value, first, second):
        p = points(spark, d).select(F.floor(F.col("x") / 100).alias("gx"), F.floor(F.col("y") / 100).alias("gy"), value.alias("value"), (F.col("cell_type") == first).cast("int").alias("a"), (F.col("cell_type") == second).cast("int").alias("b"))
        means = p.groupBy("gx", "gy").agg(F.round(F.avg("value"), 6).alias("value"), F.avg("a").alias("a"), F.avg("b").alias("b"))
        return means.select("gx", "gy", "value", S.dominant(["a", "b"]).alias("label"))

    out = S.grid_concordance(side(F.col("value"), "BUILDING", "MACHINERY"), side(F.col("x") + F.col("y"), "HOUSEHOLD", "FURNITURE"))
    return out.select("n", F.round("pearson", 6).alias("pearson"), F.round("concordance", 6).alias("concordance"))


@query("abundance_summary", f"WITH p AS ({POINTS}) SELECT cell_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95 FROM p GROUP BY cell_type")
def abundance_summary(spark, d):
    out = S.spread(points(spark, d), ["cell_type"], "value")
    return out.select("cell_type", "n", *(F.round(c, 4).alias(c) for c in ("mean", "p05", "median", "p95")))


@query("type_composition", f"SELECT donor, round(b / (b + m)::DOUBLE, 6) AS high, round(m / (b + m)::DOUBLE, 6) AS low FROM (SELECT donor, count(*) FILTER (label IN ('1-URGENT', '2-HIGH')) AS b, count(*) FILTER (label NOT IN ('1-URGENT', '2-HIGH')) AS m FROM ({CELLS}) GROUP BY donor)")
def type_composition(spark, d):
    high = F.col("label").isin("1-URGENT", "2-HIGH")
    wide = cells(spark, d).groupBy("donor").agg(F.count_if(high).alias("high"), F.count_if(~high).alias("low"))
    return S.row_fractions(wide, ["high", "low"]).select("donor", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


@query("name_combinations", "WITH r AS (SELECT r_name AS name FROM region) SELECT name AS combo, 1 AS size FROM r UNION ALL SELECT a.name || '+' || b.name, 2 FROM r a JOIN r b ON a.name < b.name UNION ALL SELECT a.name || '+' || b.name || '+' || c.name, 3 FROM r a JOIN r b ON a.name < b.name JOIN r c ON b.name < c.name")
def name_combinations(spark, d):
    return S.combinations(table(spark, d, "region").select(F.col("r_name").alias("name")), 3).select(F.array_join("combo", "+").alias("combo"), "size")


@query("set_overlap", f"WITH a AS (SELECT DISTINCT src, dst FROM ({FLOW}) WHERE qty > 2500), b AS (SELECT DISTINCT src, dst FROM ({FLOW}) WHERE n > 100) SELECT (SELECT count(*) FROM a)::BIGINT AS n_a, (SELECT count(*) FROM b)::BIGINT AS n_b, (SELECT count(*) FROM a JOIN b USING (src, dst))::BIGINT AS n_both, coalesce(round((SELECT count(*) FROM a JOIN b USING (src, dst)) / nullif((SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 0)::DOUBLE, 6), 0) AS jaccard")
def set_overlap(spark, d):
    f = flow(spark, d)
    return S.jaccard(f.filter("qty > 2500"), f.filter("n > 100"), ["src", "dst"]).withColumn("jaccard", F.round("jaccard", 6))


@query("wide_to_long", "SELECT region, kind, n FROM (SELECT r_name AS region, count(*) FILTER (c_acctbal >= 0)::BIGINT AS credit, count(*) FILTER (c_acctbal < 0)::BIGINT AS debit FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) UNPIVOT (n FOR kind IN (credit, debit))")
def wide_to_long(spark, d):
    """SET6."""
    c = table(spark, d, "customer").join(nodes(spark, d), F.col("c_nationkey") == F.col("node"))
    wide = c.groupBy(F.col("node_type").alias("region")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("credit"), F.count_if(F.col("c_acctbal") < 0).alias("debit"))
    return wide.unpivot(["region"], ["credit", "debit"], "kind", "n")


