"""Queries over rules of a study; the rules' inputs are columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import evidence as E
from ..operators import validate as V
from ._register import query
from .bindings import table

PHASES = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pilot' WHEN 1 THEN 'release' ELSE 'other' END AS phase, CASE event_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'tune' ELSE 'release_holdout' END AS scope, CASE WHEN user_id % 2 = 0 THEN 'score' ELSE 'fit' END AS operation FROM events"


@query("scope_decisions", f"SELECT event_id, CASE WHEN scope = 'train' AND phase IN ('pilot', 'release') THEN 'fit_allowed' WHEN scope = 'tune' AND phase = 'pilot' THEN 'selection_allowed' WHEN scope = 'tune' AND phase = 'release' THEN 'frozen_selection_evidence_only' WHEN scope = 'release_holdout' AND phase = 'release' AND operation = 'score' THEN 'score_once_only' ELSE 'refused' END AS decision FROM ({PHASES})")
def scope_decisions(spark, d):
    e = F.col("event_id")
    phase = F.when(e % 3 == 0, "pilot").when(e % 3 == 1, "release").otherwise("other")
    scope = F.when(e % 4 == 0, "train").when(e % 4 == 1, "tune").otherwise("release_holdout")
    return table(spark, d, "events").select("event_id", C.scope_decision(phase, scope, F.when(F.col("user_id") % 2 == 0, "score").otherwise("fit")).alias("decision"))


STEPS = f"SELECT user_id AS run, event_id AS seq, CASE event_id % 5 WHEN 0 THEN '{C.FREEZE}' WHEN 4 THEN 'unknown' ELSE '{C.REDESIGN}' END AS event FROM events WHERE event_id % 11 < 3"


@query("protocol_states", f"""WITH s AS ({STEPS}), b AS (SELECT *, coalesce(count(*) FILTER (event = '{C.REDESIGN}') OVER w, 0) AS r, coalesce(count(*) FILTER (event = '{C.FREEZE}') OVER w, 0) AS f FROM s WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT run, min(seq) FILTER (CASE event WHEN '{C.REDESIGN}' THEN f > 0 OR r > 0 WHEN '{C.FREEZE}' THEN f > 0 ELSE true END) AS refused_at FROM b GROUP BY run)
SELECT x.run, CASE WHEN count(*) FILTER (event = '{C.FREEZE}' AND (refused_at IS NULL OR seq < refused_at)) > 0 THEN 'release_ready' ELSE 'pilot' END AS phase, count(*) FILTER (event = '{C.REDESIGN}' AND (refused_at IS NULL OR seq < refused_at))::BIGINT AS redesigns, refused_at FROM s JOIN x USING (run) GROUP BY x.run, refused_at""")
def protocol_states(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, C.FREEZE).when(e % 5 == 4, "unknown").otherwise(C.REDESIGN)
    return C.protocol_states(table(spark, d, "events").filter(e % 11 < 3).select(F.col("user_id").alias("run"), e.alias("seq"), kind.alias("event")))


METRICS = {"A": "maximize", "N": "minimize", "R": "maximize"}


@query("contract_issues", """WITH t AS (SELECT p_partkey AS task, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_name END AS title, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'X' END AS metric, CASE p_partkey % 3 WHEN 0 THEN 'maximize' WHEN 1 THEN 'minimize' ELSE 'up' END AS direction, p_size % 5 AS nb, [p_size % 3, p_size % 7, p_partkey % 5] AS seeds, (p_size - 3) / 45.0::DOUBLE AS cov, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size / 100.0::DOUBLE END AS abst, p_partkey % 2 = 0 AS ext, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN 'nan'::DOUBLE ELSE 0.0 END AS imp FROM part),
c AS (SELECT task, [CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN direction = 'up' THEN 'direction' END, CASE WHEN NOT coalesce((metric IN ('A', 'R') AND direction = 'maximize') OR (metric = 'N' AND direction = 'minimize'), false) THEN 'metric' END, CASE WHEN nb < 1 THEN 'baselines' END, CASE WHEN len(list_distinct(seeds)) < 3 THEN 'seeds' END, CASE WHEN len(list_distinct(seeds)) <> 3 THEN 'repeated_seeds' END, CASE WHEN NOT (cov BETWEEN 0 AND 1) THEN 'min_coverage' END, CASE WHEN abst IS NULL OR NOT (abst BETWEEN 0 AND 1) THEN 'max_abstention' END, CASE WHEN NOT ext THEN 'external_holdout' END, CASE WHEN imp IS NULL OR isnan(imp) THEN 'improvement' END] AS l FROM t)
SELECT task, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ';') AS issues FROM c""")
def contract_issues(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(p.alias("task"), F.when(s % 9 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(s % 4 == 0, "A").when(s % 4 == 1, "N").when(s % 4 == 2, "R").otherwise("X").alias("metric"), F.when(p % 3 == 0, "maximize").when(p % 3 == 1, "minimize").otherwise("up").alias("direction"), F.array_repeat(F.lit("b"), s % 5).alias("baselines"), F.array((s % 3).cast("bigint"), (s % 7).cast("bigint"), p % 5).alias("seeds"), ((s - 3) / 45.0).alias("min_coverage"), F.when(s % 6 != 0, s / 100.0).alias("max_abstention"), (p % 2 == 0).alias("external_holdout"), F.when(p % 8 == 0, None).when(p % 8 == 1, float("nan")).otherwise(0.0).alias("improvement"))
    return C.contract_issues(rows, METRICS).select("task", F.array_join("issues", ";").alias("issues"))


@query("readiness", "WITH s AS (SELECT c_mktsegment AS method, CASE WHEN min(c_acctbal) < -998.5 THEN 'failed' ELSE 'passed' END AS status FROM customer GROUP BY ALL), g AS (SELECT count(*) FILTER (method IN ('BUILDING', 'MACHINERY') AND status = 'passed') = 2 AS core_methods, count(*) FILTER (method IN ('AUTOMOBILE', 'FURNITURE') AND status = 'passed') > 0 AS interventional_method, count(*) = 5 AS all_methods_classified, true AS data_checks, false AS project_tests FROM s) SELECT *, core_methods AND interventional_method AND all_methods_classified AND data_checks AND project_tests AS ready FROM g")
def readiness(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("method")).agg(F.when(F.min("c_acctbal") < -998.5, "failed").otherwise("passed").alias("status"))
    return C.readiness(s, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], ["BUILDING", "MACHINERY"], ["AUTOMOBILE", "FURNITURE"], ["passed", "failed"], {"data_checks": True, "project_tests": False})


SEED_RUNS = "SELECT DISTINCT c_nationkey AS method, (c_custkey % (5 + c_nationkey % 3))::INT AS seed FROM customer WHERE c_nationkey <> 3 OR c_custkey % 5 <> 0 UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_nationkey % 4 = 2"


@query("paired_collection", f"WITH r AS ({SEED_RUNS}), k AS (SELECT method, seed, count(*) AS n FROM r GROUP BY ALL) SELECT method, (5 - count(*) FILTER (seed < 5))::BIGINT AS missing, count(*) FILTER (n > 1)::BIGINT AS repeated, count(*) FILTER (seed >= 5)::BIGINT AS unexpected, count(*) FILTER (seed < 5) = 5 AND count(*) FILTER (n > 1) = 0 AND count(*) FILTER (seed >= 5) = 0 AS complete FROM k GROUP BY method")
def paired_collection(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    runs = table(spark, d, "customer").filter((n != 3) | (k % 5 != 0)).select(n.alias("method"), (k % (5 + n % 3)).cast("int").alias("seed")).distinct()
    twice = table(spark, d, "nation").filter("n_nationkey % 4 = 2").select(F.col("n_nationkey").alias("method"), F.lit(0).alias("seed"))
    return C.paired_collection(runs.union(twice), [0, 1, 2, 3, 4])


SPOTS = "SELECT o_orderkey AS spot, o_orderstatus AS first, CASE o_custkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN NULL WHEN 2 THEN 'F' ELSE 'P' END AS second, CASE WHEN o_orderkey % 3 = 0 THEN 'Doublet_certain' WHEN o_orderkey % 3 = 1 THEN 'singlet' END AS kind FROM orders"


@query("abundance_table", f"WITH s AS (SELECT *, contains(lower(coalesce(kind, '')), 'doublet') AND coalesce(second, 'Unknown') <> 'Unknown' AS split FROM ({SPOTS})), w AS (SELECT spot, first AS label, CASE WHEN split THEN 0.5::DOUBLE ELSE 1 END AS w FROM s UNION ALL SELECT spot, second, 0.5 FROM s WHERE split) SELECT spot, {', '.join(f'''coalesce(sum(w) FILTER (label = '{x}'), 0) AS "{x}"''' for x in 'FOP')} FROM w GROUP BY spot")
def abundance_table(spark, d):
    c, o = F.col("o_custkey") % 4, F.col("o_orderkey")
    rows = table(spark, d, "orders").select(o.alias("spot"), F.col("o_orderstatus").alias("first"), F.when(c == 0, "Unknown").when(c == 2, "F").when(c == 3, "P").alias("second"), F.when(o % 3 == 0, "Doublet_certain").when(o % 3 == 1, "singlet").alias("kind"))
    return C.abundance(C.doublet_weights(rows), ["F", "O", "P"])


@query("platform_audit", "WITH p AS (SELECT unnest(['A', 'N', 'R', 'Z']) AS platform), u AS (SELECT l_returnflag AS platform, l_suppkey AS sample, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS x, l_tax AS y, CASE WHEN l_returnflag = 'A' THEN l_linestatus END AS label FROM lineitem), f AS (SELECT DISTINCT l_returnflag AS platform, upper(p_brand) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 1 AND upper(p_brand) IN ('BRAND#1', 'BRAND#7', 'BRAND#99') AND (p_size > 40 OR l_returnflag = 'A')) SELECT p.platform, count(u.platform) > 0 AS has_data, count(u.platform)::BIGINT AS n_units, count(DISTINCT sample)::BIGINT AS n_samples, coalesce(bool_or(x IS NOT NULL AND y IS NOT NULL), false) AS has_coordinates, coalesce(bool_or(label IS NOT NULL), false) AS has_labels, coalesce((SELECT string_agg(n, ';' ORDER BY n) FROM f WHERE f.platform = p.platform), '') AS covered FROM p LEFT JOIN u USING (platform) GROUP BY p.platform")
def platform_audit(spark, d):
    items = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    units = items.select(flag.alias("platform"), F.col("l_suppkey").alias("sample"), F.when(flag != "N", F.col("l_quantity")).alias("x"), F.col("l_tax").alias("y"), F.when(flag == "A", F.col("l_linestatus")).alias("label"))
    names = items.filter("l_quantity = 1").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).filter((F.col("p_size") > 40) | (flag == "A")).select(flag.alias("platform"), F.col("p_brand").alias("name"))
    return C.platform_audit(spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "platform string"), units, names, ["Brand#1", "Brand#7", "Brand#99"])


@query("canonical_identity", "SELECT p_partkey, '{\"p_brand\":' || to_json(p_brand) || ',\"p_name\":' || to_json(p_name) || ',\"p_size\":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE p_size::VARCHAR END || '}' AS json, sha256('{\"p_brand\":' || to_json(p_brand) || ',\"p_name\":' || to_json(p_name) || ',\"p_size\":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE p_size::VARCHAR END || '}') AS identity FROM part")
def canonical_identity(spark, d):
    p = table(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    return p.select("p_partkey", C.canonical_json("p_size", "p_name", "p_brand").alias("json"), C.canonical_sha256("p_size", "p_name", "p_brand").alias("identity"))


CLAIMS = "SELECT c_nationkey AS claim, c_mktsegment AS comparator, round(avg(c_acctbal) - 4000, 4) AS ci_low, round(min(abs(c_acctbal)) / 9000, 6) AS adjusted_p, count(*)::INT AS attempted, count(*) FILTER (c_acctbal > -940)::INT AS completed FROM customer GROUP BY ALL"
NEEDED = "SELECT n_nationkey AS claim, unnest(['BUILDING', 'MACHINERY']) AS comparator FROM nation UNION ALL SELECT 99, 'BUILDING'"
DECIDED = f"WITH r AS (SELECT n.claim, e.* EXCLUDE (claim, comparator) FROM ({NEEDED}) n LEFT JOIN ({CLAIMS}) e ON e.claim = n.claim AND e.comparator = n.comparator), s AS (SELECT claim, count(*) FILTER (attempted IS NULL) AS m, count(*) FILTER (attempted <> completed) AS i, count(*) FILTER (attempted = completed AND NOT (coalesce(ci_low > 0, false) AND coalesce(adjusted_p < 0.05, false))) AS w FROM r GROUP BY claim), d AS (SELECT claim, CASE WHEN m + i > 0 THEN 'blocked' WHEN w > 0 THEN 'audit_only' ELSE 'admitted' END AS status FROM s)"


def decisions(spark, d):
    c = table(spark, d, "customer")
    ev = c.groupBy(F.col("c_nationkey").alias("claim"), F.col("c_mktsegment").alias("comparator")).agg(F.round(F.avg("c_acctbal") - 4000, 4).alias("ci_low"), F.round(F.min(F.abs("c_acctbal")) / 9000, 6).alias("adjusted_p"), F.count(F.lit(1)).cast("int").alias("attempted"), F.count_if(F.col("c_acctbal") > -940).cast("int").alias("completed"), F.collect_set(F.when(F.col("c_acctbal") > -940, "completed").otherwise("failed")).alias("statuses"))
    need = table(spark, d, "nation").select(F.col("n_nationkey").alias("claim"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("comparator"))
    return E.claim_decisions(ev, need.union(spark.createDataFrame([(99, "BUILDING")], "claim int, comparator string")))


@query("claim_decisions", f"{DECIDED} SELECT claim, status FROM d")
def claim_decisions(spark, d):
    return decisions(spark, d).select("claim", "status")


@query("joint_claim", f"{DECIDED} SELECT a.claim AS first, CASE WHEN a.status = 'blocked' OR b.status = 'blocked' THEN 'blocked' WHEN a.status = 'admitted' AND b.status = 'admitted' THEN 'admitted' ELSE 'audit_only' END AS status FROM d a JOIN d b ON b.claim = a.claim + 1 WHERE a.claim IN (0, 7, 14)")
def joint_claim(spark, d):
    made = decisions(spark, d)
    out = [E.joint_claim(made, a, a + 1).select(F.lit(a).alias("first"), "status") for a in (0, 7, 14)]
    return out[0].union(out[1]).union(out[2])


@query("promotion_gates", "SELECT c_nationkey AS task, count(*) FILTER (c_acctbal > -900) / count(*)::DOUBLE >= 0.9 AND count(*) FILTER (c_acctbal < -900) / count(*)::DOUBLE <= 0.1 AND count(DISTINCT c_custkey % 7) >= 3 AND max(c_acctbal) > 9000 AND min(c_custkey) < 500 AND min(g) > 4300 AS promoted FROM customer JOIN (SELECT c_nationkey, min(v) AS g FROM (SELECT c_nationkey, c_custkey % 2, avg(c_acctbal) AS v FROM customer GROUP BY ALL) GROUP BY ALL) USING (c_nationkey) GROUP BY c_nationkey")
def promotion_gates(spark, d):
    c = table(spark, d, "customer")
    gains = c.groupBy("c_nationkey", (F.col("c_custkey") % 2).alias("half")).agg(F.avg("c_acctbal").alias("v")).groupBy(F.col("c_nationkey").alias("task")).agg(F.collect_list(F.col("v") - 4300).alias("improvement"))
    n = F.count(F.lit(1))
    ev = c.groupBy(F.col("c_nationkey").alias("task")).agg((F.count_if(F.col("c_acctbal") > -900) / n).alias("coverage"), (F.count_if(F.col("c_acctbal") < -900) / n).alias("abstention"), F.count_distinct(F.col("c_custkey") % 7).cast("int").alias("seeds"), F.array(F.max("c_acctbal") > 9000, F.min("c_custkey") < 500).alias("gates"))
    return E.promotion(ev.join(gains, "task"), 0.9, 0.1, 3, 0.0).select("task", "promoted")


ONE = "SELECT count(DISTINCT p_brand)::DOUBLE AS genes, corr(p_size, p_retailprice) AS r2, CASE WHEN min(p_size) > 100 THEN 1.0::DOUBLE END AS score FROM part"


@query("module_admission", f"WITH o AS ({ONE}), m AS (SELECT unnest([{{'module': 'ranking', 'metric': genes, 'least': 1.0}}, {{'module': 'spatial', 'metric': r2, 'least': 0.5}}, {{'module': 'perturbation', 'metric': score, 'least': 0.1}}]) AS x FROM o) SELECT x.module AS module, round(x.metric, 6) + 0.0 AS metric, CASE WHEN x.metric IS NULL THEN 'missing' WHEN x.metric >= x.least THEN 'admitted' ELSE 'audit_only' END AS status FROM m")
def module_admission(spark, d):
    p = table(spark, d, "part")
    one = p.agg(F.count_distinct("p_brand").cast("double").alias("genes"), F.corr("p_size", "p_retailprice").alias("r2"), F.when(F.min("p_size") > 100, 1.0).alias("score"))
    return E.module_admission(one, [("ranking", "genes", 1.0), ("spatial", "r2", 0.5), ("perturbation", "score", 0.1)]).withColumn("metric", F.round("metric", 6) + 0.0)


@query("canonical_names", "SELECT p_partkey, length(n) > 0 AND trim(n) = n AND NOT regexp_matches(n, '[\\x00-\\x1F\\x7F]') AND nfc_normalize(n) = n AS canonical FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ' ' || p_name WHEN 1 THEN p_name || chr(7) WHEN 2 THEN '' WHEN 3 THEN 'e' || chr(769) || p_name ELSE p_name END AS n FROM part)")
def canonical_names(spark, d):
    s, n = F.col("p_size") % 6, F.col("p_name")
    noisy = F.when(s == 0, F.concat(F.lit(" "), n)).when(s == 1, F.concat(n, F.lit("\x07"))).when(s == 2, "").when(s == 3, F.concat(F.lit("é"), n)).otherwise(n)
    return table(spark, d, "part").select("p_partkey", V.canonical_text(noisy).alias("canonical"))


@query("kept_cells", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def kept_cells(spark, d):
    return V.keep_equal(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")
