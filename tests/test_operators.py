"""Operators on small tables with answers worked out by hand."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import distributions as N
from sparkloom.functions import hyperbolic as H
from sparkloom.operators import dosing as D
from sparkloom.operators import evidence as E
from sparkloom.operators import flow as G
from sparkloom.operators import ranking as R
from sparkloom.operators import space as P
from sparkloom.operators import validate as V


def test_candidate_pool_rules(spark):
    rows = [("A", "one", "x", 1.0, 0.01), ("A", "two", "x", 0.8, 0.03), ("B", "one", "x", -0.7, 0.02), ("C", "three", "y", 0.5, None), ("D", "one", "x", 1.0, None), ("D", "one", "y", -1.0, None), ("E", "one", "x", 0.0, 0.5), ("nan", "one", "x", 9.0, 0.0), (None, "one", "x", 9.0, 0.0)]
    effects = spark.createDataFrame(rows, "gene string, source string, cell_type string, effect double, p double")
    pool = {r["gene"]: r for r in R.candidate_pool(effects, sources=("one", "two", "three")).collect()}
    assert set(pool) == set("ABCDE")
    assert pool["A"]["source_count"] == 2 and pool["A"]["min_p"] == 0.01
    assert pool["D"]["direction_consistency"] == 0.5  # signs cancel
    assert pool["C"]["min_p"] == 1.0 and pool["C"]["neg_log10_p"] == 0.0
    assert pool["E"]["direction_consistency"] == 0.5  # a zero effect has no sign
    ranked = R.evidence_gated_rank(R.candidate_pool(effects, sources=("one", "two", "three"))).orderBy("rank").collect()
    assert ranked[0]["gene"] == "A" and [r["rank"] for r in ranked] == [1, 2, 3, 4, 5] and ranked[0]["final_score"] == 1.0


def test_average_precision_takes_ties_as_blocks(spark):
    scored = spark.createDataFrame([(2.0, True), (1.0, True), (1.0, False), (0.0, False)], "score double, positive boolean")
    r = R.ranking_metrics(scored, "score", "positive").first()
    assert r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and r["auroc"] == pytest.approx(3.5 / 4)
    k = R.precision_at_k(scored.withColumn("n", F.monotonically_increasing_id()), "score", "positive", ["n"], 2).first()
    assert k["tie_aware_precision"] == pytest.approx(0.75)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_benjamini_hochberg_is_the_textbook_rule(spark, ps):
    q = sorted((r["p"], r["q"]) for r in R.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p double"), "p").collect())
    ps, n = sorted(ps), len(ps)
    expected = [min(1.0, min(ps[j] * n / (j + 1) for j in range(i, n))) for i in range(n)]
    assert [a for a, _ in q] == ps and [b for _, b in q] == pytest.approx(expected)


def test_holm_of_two_claims(spark):
    df = spark.createDataFrame([("g", "a", 0.03), ("g", "b", 0.02)], "g string, c string, p double")
    assert {r["c"]: r["adjusted_p"] for r in R.holm(df, "p", ["g"], [F.col("c")]).collect()} == pytest.approx({"b": 0.04, "a": 0.04})


def test_complete_universe(spark):
    raw = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 3.0), ("a", "a", 9.0), ("x", "a", 1.0)], "source string, target string, score double")
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "name string, place int")
    out = {(r["source"], r["target"]): (r["score"], r["returned"]) for r in V.complete_universe(raw, names).collect()}
    assert len(out) == 6 and out["a", "b"] == (3.0, True) and out["b", "a"] == (0.0, False)


def test_filter_order_matters(spark):
    expr = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (3, "a", 1.0), (3, "b", 1.0), (3, "m", 8.0)], "cell_id int, gene string, value double")
    out = V.filter_cells_features(expr, min_features=2, max_features=9, max_marked_share=50, marked=F.col("gene") == "m", min_cells=1)
    assert {(r["cell_id"], r["gene"]) for r in out.collect()} == {(1, "a"), (1, "b")}


def test_boolean_coercion_fails_closed(spark):
    assert [r[0] for r in spark.createDataFrame([("TRUE",), ("0",)], "x string").select(V.to_boolean(F.col("x"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(V.to_boolean(F.col("x"))).collect()


def test_required_columns(spark):
    df = spark.range(1)
    assert V.required_columns(df, ["id", "x"], "t") == ["t: missing column 'x'"]
    with pytest.raises(ValueError, match="missing column 'x'"):
        V.require(df, ["x"], "t")


def test_direction_counts(spark):
    e = spark.createDataFrame([("p", "forward", 1.0), ("p", "reverse", 1.0), ("q", "unresolved", 100.0)], "pathway string, direction_status string, flow_score double")
    r = {x["pathway"]: x for x in G.direction_consistency(e).collect()}
    assert r[None]["resolved"] == 2 and r[None]["rate"] == 0.5 and r[None]["weighted_rate"] == 0.5 and r["q"]["rate"] == 0.0


def test_neighbors_within_a_width_equal_all(spark):
    pts = spark.createDataFrame([(0, i, float((i * 37) % 23), float((i * 17) % 19)) for i in range(60)], "section int, id int, x double, y double")
    key = lambda df: sorted((r["id"], r["neighbor"], r["rank"]) for r in df.collect())
    assert key(P.knn(pts, 4)) == key(P.knn(pts, 4, width=3.0)) == key(P.knn(pts.orderBy(F.rand(1)), 4, width=5.0))


def test_bands(spark):
    cells = spark.createDataFrame([(0, 0, "p", True)] + [(0, i, "", False) for i in range(1, 61)], "section int, id int, perturbation string, positive boolean")
    ranked = P.knn(cells.withColumn("x", F.col("id").cast("double")).withColumn("y", F.lit(0.0)), 60)
    bands = P.perturbation_neighbors(cells, ranked).groupBy("band").count().collect()
    assert {r["band"]: r["count"] for r in bands} == {"proximal": 5, "local": 10, "transition": 15, "distal": 30}


def test_hyperbolic_identities(spark):
    df = spark.createDataFrame([([0.0, 0.3, -0.2], [0.5, 0.1, 0.4])], "v array<double>, w array<double>")
    x = H.exp_map(F.col("v"), H.origin(2))
    y = H.lift(F.col("w"))
    row = df.select(H.inner(x, x).alias("sheet"), H.log_map(x, H.origin(2)).alias("back"), H.from_ball(H.to_ball(x)).alias("same"), x.alias("x"), H.distance(y, H.lift(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))).alias("d"), H.ball_distance(H.to_ball(y), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("e"), H.mobius_add(F.slice("w", 1, 2), F.transform(F.slice("w", 1, 2), lambda z: -z)).alias("zero")).first()
    assert row["sheet"] == pytest.approx(-1) and row["back"] == pytest.approx([0.0, 0.3, -0.2], abs=1e-6)
    assert row["same"] == pytest.approx(row["x"]) and row["d"] == pytest.approx(row["e"]) and row["zero"] == pytest.approx([0, 0])


def test_distributions():
    assert N.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert N.t_two_sided_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert N.t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert N._normal_sf([1.959963985])[0] == pytest.approx(0.025)


def test_step_rules_turn_the_comparison(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    r = lambda kind, way: [y[0] for y in df.select(D.response(F.col("x"), F.lit(kind), F.lit(way), F.lit(0.2), F.lit(0.8), F.lit(2.0), F.lit(1.0))).collect()]
    assert r("step", "increases") == pytest.approx([0.2, 0.8]) and r("step", "decreases") == pytest.approx([0.8, 0.2])
    assert r("linear", "decreases") == pytest.approx([0.5, 0.2])


def test_effects_and_calibration(spark):
    rows = spark.createDataFrame([("A", 1.0, 0.4), ("B", 3.0, 0.6), ("A", 1.0, 0.3)], "gene string, dose double, effect_size double")
    a = {r["gene"]: r for r in D.effect_summary(rows).collect()}["A"]
    assert a["n_rows"] == 2 and a["mean_effect"] == pytest.approx(0.35) and a["std_effect"] == pytest.approx(0.05)
    empty = D.calibrate(D.effect_summary(rows.filter("dose > 9"))).first()
    assert (empty["emax"], empty["ec50"]) == (1.0, 1.0)


def test_decisions(spark):
    nulls = spark.createDataFrame([(float(i) / 10,) for i in range(1, 5)] * 5, "value double")
    r = E.empirical_check(0.5, nulls).first()
    assert r["p"] == pytest.approx(1 / 21) and r["passes"]


def test_own_only_and_decay(spark):
    rows = spark.createDataFrame([(True, 0.0, 2.0, 2.0), (False, 1.0, 2.0, 2 * math.exp(-1)), (False, 2.0, None, 0.1)], "is_perturbed boolean, distance double, own double, observed double")
    out = E.decay_baselines(rows).collect()
    assert [r["own_only"] for r in out] == [2.0, 0.0, None] and out[1]["decay"] == pytest.approx(out[1]["observed"])
    assert E.prediction_metrics(E.decay_baselines(rows), "decay", "observed").first()["coverage"] == pytest.approx(2 / 3)


def test_quantile_bins_merge_equal_edges(spark):
    v = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 3 + [(3.0,)] * 2, "x double")
    assert {r["x"]: r["bin"] for r in E.quantile_bins(v, "x").collect()} == {1.0: 0, 2.0: 1, 3.0: 2}


def test_empty_tables(spark):
    effects = spark.createDataFrame([], "gene string, source string, cell_type string, effect double, p double")
    pool = R.candidate_pool(effects, sources=("a",))
    assert R.evidence_gated_rank(pool).count() == 0
    assert R.benjamini_hochberg(spark.createDataFrame([], "p double"), "p").count() == 0
