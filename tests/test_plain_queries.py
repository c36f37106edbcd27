"""Queries that SQL has no form for, against plain versions on the smallest tables; and functions of their own."""

from __future__ import annotations

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import distributions as T
from sparkloom.functions import graphs as A
from sparkloom.operators import contracts, discovery, niches, screening
from sparkloom.plans import bindings as B
from sparkloom.plans.registry import QUERIES


def edges_of(spark, small):
    return sorted((r["src"], r["dst"], r["w"]) for r in B.causal(spark, small).collect())


def test_acyclic_graph(spark, small):
    edges = edges_of(spark, small)
    got = sorted((r["src"], r["dst"]) for r in QUERIES["acyclic_graph"](spark, small).collect())
    reach = {a: {b for x, b in got if x == a} for a in range(25)}
    for _ in range(25):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    assert all(a not in bs for a, bs in reach.items())  # no way leads back
    assert set(got) <= {(a, b) for a, b, _ in edges}
    for a, b in {(a, b) for a, b, _ in edges} - set(got):  # what went closed a cycle of edges that were there
        assert A._cycle([(x, y) for x, y, _ in edges]) is not None and (a, b) not in got


def test_topology_filtered_graph(spark, small):
    lines = B.nation_lines(spark, small).groupBy(F.year("l_shipdate").alias("y"), "src", "dst").count().collect()
    for year in {r["y"] for r in lines}:
        x = np.zeros((25, 25))
        for r in lines:
            if r["y"] == year:
                x[r["src"], r["dst"]] = r["count"]
        x = (x + x.T) / 2
        u, s, v = np.linalg.svd(x)
        y = (u[:, :10] * (s[:10] ** 3 / (s[:10] ** 2 + 100))) @ v[:10]
        y = np.maximum((y + y.T) / 2, 0)
        np.fill_diagonal(y, 0)
        y[y < 1.0] = 0
        got = np.zeros((25, 25))
        for r in QUERIES["topology_filtered_graph"](spark, small).filter(F.col("year") == year).collect():
            got[r["src"], r["dst"]] = r["w"]
        assert np.allclose(got, y, atol=1e-8)


def test_prototype_matching(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    labels = sorted({r["label"] for r in rows})
    means = [[np.mean([r["embedding"] for r in rows if r["vec_id"] % 2 == h and r["label"] == x], axis=0) for x in labels] for h in (0, 1)]
    r = np.array([[np.corrcoef(a, b)[0, 1] for b in means[1]] for a in means[0]])
    best = {0: 0.0}  # the largest total by set of columns taken
    for i in range(len(labels)):
        best = _step(best, r[i])
    got = QUERIES["prototype_matching"](spark, small).collect()
    assert sum(x["correlation"] for x in got) == pytest.approx(max(best.values()), abs=1e-6) and len({x["label_b"] for x in got}) == len(labels)


def _step(best, row):
    out: dict[int, float] = {}
    for taken, total in best.items():
        for j, x in enumerate(row):
            if not taken >> j & 1:
                out[taken | 1 << j] = max(out.get(taken | 1 << j, -math.inf), total + x)
    return out


def test_pc_bootstrap_edges(spark, small):
    values = collections.defaultdict(list)
    types = {r["node"]: r["node_type"] for r in B.nodes(spark, small).collect()}
    for r in B.node_expr(spark, small).collect():
        values[r["gene"], types[r["node"]]].append(r["value"])
    genes, kinds = sorted({g for g, _ in values}), sorted(set(types.values()))
    data = np.array([[np.mean(values[g, t]) if values[g, t] else 0.0 for t in kinds] for g in genes])
    expected = collections.Counter()
    for repeat in range(20):
        x = data[np.random.default_rng([1, repeat]).integers(0, len(data), len(data))]
        expected.update(zip(*(a.tolist() for a in np.nonzero(A.pc(x, 0.2, 3))), strict=True))
    got = {(r["src"], r["dst"]): r["frequency"] for r in QUERIES["pc_bootstrap_edges"](spark, small).collect()}
    assert got == pytest.approx({k: n / 20 for k, n in expected.items()})


def test_pc_takes_the_smaller_columns_neighbours(spark):
    """Fixed by hand: the second level tests columns 0 and 1 given a neighbour of 0, never one of 1 alone."""
    r = np.random.default_rng(3)
    a, noise = r.normal(size=600), r.normal(size=(600, 3))
    data = np.stack([a, a + 0.5 * noise[:, 0], a + 0.5 * noise[:, 1], noise[:, 2]], 1)
    out = A.pc(data, 0.05, 2)
    assert not out[:3, 3].any() and not out[3, :3].any() and (out | out.T)[0, 1] and (out | out.T)[0, 2] and not (out | out.T)[1, 2]
    n, x = 600, np.corrcoef(data[:, 0], data[:, 1])[0, 1]
    assert A.partial_correlation_p(data, 0, 3, ()) == pytest.approx(T.t_two_sided_p(np.corrcoef(data[:, 0], data[:, 3])[0, 1] * math.sqrt((n - 2) / (1 - np.corrcoef(data[:, 0], data[:, 3])[0, 1] ** 2)), n - 2))
    assert x > 0.8 and A.partial_correlation_p(data, 1, 2, (0,)) > 0.05


def test_niche_queries(spark, small):
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert QUERIES["niche_kmeans"](spark, small).agg(F.sum("n")).first()[0] == n
    rows = QUERIES["niche_hierarchy"](spark, small).collect()
    assert len(rows) == 25 and sorted(r["id"] for r in rows) == list(range(25))
    for fine, coarse in (("micro", "small"), ("small", "medium"), ("medium", "macro")):  # each level is made of the one before
        assert len({(r[fine], r[coarse]) for r in rows}) == len({r[fine] for r in rows}) and len({r[fine] for r in rows}) >= len({r[coarse] for r in rows})
    assert len({r["macro"] for r in rows}) >= 2


def test_sparse_sem(spark, small):
    from sparkloom.plans.bindings import cells, expr

    genes = [f"Brand#{i}" for i in range(1, 26)]
    rows = expr(spark, small).join(cells(spark, small), "cell_id").groupBy("response", "donor", "gene").agg(F.avg("value").alias("v")).toPandas()
    got = {(r["response"], r["src"], r["dst"]): r["w"] for r in QUERIES["sparse_sem"](spark, small).collect()}
    expected = {}
    for kind, part in rows.groupby("response"):
        x = part.pivot(index="donor", columns="gene", values="v").reindex(columns=genes).fillna(0.0).to_numpy()
        s = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(s > 1e-6, s, 1)
        a = A.linear_sem(x, np.ones_like(x), steps=300)
        expected |= {(kind, genes[i], genes[j]): a[i, j] for i, j in zip(*np.nonzero(np.abs(a) > 0.02), strict=True)}
    assert {k for k, w in got.items() if abs(w) > 0.021} <= set(expected) and {k for k, w in expected.items() if abs(w) > 0.021} <= set(got)
    assert all(got[k] == pytest.approx(w, abs=1e-3) for k, w in expected.items() if k in got)


def test_rank_sum_tails():
    r = np.random.default_rng(0)
    for n1, n2 in ((1, 1), (2, 5), (3, 3), (5, 4)):
        ranks = range(1, n1 + n2 + 1)
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)]
        for u in set(us):
            far = max(u, n1 * n2 - u)
            assert T.rank_sum_tail(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(x >= far for x in us) / len(us)))
    assert 0 < T.rank_sum_tail(float(r.integers(0, 800)), 8, 100) <= 1


def test_small_strata_are_exact(spark):
    rows = [("g", "a", float(x)) for x in (1, 2, 3, 4)] + [("g", "b", float(x)) for x in (5, 6, 7)] + [("h", "a", 1.0), ("h", "b", 2.0)]
    out = screening.stratified_rank_sum(spark.createDataFrame(rows, "gene string, s string, v double"), ["gene"], "s", "v", "a", "b").collect()
    assert [(r["gene"], r["u"], r["p"]) for r in out] == [("g", 0.0, pytest.approx(2 / 35))]
    assert out[0]["log2fc"] == pytest.approx(math.log2((2.5 + 1e-6) / (6 + 1e-6)))


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(5).random((60, 2)) * 1000
    triangles = A.delaunay(np.vstack([p, p[:3]]))
    assert max(max(t) for t in triangles) < 60
    for t in triangles:
        a, b, c = p[list(t)]
        m = 2 * np.array([b - a, c - a])
        centre = np.linalg.solve(m, [(b * b - a * a).sum(), (c * c - a * a).sum()])
        assert (((p - centre) ** 2).sum(axis=1) >= ((a - centre) ** 2).sum() - 1e-6).all()
    assert A.delaunay(np.array([[0.0, 0], [1, 1], [2, 2]])) == [] and A.delaunay(np.zeros((2, 2))) == []
    assert len(A.delaunay(np.array([[0.0, 0], [1, 0], [0, 1], [1, 1]]))) == 2


def test_ward_merges_the_nearest():
    labels = A.ward(np.array([[0.0], [0.1], [5.0], [5.2], [20.0]]), np.ones(5), [3, 2])
    assert labels[3].tolist() == [0, 0, 1, 1, 2] and labels[2].tolist() == [0, 0, 0, 0, 1]


def test_hsic_of_independent_and_equal_columns(spark):
    r = np.random.default_rng(1)
    rows = [("s", i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(40, 2)))]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double")
    x, y = (np.array([row[k] for row in rows]) for k in (2, 3))

    def plain(x, y):
        k = []
        for v in (x, y):
            d = np.abs(v[:, None] - v[None, :])
            s = np.median(d[np.triu_indices(len(v), 1)])
            k.append(np.exp(-(d**2) / (2 * s * s + 1e-10)))
        h = np.eye(len(x)) - 1 / len(x)
        return np.trace(k[0] @ h @ k[1] @ h) / (len(x) - 1) ** 2

    for c, v in (("b", y), ("a", x)):
        assert niches.hsic(df, ["g"], ["a"], [c]).first()["hsic"] == pytest.approx(plain(x, v), rel=1e-9)
    assert niches.hsic(df.limit(2), ["g"], ["a"], ["b"]).first()["hsic"] == 0.0


def test_configurations_and_sentences(spark):
    bad = contracts.forbidden_issues({"a": {"seeds": ["X"], "path": "in/top_scores.csv"}, "b": ["ok.csv"], "seeds": []}, ["seeds"], ["top_"])
    assert bad == ["a.seeds: names given by hand", "a.path: a result file: in/top_scores.csv"]
    with pytest.raises(ValueError, match="positive"):
        discovery.sensitivity(None, None, 1, 0.1, 0)
