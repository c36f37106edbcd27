"""Neighbours against brute force on uneven and odd points, and the work of the queries that use them on many points."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import graphs as A
from sparkloom.operators import niches as N
from sparkloom.operators import space as P
from sparkloom.plans.registry import QUERIES


def brute(rows, k):
    """Rows as SQL orders them: by distance, NaN after numbers, null last, then by id."""

    def order(d2, i):
        return (d2 is None, d2 is not None and math.isnan(d2), 0.0 if d2 is None or math.isnan(d2) else d2, i)

    out = []
    for s, i, x, y in rows:
        found = []
        for t, j, u, v in rows:
            if s is not None and t == s and i != j:
                found.append((None if None in (x, y, u, v) else (x - u) ** 2 + (y - v) ** 2, j))
        found.sort(key=lambda e: order(*e))
        out += [(s, i, j, repr(d2), rank + 1) for rank, (d2, j) in enumerate(found[:k])]
    return sorted(out)


def test_nearest_of_uneven_and_odd_points(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, i, float(i * 37 % 23), float(i * 17 % 19)) for i in range(60)]  # even
    rows += [(1, i, 5.0, 5.0) for i in range(30)] + [(1, 30 + i, 5.0 + i % 2, 5.0) for i in range(8)]  # copies
    rows += [(2, i, 1e-7 * (i * 37 % 101), 1e-7 * (i * 53 % 97)) for i in range(90)] + [(2, 90 + i, 1e6 * i, -1e6) for i in range(3)]  # a cluster, far points
    rows += [(3, 0, 1.0, 1.0), (3, 1, 2.0, 1.0), (3, 2, None, 1.0), (3, 3, nan, 1.0), (3, 4, inf, 7.0), (3, 5, -inf, 2.0), (3, 6, 4.0, None), (3, 7, inf, inf), (3, 8, nan, None)]
    rows += [(4, 0, 1.0, 1.0), (5, 0, None, 2.0), (5, 1, None, 3.0), (None, 1, 1.0, 1.0), (None, 2, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "section int, id int, x double, y double")
    for k in (1, 4, 11):
        assert sorted((r["section"], r["id"], r["neighbor"], repr(r["d2"]), r["rank"]) for r in P.knn(pts, k).collect()) == brute(rows, k)
    some = P.knn(pts, 4, asking=F.col("id") % 3 == 0).collect()
    assert sorted((r["section"], r["id"], r["neighbor"], repr(r["d2"]), r["rank"]) for r in some) == [r for r in brute(rows, 4) if r[1] % 3 == 0]


def joined_rows(spark, run):
    """The most rows that one join makes while run() runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    run()
    most = 0
    listed = store.executionsList(int(first), 1000)
    for e in (listed.apply(i) for i in range(listed.size())):
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if "Join" in n.name() else ():
                v = values.get(m.accumulatorId())
                if m.name() == "number of output rows" and v.isDefined():
                    most = max(most, int(v.get().split("\n")[-1].split(" ")[0].replace(",", "")))
    return most


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """4,000 customers of one nation."""
    path = str(tmp_path_factory.mktemp("crowded"))
    key = F.col("id")
    rows = spark.range(4000).select(key.alias("c_custkey"), F.lit(3).alias("c_nationkey"), ((key * 7919 % 10007) * 1.0).alias("c_acctbal"), F.concat(F.lit("S"), key % 5).alias("c_mktsegment"))
    rows.write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize("name", ["spatial_knn", "neighbor_bands", "morans_i", "decayed_adjacency", "knn_graph_summary", "local_composition", "spatial_contact", "disk_neighbors", "silhouettes"])
def test_work_follows_the_number_of_points(spark, crowded, name):
    made = joined_rows(spark, lambda: QUERIES[name](spark, crowded).collect())
    assert 0 < made < 300 * 4000  # all pairs are 16 million


def test_silhouettes_of_several_blocks(spark):
    r = np.random.default_rng(3)
    at = np.floor(r.random((2600, 2)) * 60)
    label = r.integers(0, 3, 2600)
    label[0] = 9  # alone in its label
    rows = [("g", i, f"l{k}", float(x), float(y)) for i, ((x, y), k) in enumerate(zip(at, label, strict=True))]
    rows += [("h", i, "one", float(i), 0.0) for i in range(5)] + [("g", 5000, None, 1.0, 1.0), ("g", 5001, "l0", None, 1.0), (None, 5002, "l0", 1.0, 1.0)]
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    s = []
    for i, k in enumerate(label):
        means = {m: d[i, label == m].sum() / ((label == m).sum() - (m == k)) for m in set(label) if m != k or (label == k).sum() > 1}
        b = min(v for m, v in means.items() if m != k)
        s.append((b - means[k]) / max(means[k], b) if k in means else 0.0)
    got = N.silhouette(spark.createDataFrame(rows, "section string, id int, l string, x double, y double"), ["section"], "l", ["x", "y"]).collect()
    assert [(g["section"], g["n"], round(g["silhouette"], 9)) for g in got] == [("g", 2600, round(float(np.mean(s)), 9))]


def test_delaunay_of_many_points(spark):
    """A circle through a triangle's corners holds no neighbouring triangle's far corner, and the triangles fill the hull."""
    q = np.random.default_rng(8).random((2500, 2)) * 1000
    for p in (q, np.floor(q / 25)):  # with points on circles, on lines and at one place
        triangles = A.delaunay(p)
        far = {}
        area = 0.0
        for t in triangles:
            u, v = p[t[1]] - p[t[0]], p[t[2]] - p[t[0]]
            area += abs(u[0] * v[1] - u[1] * v[0]) / 2
            for i in range(3):
                far.setdefault((t[i - 2], t[i - 1]) if t[i - 2] < t[i - 1] else (t[i - 1], t[i - 2]), []).append(t[i])
        for (a, b), ends in far.items():
            assert len(ends) <= 2
            if len(ends) == 2:
                e, f = (np.array([p[a] - p[c], p[b] - p[c]]) for c in ends)
                angle = [math.atan2(abs(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]), float(m[0] @ m[1])) for m in (e, f)]
                assert sum(angle) <= math.pi + 1e-9
        hull = [e for e, ends in far.items() if len(ends) == 1]
        mid = p.mean(axis=0)
        assert area == pytest.approx(sum(abs((p[a] - mid)[0] * (p[b] - mid)[1] - (p[a] - mid)[1] * (p[b] - mid)[0]) / 2 for a, b in hull))
        assert {i for t in triangles for i in t} == set(np.unique(p, axis=0, return_index=True)[1].tolist())


def test_disk_distances_are_rounded_as_in_sql(spark, monkeypatch):
    """SQL rounds the double 0.1301405 to 0.13014, as it is less than half."""
    from sparkloom.plans import niches

    one = spark.createDataFrame([(0, 1, 2, 0.1301405, 1)], "section int, id int, neighbor int, distance double, rank int")
    monkeypatch.setattr(niches, "disk", lambda *_: None)
    monkeypatch.setattr(niches.N, "disk_knn", lambda *_, **__: one)
    assert QUERIES["disk_neighbors"](spark, "").first()["distance"] == 0.13014
