"""Queries that have no SQL form: small-graph algorithms, resampled searches, clusterings; and scans that do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import graphs as A
from ._register import query
from .bindings import CAUSAL, causal, expr, nation_lines, node_expr, nodes, table


def _paths_sql(levels: int = 8) -> str:
    """Numbers of shortest paths p(s, t, k, n) of the graph e, k edges long, level by level."""
    parts = ["l0 AS (SELECT v AS s, v AS t, 0 AS k, 1::DOUBLE AS n FROM (SELECT src AS v FROM e UNION SELECT dst FROM e))", "r0 AS (SELECT s, t, k, n FROM l0)"]
    for i in range(1, levels + 1):
        parts.append(f"l{i} AS (SELECT s, dst AS t, {i} AS k, sum(n) AS n FROM l{i - 1} JOIN e ON src = t WHERE (s, dst) NOT IN (SELECT (s, t) FROM r{i - 1}) GROUP BY s, dst)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} UNION ALL SELECT * FROM l{i})")
    return ", ".join([*parts, f"p AS (SELECT * FROM r{levels})"])


@query("betweenness", f"WITH e AS (SELECT src, dst FROM ({CAUSAL})), {_paths_sql()}, n AS (SELECT count(DISTINCT s)::DOUBLE AS n FROM p), b AS (SELECT a.t AS node, sum(a.n * c.n / w.n) AS b FROM p w JOIN p a ON a.s = w.s JOIN p c ON c.s = a.t AND c.t = w.t WHERE w.k = a.k + c.k AND a.t <> w.s AND a.t <> w.t GROUP BY a.t) SELECT DISTINCT p.s AS node, round(coalesce(b, 0) / ((n.n - 1) * (n.n - 2)), 9) AS betweenness FROM p LEFT JOIN b ON b.node = p.s, n")
def betweenness(spark, d):
    """GRA8 over the nations' graph: one group, of 25 nodes."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows.src, *rows.dst})
        found = A.betweenness(sorted(zip(rows.src, rows.dst, strict=True)), names)
        return pd.DataFrame({"node": names, "betweenness": [round(found[n], 9) for n in names]})

    return causal(spark, d).select("src", "dst", F.lit(1).alias("g")).groupBy("g").applyInPandas(run, "node int, betweenness double")


@query("acyclic_graph")
def acyclic_graph(spark, d):
    """GRA8: the nations' graph without the weakest edges of its cycles."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(A.without_cycles([(int(a), int(b), float(w)) for a, b, w in zip(rows.src, rows.dst, rows.w, strict=True)]), columns=["src", "dst", "w"])

    return causal(spark, d).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "src int, dst int, w double")


@query("topology_filtered_graph")
def topology_filtered_graph(spark, d):
    """GRA3: each year's flow between nations, filtered by its singular values."""
    lines = nation_lines(spark, d).groupBy(F.year("l_shipdate").alias("year"), "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((25, 25))
        x[rows.src, rows.dst] = rows.n
        out = A.topology_filter((x + x.T) / 2, 0.01, 10, 1.0)
        i, j = np.nonzero(out)
        return pd.DataFrame({"year": int(key[0]), "src": i, "dst": j, "w": out[i, j], "gap": A.spectral_gap(out)})

    return lines.groupBy("year").applyInPandas(run, "year int, src int, dst int, w double, gap double")


@query("pc_bootstrap_edges")
def pc_bootstrap_edges(spark, d):
    """STA12: nations' regions as variables, brands as observations."""
    types = node_expr(spark, d).join(nodes(spark, d), "node").groupBy("gene").pivot("node_type", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.avg("value"))
    rows = types.select(F.col("gene").alias("row"), F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in types.columns[1:])).alias("values"))
    return A.bootstrap_edges(rows, 20, alpha=0.2, most=3)


@query("prototype_matching")
def prototype_matching(spark, d):
    """GRA17: labels' mean vectors of even and odd ids, matched one to one by correlation."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("half"), "label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("half", "label", "i").agg(F.avg("x").alias("x"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = [rows[rows.half == h].pivot(index="label", columns="i", values="x").sort_index() for h in (0, 1)]
        r = np.corrcoef(wide[0].to_numpy(), wide[1].to_numpy())[: len(wide[0]), len(wide[0]) :]
        pairs = A.assignment(1 - r)
        return pd.DataFrame([(int(wide[0].index[a]), int(wide[1].index[b]), float(r[a, b])) for a, b in pairs], columns=["label_a", "label_b", "correlation"])

    return means.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "label_a int, label_b int, correlation double")


@query("niche_kmeans")
def niche_kmeans(spark, d):
    """GRA16: vectors by MLlib's k-means, rows of each cluster and label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    model = KMeans(k=6, seed=7, maxIter=10).fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("niche"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("sparse_sem")
def sparse_sem(spark, d):
    """MOD3: weights between all brands, each status a context with a fit of its own; donors are a fit's rows."""
    from .bindings import cells

    genes = [f"Brand#{i}" for i in range(1, 26)]
    means = expr(spark, d).join(cells(spark, d), "cell_id").groupBy("response", "donor", "gene").agg(F.avg("value").alias("v"))
    return A.sem_by_context(means, genes, "response", "donor", "gene", "v", floor=0.02)


@query("graph_statistics", f"WITH c AS ({CAUSAL}) SELECT count(*)::BIGINT AS n_edges, round(1 - count(*) / (25 * 24)::DOUBLE, 6) AS sparsity, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(stddev_pop(w), 6) AS sd, round(min(w), 6) AS least, round(max(w), 6) AS most FROM c")
def graph_statistics(spark, d):
    """AGG18."""
    w = causal(spark, d)
    return w.agg(F.count(F.lit(1)).alias("n_edges"), F.round(1 - F.count(F.lit(1)) / F.lit(25 * 24), 6).alias("sparsity"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.percentile("w", 0.5), 6).alias("median"), F.round(F.stddev_pop("w"), 6).alias("sd"), F.round(F.min("w"), 6).alias("least"), F.round(F.max("w"), 6).alias("most"))


@query("pruned_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
def pruned_scan(spark, d):
    """SRC19: two columns and a pushed filter."""
    from ..sources.readers import read_columns

    return read_columns(spark, f"{d}/customer.parquet", ["c_custkey", "c_acctbal"]).filter("c_acctbal > 9000")
