"""Queries over scans and sinks: rows of the test tables are written in a format and read back by its scan."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources import writers as W
from ..sources.shared import shared_path
from ._register import query
from .bindings import FLOW, NODES, flow, nodes, table


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """One file of these bytes, on any file system that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(data))
    out.close()
    return path


def put_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def put_json(df: DataFrame, path: str, wrap=lambda rows: rows) -> str:
    """A JSON document of few rows."""
    return put(df.sparkSession, path, json.dumps(wrap([r.asDict(recursive=True) for r in df.collect()]), indent=1).encode())


@query("csv_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_scan(spark, d):
    """SRC1 and SRC9: a table with a header, and a tab-separated one, joined by key."""
    base = shared_path(spark, "csv")
    c = table(spark, d, "customer")
    put_csv(c.select("c_custkey", "c_name"), f"{base}/a.csv")
    put_csv(c.select("c_custkey", "c_acctbal"), f"{base}/b.tsv", "\t")
    return R.read_csv(spark, f"{base}/a.csv", "c_custkey bigint, c_name string").join(R.read_csv(spark, f"{base}/b.tsv", "c_custkey bigint, c_acctbal double", "\t"), "c_custkey")


@query("positions_scan", "SELECT c_custkey::VARCHAR AS barcode, (c_custkey % 2)::VARCHAR AS in_tissue, round(c_acctbal * 0.25, 6) AS scaled FROM customer WHERE c_custkey % 2 = 1")
def positions_scan(spark, d):
    """SRC2: positions and the scale factors beside them."""
    base = shared_path(spark, "positions")
    put_csv(table(spark, d, "customer").select(F.col("c_custkey").alias("barcode"), (F.col("c_custkey") % 2).alias("in_tissue"), F.col("c_acctbal").alias("x")), f"{base}/tissue_positions.csv")
    put(spark, f"{base}/scalefactors_json.json", json.dumps({"tissue_hires_scalef": 0.25}, indent=1).encode())
    positions, factors = R.read_positions(spark, base)
    return positions.filter("in_tissue = '1'").crossJoin(factors).select("barcode", "in_tissue", F.round(F.col("x").cast("double") * F.col("tissue_hires_scalef"), 6).alias("scaled"))


@query("geojson_scan", "SELECT n_name AS id, n_regionkey::VARCHAR AS region, ((n_nationkey + 1) * (n_regionkey + 2))::DOUBLE AS area FROM nation")
def geojson_scan(spark, d):
    """SRC3 and SCA6: a rectangle for each nation, and its area."""
    path = shared_path(spark, "cells.geojson")
    feature = lambda r: {"id": r["n_name"], "properties": {"region": str(r["n_regionkey"])}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [r["n_nationkey"] + 1, 0], [r["n_nationkey"] + 1, r["n_regionkey"] + 2], [0, r["n_regionkey"] + 2], [0, 0]]]}}
    put_json(table(spark, d, "nation"), path, lambda rows: {"type": "FeatureCollection", "features": [feature(r) for r in rows]})
    return R.read_geojson(spark, path).select("id", F.col("properties")["region"].alias("region"), R.ring_area(F.col("ring")).alias("area"))


@query("panel_scan", "SELECT n_nationkey::VARCHAR AS gene_id, n_name AS gene_name, CASE WHEN n_regionkey = 0 THEN 'unknown' ELSE 'gene' END AS descriptor, n_regionkey::INT AS n_codewords FROM nation")
def panel_scan(spark, d):
    """SRC4 and FIL16: the targets of a panel file."""
    path = shared_path(spark, "panel.json")
    target = lambda r: {"type": {"data": {"id": str(r["n_nationkey"]), "name": r["n_name"]}, **({"descriptor": "gene"} if r["n_regionkey"] else {})}, "codewords": list(range(r["n_regionkey"]))}
    put_json(table(spark, d, "nation"), path, lambda rows: {"payload": {"targets": [target(r) for r in rows]}})
    return R.read_panel(spark, path)


@query("manifest_scan", "SELECT r_name AS name, r_name || '.csv' AS path, count(*)::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def manifest_scan(spark, d):
    """SRC5 and SRC8: the sources that a manifest lists, and the rows of each."""
    base = shared_path(spark, "manifest")
    names = nodes(spark, d).select(F.col("node_type").alias("name"), F.col("name").alias("nation"))
    put_json(table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat("r_name", F.lit(".csv")).alias("path")), f"{base}/m.json", lambda rows: {"sources": rows})
    names.write.partitionBy("name").parquet(f"{base}/data")
    listed = R.read_manifest(spark, f"{base}/m.json", "sources", "name: string, path: string")
    return listed.join(spark.read.parquet(f"{base}/data"), "name").groupBy("name", "path").agg(F.count(F.lit(1)).alias("n"))


@query("bundle_scan", "SELECT 'entity' AS table_name, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'sample', count(*)::BIGINT FROM nation")
def bundle_scan(spark, d):
    """SRC6: the tables of a bundle that are there; two of the four are."""
    base = shared_path(spark, "bundle")
    put_csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), f"{base}/sample.csv")
    put_csv(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), f"{base}/entity.csv")
    found = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in R.read_bundle(spark, base).items()]
    return found[0].union(found[1])


@query("many_files", "SELECT p_type AS gene, p_size::VARCHAR AS lfc, substr(p_brand, 7) AS kind FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def many_files(spark, d):
    """SRC11: all files that match, each with what its name tells."""
    base = shared_path(spark, "many")
    for i in (1, 2, 3):
        rows = table(spark, d, "part").filter(F.col("p_brand") == f"Brand#{i}").select(F.col("p_type").alias("gene"), F.col("p_size").alias("lfc"))
        put(spark, f"{base}/deg_{i}.csv", rows.toPandas().to_csv(index=False).encode())
    return R.read_many(spark, f"{base}/deg_*.csv", r"deg_(\w+)\.csv", "kind")


@query("optional_files", "SELECT n_name AS gene, n_nationkey::VARCHAR AS effect, NULL::VARCHAR AS p, 'a.csv' AS source_file FROM nation UNION ALL SELECT r_name, NULL, r_regionkey::VARCHAR, 'b.csv' FROM region")
def optional_files(spark, d):
    """SRC12: the files that are there, their columns under the first of several names."""
    base = shared_path(spark, "optional")
    put_csv(table(spark, d, "nation").select(F.col("n_name").alias("gene"), F.col("n_nationkey").alias("lfc")), f"{base}/a.csv")
    put_csv(table(spark, d, "region").select(F.col("r_name").alias("symbol"), F.col("r_regionkey").alias("padj")), f"{base}/b.csv")
    return R.read_optional(spark, [f"{base}/{n}.csv" for n in ("none", "a", "b")], {"gene": ["gene", "symbol"], "effect": ["log2fc", "lfc"], "p": ["padj"]})


MATRIX = f"SELECT src::BIGINT AS row, dst::BIGINT AS \"column\", qty AS value FROM ({FLOW})"


@query("matrix_scan", f"SELECT * FROM ({MATRIX}) WHERE \"column\" % 3 = 0")
def matrix_scan(spark, d):
    """SRC13: a third of a matrix's columns; places count from 1 in the file."""
    path = shared_path(spark, "m.mtx")
    f = flow(spark, d).select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, F.col("qty")).alias("v"))
    lines = ["%%MatrixMarket matrix coordinate real general", "% of flows", f"25 25 {f.count()}", *(r["v"] for r in f.collect())]
    put(spark, path, ("\n".join(lines) + "\n").encode())
    return R.read_matrix_market(spark, path, spark.range(0, 25, 3).select(F.col("id").alias("column")))


@query("line_scan", "SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS index, c_name AS barcode FROM customer")
def line_scan(spark, d):
    """SRC14: the lines of a compressed list, with their numbers."""
    path = shared_path(spark, "lines")
    table(spark, d, "customer").coalesce(1).sortWithinPartitions("c_custkey").select("c_name").write.option("compression", "gzip").text(path)
    return R.read_lines(spark, path).withColumn("index", F.col("index").cast("bigint"))


@query("molecule_scan", "SELECT floor(l_quantity / 10)::BIGINT AS gx, floor(l_linenumber / 10.0)::BIGINT AS gy, p_brand AS geneID, sum(l_tax * 100)::DOUBLE AS count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#1', 'Brand#5') GROUP BY ALL")
def molecule_scan(spark, d):
    """SRC15: counts of wanted genes by grid cell of a long table."""
    path = shared_path(spark, "gem")
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("geneID"))
    put_csv(table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select("geneID", F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"), F.round(F.col("l_tax") * 100).alias("MIDCount")), path, "\t")
    out = R.read_chunk_scored(spark, path, ["Brand#1", "Brand#5"], step=10.0)
    return out.select(F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"), "geneID", "count")


@query("archive_scan", f"SELECT src::BIGINT AS cell, (SELECT n_name FROM nation WHERE n_nationkey = src) AS intervention, (SELECT n_name FROM nation WHERE n_nationkey = dst) AS gene, qty AS value FROM ({FLOW})")
def archive_scan(spark, d):
    """SRC17: an archive of a matrix, its rows' interventions and its columns' names."""
    path = shared_path(spark, "flows.npz")
    x = np.zeros((25, 25))
    for r in flow(spark, d).collect():
        x[r["src"], r["dst"]] = r["qty"]
    names = np.array([r["name"] for r in nodes(spark, d).orderBy("node").collect()])
    held = io.BytesIO()
    np.savez(held, expression=x, interventions=names, var_names=names)
    put(spark, path, held.getvalue())
    return R.read_npz(spark, path).drop("context")


@query("result_scan", "SELECT n_name AS gene, n_nationkey::DOUBLE AS dose, n_regionkey / 4.0::DOUBLE AS effect_size FROM nation")
def result_scan(spark, d):
    """SRC18: experiment rows, half from a .json and half from a .csv file."""
    base = shared_path(spark, "results")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("gene"), F.col("n_nationkey").cast("double").alias("dose"), (F.col("n_regionkey") / 4.0).alias("effect_size"))
    put_json(rows.filter("dose < 12"), f"{base}/e.json")
    put_csv(rows.filter("dose >= 12"), f"{base}/e.csv")
    return R.read_results(spark, f"{base}/e.json").select("gene", "dose", "effect_size").union(R.read_results(spark, f"{base}/e.csv").select("gene", "dose", "effect_size"))


@query("first_table", "SELECT n_name AS gene, n_regionkey::VARCHAR AS rank FROM nation")
def first_table(spark, d):
    """SRC20: the first of several tables that is there."""
    base = shared_path(spark, "first")
    put_csv(table(spark, d, "nation").select(F.col("n_name").alias("gene"), F.col("n_regionkey").alias("rank")), f"{base}/second.csv")
    put_csv(table(spark, d, "region"), f"{base}/third.csv")
    return R.read_first(spark, [f"{base}/{n}.csv" for n in ("none", "second", "third")])


@query("run_artifacts", "SELECT 'scores' AS section, 'flow' AS name, 'table' AS kind, (SELECT count(*) FROM (" + FLOW + "))::BIGINT AS n UNION ALL SELECT 'scores', 'summary.json', 'json', 25")
def run_artifacts(spark, d):
    """SNK1 and SNK2: a run's artifacts as its manifest lists them, with what is read back of each."""
    w = W.RunWriter(spark, shared_path(spark, "runs"), "r1")
    with w.stage("write"):
        held = w.table("scores", "flow", flow(spark, d))
        summary = w.json("scores", "summary.json", {"nodes": 25, "none": float("nan"), "far": [float("inf")]})
    listed = R.read_manifest(spark, w.finish(), "artifacts", "section: string, name: string, kind: string")
    n = spark.read.parquet(held).agg(F.count(F.lit(1)).alias("n")).select(F.lit("flow").alias("name"), "n")
    read = R.read_json_object(spark, summary, "nodes bigint, none double, far array<double>").filter("none is null and far[0] is null").select(F.lit("summary.json").alias("name"), F.col("nodes").alias("n"))
    return listed.join(n.union(read), "name").select("section", "name", "kind", "n")


@query("finite_values", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS v FROM customer")
def finite_values(spark, d):
    """SNK2: values that aren't finite are null in a table."""
    k = F.col("c_custkey") % 3
    return W.finite(table(spark, d, "customer").select("c_custkey", F.when(k == 0, F.col("c_acctbal")).when(k == 1, float("nan")).otherwise(float("-inf")).alias("v")))


@query("graph_files", f"SELECT n.node::VARCHAR AS src, m.node::VARCHAR AS dst, n.node_type AS src_type, f.qty AS weight FROM ({FLOW}) f JOIN ({NODES}) n ON n.node = src JOIN ({NODES}) m ON m.node = dst")
def graph_files(spark, d):
    """SNK3: a graph as GraphML, as an adjacency archive and as two tables, read back and joined."""
    base = shared_path(spark, "graph")
    v = nodes(spark, d).select(F.col("node").cast("string").alias("id"), "node_type")
    e = flow(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("qty").alias("weight"))
    W.write_graph(v, e, f"{base}/tables")
    W.write_graphml(v, e, f"{base}/g.graphml")
    W.write_adjacency(v, e, f"{base}/g.npz")
    types, edges = R.read_graphml(spark, f"{base}/g.graphml")
    dense = R.read_adjacency(spark, f"{base}/g.npz")
    kept = spark.read.parquet(f"{base}/tables/edges").select("src", "dst")
    out = edges.drop("weight").join(dense, ["src", "dst"]).join(kept, ["src", "dst"]).join(types.select(F.col("id").alias("src"), F.col("node_type").alias("src_type")), "src")
    return out.select("src", "dst", "src_type", "weight")


@query("published_table", f"SELECT src, dst, qty, true AS refused FROM ({FLOW})")
def published_table(spark, d):
    """SNK4: a published table, read with its digest; a second publication under its name is refused."""
    path = shared_path(spark, "published")
    rows = flow(spark, d).select("src", "dst", "qty")
    W.publish(rows, path)
    try:
        W.publish(rows.limit(1), path)
        refused = False
    except FileExistsError:
        refused = True
    return W.read_published(spark, path).withColumn("refused", F.lit(refused))


@query("compressed_table", "SELECT c_custkey, c_mktsegment FROM customer")
def compressed_table(spark, d):
    """SNK5."""
    path = shared_path(spark, "gz")
    W.write_csv_gz(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return R.read_csv(spark, path, "c_custkey bigint, c_mktsegment string")


@query("schema_issue_report", "SELECT * FROM (VALUES ('orders', 'o_clerk'), ('part', 'barcode'), ('part', 'sample_id')) AS v(table_name, missing) UNION ALL SELECT 'region', 'r_comment' FROM region WHERE r_regionkey = 0")
def schema_issue_report(spark, d):
    """FIL1 over four tables: a row for each column that is asked for and not there."""
    from ..operators import validate as V

    asked = {"orders": ["o_orderkey", "o_clerk"], "part": ["p_partkey", "barcode", "sample_id"], "region": ["r_name", "r_comment"], "nation": ["n_name"]}
    found = [(n, i.rpartition("column ")[2].strip("'")) for n, cols in asked.items() for i in V.required_columns(table(spark, d, n), cols, n)]
    return spark.createDataFrame(pd.DataFrame(found, columns=["table_name", "missing"]), "table_name string, missing string")
