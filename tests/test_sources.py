"""Scans and sinks over files that the tests write."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import readers as R
from sparkloom.sources import writers as S


def test_scans(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "tissue_positions.csv").write_text("barcode,in_tissue\na,1\nb,0\n")
    (tmp_path / "scalefactors_json.json").write_text(json.dumps({"spot": 1.5}, indent=1))
    positions, factors = R.read_positions(spark, p)
    assert positions.filter("in_tissue = 1").count() == 1 and factors.first()["spot"] == 1.5
    (tmp_path / "c.geojson").write_text(json.dumps({"features": [{"id": "x", "properties": {"k": "v"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 3], [0, 3]]]}}]}))
    assert R.read_geojson(spark, f"{p}/c.geojson").select(R.ring_area(F.col("ring"))).first()[0] == 6.0
    (tmp_path / "panel.json").write_text(json.dumps({"payload": {"targets": [{"type": {"data": {"id": "1", "name": "G"}, "descriptor": "gene"}, "codewords": [1, 2]}, {"type": {}}]}}))
    assert [tuple(r) for r in R.read_panel(spark, f"{p}/panel.json").collect()] == [("1", "G", "gene", 2), ("", "", "unknown", 0)]
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"name": "a", "path": "x"}, {"name": "b", "path": "y"}]}))
    assert R.read_manifest(spark, f"{p}/m.json", "sources", "name: string, path: string").count() == 2
    (tmp_path / "sample.csv").write_text("id\n1\n")
    assert set(R.read_bundle(spark, p)) == {"sample"}
    for n in "ab":
        (tmp_path / f"deg_{n}.csv").write_text(f"gene,lfc\n{n.upper()},1\n")
    assert {tuple(r) for r in R.read_many(spark, f"{p}/deg_*.csv", r"deg_(\w+)\.csv", "type").select("gene", "type").collect()} == {("A", "a"), ("B", "b")}
    out = R.read_optional(spark, [f"{p}/none.csv", f"{p}/deg_a.csv"], {"gene": ["gene"], "effect": ["log2fc", "lfc"], "p": ["padj"]})
    assert [tuple(r) for r in out.collect()] == [("A", "1", None, "deg_a.csv")]
    assert R.read_first(spark, [f"{p}/none.csv", f"{p}/deg_b.csv"]).first()["gene"] == "B" and R.read_first(spark, [f"{p}/none.csv"]) is None
    with pytest.raises(FileNotFoundError, match="none.csv"):
        R.read_csv(spark, f"{p}/none.csv")


def test_matrices_and_lines(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% x\n3 3 4\n1 1 5\n2 1 1\n3 2 2\n1 3 9\n")
    keep = spark.createDataFrame([(0,), (2,)], "column bigint")
    assert sorted(tuple(r) for r in R.read_matrix_market(spark, f"{tmp_path}/m.mtx", keep).collect()) == [(0, 0, 5.0), (0, 2, 9.0), (1, 0, 1.0)]
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("AA\nBB\n")
    assert sorted(tuple(r) for r in R.read_lines(spark, f"{tmp_path}/b.tsv.gz").collect()) == [(0, "AA"), (1, "BB")]
    (tmp_path / "gem.tsv").write_text("geneID\tx\ty\tMIDCount\nA\t1\t1\t2\nA\t5\t5\t3\nB\t1\t1\t9\n")
    assert [r["count"] for r in R.read_chunk_scored(spark, f"{tmp_path}/gem.tsv", ["A"]).collect()] == [5.0]
    np.savez(tmp_path / "d.npz", expression=np.array([[1.0, 0], [0, 2]]), interventions=np.array(["a", "b"]), var_names=np.array(["g", "h"]))
    assert sorted(tuple(r)[1:] for r in R.read_npz(spark, f"{tmp_path}/d.npz").collect()) == [(0, "a", "g", 1.0), (1, "b", "h", 2.0)]
    (tmp_path / "e.json").write_text(json.dumps([{"gene": "A", "dose": 1, "effect_size": 0.5}]))
    assert R.read_results(spark, f"{tmp_path}/e.json").first()["effect_size"] == 0.5
    (tmp_path / "f.csv").write_text("gene\nA\n")
    with pytest.raises(ValueError, match="dose"):
        R.read_results(spark, f"{tmp_path}/f.csv")


def test_sinks(spark, tmp_path):
    w = S.RunWriter(spark, f"file://{tmp_path}/runs", "r1")
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id int, x double")
    with w.stage("one"):
        w.table("a", "t", df)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        w.table("a", "t", df)
    with pytest.raises(ValueError, match="plain name"):
        w.table("..", "t", df)
    w.finish()
    manifest = json.loads((tmp_path / "runs/r1/manifest/manifest.json").read_text())
    assert manifest["artifacts"][0]["name"] == "t" and manifest["stages"][0]["error"] is None
    assert S.plain({"a": [float("inf"), 1.0]}) == {"a": [None, 1.0]} and S.finite(df).filter("x is null").count() == 1
    S.publish(df, f"file://{tmp_path}/p")
    assert S.read_published(spark, f"file://{tmp_path}/p").count() == 2
    with pytest.raises(FileExistsError):
        S.publish(df, f"file://{tmp_path}/p")
    (tmp_path / "p/.digest.json.crc").unlink()
    (tmp_path / "p/digest.json").write_text('{"n_rows": 1, "hash": "0"}')
    with pytest.raises(ValueError, match="differ"):
        S.read_published(spark, f"file://{tmp_path}/p")
    S.write_csv_gz(df, f"file://{tmp_path}/z")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/z").count() == 2


def test_streamed_effects_equal_the_batch(spark, small, tmp_path):
    from sparkloom.operators import dosing
    from sparkloom.streaming import roundtrip

    events = spark.read.parquet(f"{small}/events.parquet")
    view = lambda e: e.select("ts", F.col("event_type").alias("gene"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("double").alias("dose"), F.col("value").alias("effect_size"))
    (tmp_path / "in").mkdir()
    events.write.parquet(f"{tmp_path}/in/part")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = roundtrip.windowed_effects(view(stream)).writeStream.outputMode("complete").format("memory").queryName("effects").start()
    q.processAllAvailable()
    q.stop()
    got = {r["gene"]: r for r in roundtrip.effects_of(spark.table("effects")).collect()}
    for r in dosing.effect_summary(view(events)).collect():
        assert got[r["gene"]]["n_rows"] == r["n_rows"] and got[r["gene"]]["mean_effect"] == pytest.approx(r["mean_effect"]) and got[r["gene"]]["std_effect"] == pytest.approx(r["std_effect"])
