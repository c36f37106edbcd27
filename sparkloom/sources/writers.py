"""Sinks: run folders with a manifest, compressed tables, edge lists, and bundles that are checked when read."""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def plain(value):
    """SNK2: a value for JSON, NaN and infinities being null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def finite(df: DataFrame) -> DataFrame:
    """SNK2 for tables: NaN and infinities in columns of doubles become null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, k in df.dtypes if k in ("double", "float")}) if any(k in ("double", "float") for _, k in df.dtypes) else df


class RunWriter:
    """SNK1: what one run writes, under <root>/<run>/<section>/<name>; nothing is overwritten."""

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.run = spark, run or uuid.uuid4().hex
        self.base = f"{root.rstrip('/')}/{self._safe(self.run)}"
        self.entries: list[dict] = []
        self.stages: list[dict] = []

    @staticmethod
    def _safe(name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise ValueError(f"not a plain name: {name!r}")
        return name

    def path(self, section: str, name: str) -> str:
        return f"{self.base}/{self._safe(section)}/{self._safe(name)}"

    def table(self, section: str, name: str, df: DataFrame) -> str:
        path = self.path(section, name)
        df.write.mode("errorifexists").parquet(path)
        self.entries.append({"section": section, "name": name, "kind": "table"})
        return path

    def json(self, section: str, name: str, value) -> str:
        path = self.path(section, name)
        p, fs = _fs(self.spark, path)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(plain(value), sort_keys=True).encode()))
        out.close()
        self.entries.append({"section": section, "name": name, "kind": "json"})
        return path

    def stage(self, name: str):
        """A context whose time is noted, with its error if it ends in one."""
        writer = self

        class Stage:
            def __enter__(self):
                self.began = time.time()

            def __exit__(self, kind, error, _):
                writer.stages.append({"stage": name, "seconds": time.time() - self.began, "error": repr(error) if error else None})
                return False

        return Stage()

    def finish(self) -> str:
        return self.json("manifest", "manifest.json", {"run": self.run, "artifacts": list(self.entries), "stages": self.stages})


def write_csv_gz(df: DataFrame, path: str) -> None:
    """SNK5."""
    df.write.option("header", True).option("compression", "gzip").csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK3: a graph as two tables."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


#: A graph in one file is small; beyond this many nodes, write_graph() is the way.
MAX_NODES = 20_000


def _small(nodes: DataFrame, edges: DataFrame) -> tuple[list, list]:
    held = nodes.orderBy("id").limit(MAX_NODES + 1).collect()
    if len(held) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes; write the graph as tables")
    return held, edges.orderBy("src", "dst").collect()


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(data))
    out.close()


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK3: one GraphML file of a small directed graph; nodes: (id, ...), edges: (src, dst, ...). Nulls have no entry."""
    from xml.sax.saxutils import escape, quoteattr

    held, links = _small(nodes, edges)
    kind = {"string": "string", "double": "double", "bigint": "long", "int": "int", "boolean": "boolean"}
    own = {k: [(c, kind.get(t, "string")) for c, t in df.dtypes if c not in skip] for k, df, skip in (("node", nodes, {"id"}), ("edge", edges, {"src", "dst"}))}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f"<key id={quoteattr(f'{k}_{c}')} for={quoteattr(k)} attr.name={quoteattr(c)} attr.type={quoteattr(t)}/>" for k, cols in own.items() for c, t in cols]
    data = lambda k, r: "".join(f"<data key={quoteattr(f'{k}_{c}')}>{escape(str(r[c]))}</data>" for c, _ in own[k] if r[c] is not None)
    out += ['<graph edgedefault="directed">', *(f"<node id={quoteattr(str(r['id']))}>{data('node', r)}</node>" for r in held)]
    out += [*(f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}>{data('edge', r)}</edge>" for r in links), "</graph>", "</graphml>"]
    _put(nodes.sparkSession, path, "\n".join(out).encode())


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK3: an npz archive of a small graph's dense adjacency (weights, 0 without an edge) and its nodes' ids in order."""
    import io

    import numpy as np

    held, links = _small(nodes.select("id"), edges.select("src", "dst", "weight"))
    place = {r["id"]: i for i, r in enumerate(held)}
    matrix = np.zeros((len(held), len(held)))
    for r in links:
        matrix[place[r["src"]], place[r["dst"]]] = r["weight"]
    out = io.BytesIO()
    np.savez_compressed(out, adjacency=matrix, ids=np.array([str(r["id"]) for r in held]))
    _put(nodes.sparkSession, path, out.getvalue())


def digest(df: DataFrame) -> DataFrame:
    """SNK4: rows and an order-independent hash of them."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("hash"))


def publish(df: DataFrame, path: str) -> dict:
    """SNK4: writes to a folder beside the path, adds the digest, then renames; a path that exists is left alone."""
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(f"{staged}/data")
    found = digest(spark.read.parquet(f"{staged}/data")).first().asDict()
    p, _ = _fs(spark, f"{staged}/digest.json")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
    out.close()
    source, _ = _fs(spark, staged)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(path)
    return found


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """SNK4: a published table whose rows still have its digest, else ValueError."""
    df = spark.read.parquet(f"{path}/data")
    noted = json.loads(spark.read.option("wholetext", True).text(f"{path}/digest.json").first()[0])
    if digest(df).first().asDict() != noted:
        raise ValueError(f"the rows of {path} differ from its digest")
    return df
