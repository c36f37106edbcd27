"""Scans of the files that measurement projects come in; paths may be of any file system that Spark reads."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def need_path(spark: SparkSession, path: str, label: str) -> str:
    """FIL3: the path, or FileNotFoundError that names what is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{label} not found: {path}")
    return path


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """SRC1 and SRC9: a table with a header line; without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema is not None else reader).csv(need_path(spark, path, "table"))


def read_json_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC2, SRC4: one object that spans lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(need_path(spark, path, "object"))


def read_positions(spark: SparkSession, folder: str, positions: str = "tissue_positions.csv", factors: str = "scalefactors_json.json") -> tuple[DataFrame, DataFrame]:
    """SRC2: the positions' table and the one-row table of scale factors beside it."""
    return read_csv(spark, f"{folder}/{positions}"), read_json_object(spark, f"{folder}/{factors}")


GEOMETRY = "features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a row (id, properties, ring) for each polygon feature; ring is the outer one."""
    features = read_json_object(spark, path, GEOMETRY).select(F.explode("features").alias("f"))
    return features.select("f.id", "f.properties", F.col("f.geometry.coordinates")[0].alias("ring"))


def ring_area(ring) -> F.Column:
    """SCA6: a ring's area by the shoelace formula; the last point joins the first."""
    n = F.size(ring)
    index = F.sequence(F.lit(0), n - 1)
    cross = F.transform(index, lambda i: F.get(ring, i)[0] * F.get(ring, (i + 1) % n)[1] - F.get(ring, (i + 1) % n)[0] * F.get(ring, i)[1])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(0.0)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """SRC4 and FIL16: the targets of a panel file as (gene_id, gene_name, descriptor, n_codewords)."""
    schema = "payload struct<targets: array<struct<type: struct<data: struct<id: string, name: string>, descriptor: string>, codewords: array<int>>>>"
    rows = read_json_object(spark, path, schema).select(F.explode("payload.targets").alias("t"))
    return rows.select(F.coalesce("t.type.data.id", F.lit("")).alias("gene_id"), F.coalesce("t.type.data.name", F.lit("")).alias("gene_name"), F.coalesce("t.type.descriptor", F.lit("unknown")).alias("descriptor"), F.coalesce(F.size("t.codewords"), F.lit(0)).alias("n_codewords"))


def read_manifest(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """SRC5 and SRC8: the rows of a manifest's list; schema is that of one row."""
    return read_json_object(spark, path, f"{field} array<struct<{schema}>>").select(F.inline(field))


def read_bundle(spark: SparkSession, folder: str, names: Sequence[str] = ("sample", "entity", "feature", "measure")) -> dict[str, DataFrame]:
    """SRC6: the tables of a bundle that are there."""
    return {n: read_csv(spark, f"{folder}/{n}.csv") for n in names if exists(spark, f"{folder}/{n}.csv")}


def read_many(spark: SparkSession, glob: str, pattern: str, column: str, sep: str = ",") -> DataFrame:
    """SRC11: all files that match, with what the pattern's group finds in the file's name as a column."""
    rows = spark.read.option("header", True).option("sep", sep).csv(glob)
    return rows.withColumn(column, F.regexp_extract("_metadata.file_name", pattern, 1))


def read_first(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """SRC20: the first of these tables that is there, None without any."""
    return next((read_csv(spark, p) for p in paths if exists(spark, p)), None)


def read_optional(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """SRC12: the files that are there, by name, each column under the first of its aliases, with source_file."""
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "source_file"]]))
    for path in paths:
        if exists(spark, path):
            rows = read_csv(spark, path)
            found = {c: next((a for a in names if a in rows.columns), None) for c, names in columns.items()}
            out = out.unionByName(rows.select(*((F.col(a).cast("string") if a else F.lit(None).cast("string")).alias(c) for c, a in found.items()), F.lit(path.rsplit("/", 1)[-1]).alias("source_file")))
    return out


def read_lines(spark: SparkSession, path: str, value: str = "barcode") -> DataFrame:
    """SRC14: the lines of a text file, compressed or not, with their number from 0.

    A compressed file is one task's work; numbers of an uncompressed one come from its parts' line counts.
    """
    rows = spark.read.text(need_path(spark, path, "lines")).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    joined = rows.withColumn("_p", part).join(F.broadcast(starts), "_p")  # a row for each file part
    return joined.select((F.col("_s") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("index"), F.col("value").alias(value))


def read_matrix_market(spark: SparkSession, path: str, columns: DataFrame | None = None) -> DataFrame:
    """SRC13: (row, column, value), counted from 0, of a coordinate file; only the given columns (column) if any.

    The size line is the first that isn't a comment; it is told from entries by its place.
    """
    lines = spark.read.text(need_path(spark, path, "matrix")).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    size = lines.agg(F.min("_id").alias("_first"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.crossJoin(F.broadcast(size)).filter(F.col("_id") != F.col("_first"))
    rows = rows.select((parts[0].cast("bigint") - 1).alias("row"), (parts[1].cast("bigint") - 1).alias("column"), parts[2].cast("double").alias("value"))
    return rows if columns is None else rows.join(columns.select("column").distinct(), "column", "left_semi").select("row", "column", "value")


def read_chunk_scored(spark: SparkSession, path: str, genes: Sequence[str], x: str = "x", y: str = "y", gene: str = "geneID", count: str = "MIDCount", step: float = 100.0) -> DataFrame:
    """SRC15: counts of the wanted genes by grid cell of a long table of molecules; the filter is pushed to the scan."""
    rows = read_csv(spark, path, sep="\t").filter(F.col(gene).isin(*genes))
    cell = [F.floor(F.col(c).cast("double") / step).alias(f"g{c}") for c in (x, y)]
    return rows.groupBy(*cell, gene).agg(F.sum(F.col(count).cast("double")).alias("count"))


def read_npz(spark: SparkSession, paths: str | Sequence[str], max_elements: int = 200_000_000) -> DataFrame:
    """SRC17: (context, cell, intervention, gene, value) of archives with expression, interventions and var_names.

    The arrays' sizes are checked from their headers before any is read; zeros are left out.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = "context string, cell bigint, intervention string, gene string, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if missing := {"expression", "interventions", "var_names"} - set(z.files):
                        raise ValueError(f"{path}: arrays are missing: {sorted(missing)}")
                    x, labels, genes = z["expression"], z["interventions"].astype(str), z["var_names"].astype(str)
                if x.ndim != 2 or x.shape != (len(labels), len(genes)) or x.size > max_elements:
                    raise ValueError(f"{path}: the arrays' shapes don't fit or are too large: {x.shape}")
                for a in range(0, len(x), 1024):
                    i, j = np.nonzero(x[a : a + 1024])
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(i), pa.string()), pa.array(i + a, pa.int64()), pa.array(labels[i + a].tolist(), pa.string()), pa.array(genes[j].tolist(), pa.string()), pa.array(x[a : a + 1024][i, j].astype(float))], names=["context", "cell", "intervention", "gene", "value"])

    return files.mapInArrow(run, schema)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: experiment rows of a .json or a .csv file; the columns gene, dose and effect_size must be there."""
    need_path(spark, path, "experiment file")
    rows = spark.read.option("multiLine", True).json(path) if path.lower().endswith(".json") else read_csv(spark, path)
    if missing := [c for c in ("gene", "dose", "effect_size") if c not in rows.columns]:
        raise ValueError(f"invalid experiment table: missing {missing}")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("dose", "effect_size")})


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """SRC19: these columns of a Parquet table; no others are read."""
    return spark.read.parquet(path).select(*columns)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SNK3: (nodes, edges) of a GraphML file: id or src and dst, and a column of text for each of its keys; a small graph."""
    import xml.etree.ElementTree as Tree

    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
        raise ValueError(f"{path}: documents with entities aren't read")
    root = Tree.fromstring(content)
    space = root.tag.removesuffix("graphml")
    keys = {k.get("id"): (k.get("for"), k.get("attr.name")) for k in root.iter(f"{space}key")}
    out = []
    for kind, ends in (("node", {"id": "id"}), ("edge", {"src": "source", "dst": "target"})):
        names = [n for f, n in keys.values() if f == kind]
        rows = []
        for x in root.iter(f"{space}{kind}"):
            held = {keys[v.get("key")][1]: v.text for v in x.iter(f"{space}data")}
            rows.append((*(x.get(a) for a in ends.values()), *(held.get(n) for n in names)))
        out.append(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in [*ends, *names])))
    return out[0], out[1]


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """SNK3: (src, dst, weight) of an archive with adjacency and ids, zeros left out."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        matrix, ids = z["adjacency"], z["ids"].astype(str)
    i, j = np.nonzero(matrix)
    return spark.createDataFrame([(str(ids[a]), str(ids[b]), float(matrix[a, b])) for a, b in zip(i, j, strict=True)], "src string, dst string, weight double")
