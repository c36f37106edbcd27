"""Queries over whole-animal splits, eligibility, observed effects, hierarchy triplets and nearest joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ._register import query
from .bindings import EXPR, POINTS, expr, points, table
from .evidence import DRAW
from .expression import rounded

#: Animals are regions, two of them for evaluation; a cell is an order, its perturbation the priority, its block a month.
ROLES = "SELECT r_regionkey AS animal, CASE WHEN r_regionkey < 2 THEN 'train' WHEN r_regionkey = 2 THEN 'tune' ELSE 'evaluation' END AS role FROM region"
CONTEXT = "SELECT o_orderkey AS cell_id, n_regionkey AS animal, o_orderpriority AS perturbation, CASE WHEN c_mktsegment < 'FURNITURE' THEN 'first' ELSE 'second' END AS cell_type, month(o_orderdate)::INT AS block, o_orderstatus = 'P' AS safe, o_custkey % 2 AS half FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey"
SEEN = f"SELECT animal, perturbation FROM ({CONTEXT}) WHERE NOT safe AND (animal <> 4 OR perturbation <> '1-URGENT') AND (perturbation <> '5-LOW' OR animal < 3) AND (perturbation <> '2-HIGH' OR animal >= 3)"


def roles(spark, d):
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(k.alias("animal"), F.when(k < 2, "train").when(k == 2, "tune").otherwise("evaluation").alias("role"))


def context(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") < "FURNITURE", "first").otherwise("second").alias("cell_type"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("animal"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), "o_custkey", F.col("o_orderpriority").alias("perturbation"), F.month("o_orderdate").alias("block"), (F.col("o_orderstatus") == "P").alias("safe"), (F.col("o_custkey") % 2).alias("half"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("cell_id", "animal", "perturbation", "cell_type", "block", "safe", "half")


def parts(spark, d):
    a, p = F.col("animal"), F.col("perturbation")
    seen = context(spark, d).filter(~F.col("safe") & ((a != 4) | (p != "1-URGENT")) & ((p != "5-LOW") | (a < 3)) & ((p != "2-HIGH") | (a >= 3)))
    return S.partition(seen.select("animal", "perturbation"), roles(spark, d))


PARTS = f"SELECT perturbation, CASE WHEN bool_or(role <> 'evaluation') AND bool_or(role = 'evaluation') THEN 'primary' WHEN bool_or(role = 'evaluation') THEN 'secondary' ELSE 'development_only' END AS part FROM ({SEEN}) JOIN ({ROLES}) USING (animal) GROUP BY perturbation"
TYPES = "SELECT unnest(['first', 'second']) AS cell_type"
UNITS = f"SELECT animal, perturbation, cell_type, unnest(['proximal', 'local']) AS band FROM ({ROLES}) CROSS JOIN (SELECT perturbation FROM ({PARTS}) WHERE part = 'primary') CROSS JOIN ({TYPES})"


@query("animal_partition", PARTS)
def animal_partition(spark, d):
    return parts(spark, d)


def units(spark, d):
    return S.primary_units(parts(spark, d), roles(spark, d), spark.createDataFrame([("first",), ("second",)], "cell_type string"), ["proximal", "local"])


@query("primary_units", UNITS)
def primary_units(spark, d):
    return units(spark, d)


#: Months follow one another; a group's blocks are its months.
SPREAD = f"WITH b AS (SELECT DISTINCT animal, perturbation, block FROM ({CONTEXT}) WHERE NOT safe AND cell_id % 41 < animal) SELECT x.animal, x.perturbation, bool_or(coalesce(y.block - x.block > 1 AND z.block - y.block > 1, false)) AS spread FROM b x LEFT JOIN b y ON y.animal = x.animal AND y.perturbation = x.perturbation LEFT JOIN b z ON z.animal = x.animal AND z.perturbation = x.perturbation GROUP BY ALL"


def months(spark):
    return spark.range(1, 12).select(F.col("id").cast("int").alias("a"), (F.col("id") + 1).cast("int").alias("b"))


@query("spread_blocks", SPREAD)
def spread_blocks(spark, d):
    b = context(spark, d).filter(~F.col("safe") & (F.col("cell_id") % 41 < F.col("animal")))
    return S.spread_blocks(b.select("animal", "perturbation", "block"), months(spark), ["animal", "perturbation"])


NEIGHBOURS = f"SELECT *, CASE half WHEN 0 THEN 'proximal' ELSE 'local' END AS band FROM ({CONTEXT}) WHERE cell_id % 7 <> 0"
SOURCES = f"SELECT * FROM ({CONTEXT}) WHERE cell_id % 7 = 0 AND (animal > 0 OR cell_id % 5 = 0)"
ELIGIBLE = f"""WITH u AS ({UNITS}), o AS (SELECT animal, perturbation, count(DISTINCT cell_id) FILTER (NOT safe) AS n0, count(DISTINCT cell_id) FILTER (safe) AS n1, count(DISTINCT block) FILTER (safe) AS k1 FROM ({SOURCES}) GROUP BY ALL), b AS (SELECT DISTINCT animal, perturbation, block FROM ({SOURCES}) WHERE NOT safe),
sp AS (SELECT DISTINCT x.animal, x.perturbation, true AS spread FROM b x JOIN b y ON y.animal = x.animal AND y.perturbation = x.perturbation AND y.block - x.block > 1 JOIN b z ON z.animal = x.animal AND z.perturbation = x.perturbation AND z.block - y.block > 1),
l AS (SELECT animal, perturbation, cell_type, band, count(DISTINCT cell_id) FILTER (NOT safe) AS m0, count(DISTINCT cell_id) FILTER (safe) AS m1, count(DISTINCT block) FILTER (NOT safe) AS b0, count(DISTINCT block) FILTER (safe) AS b1 FROM ({NEIGHBOURS}) GROUP BY ALL),
j AS (SELECT u.*, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1 FROM u LEFT JOIN l USING (animal, perturbation, cell_type, band)), g AS (SELECT animal, perturbation, band, sum(m0) AS t0, sum(m1) AS t1, NOT bool_or(m0 >= 30 AND m1 >= 30 AND b0 >= 3 AND b1 >= 3) AS none, bool_or(m0 < 30) AS low0, bool_or(m1 < 30) AS low1, bool_or(b0 < 3) AS few0, bool_or(b1 < 3) AS few1 FROM j GROUP BY ALL),
f AS (SELECT animal, perturbation, bool_or(t0 < 50 OR (none AND low0)) AS x0, bool_or(t1 < 50 OR (none AND low1)) AS x1, bool_or(none AND few0) AS y0, bool_or(none AND few1) AS y1 FROM g GROUP BY ALL),
c AS (SELECT f.animal, f.perturbation, array_to_string(list_filter([CASE WHEN coalesce(n0, 0) < 20 THEN 'insufficient_perturbation_coverage' END, CASE WHEN coalesce(n1, 0) < 20 THEN 'insufficient_safe_control_coverage' END, CASE WHEN x0 THEN 'insufficient_band_neighbours' END, CASE WHEN x1 THEN 'insufficient_safe_control_band_neighbours' END, CASE WHEN NOT coalesce(spread, false) OR y0 THEN 'insufficient_spatial_blocks' END, CASE WHEN coalesce(k1, 0) < 3 OR y1 THEN 'insufficient_safe_control_spatial_blocks' END], lambda v: v IS NOT NULL), ';') AS failures FROM f LEFT JOIN o USING (animal, perturbation) LEFT JOIN sp USING (animal, perturbation))"""


def eligible(spark, d):
    rows = context(spark, d)
    near = rows.filter("cell_id % 7 <> 0").withColumn("band", F.when(F.col("half") == 0, "proximal").otherwise("local"))
    return S.eligibility(units(spark, d), rows.filter("cell_id % 7 = 0 and (animal > 0 or cell_id % 5 = 0)"), near, months(spark))


@query("unit_eligibility", f"{ELIGIBLE} SELECT animal, perturbation, failures, failures = '' AS scoreable FROM c")
def unit_eligibility(spark, d):
    return eligible(spark, d)


@query("animal_coverage", f"{ELIGIBLE} SELECT animal, count(*) FILTER (failures = '')::BIGINT AS scoreable, count(*)::BIGINT AS total, count(*) FILTER (failures = '') >= 0.8 * count(*) AS covered FROM c GROUP BY animal")
def animal_coverage(spark, d):
    return S.animal_coverage(eligible(spark, d))


MEMBERS = "SELECT o_orderpriority || '/' || (o_custkey % 5) AS unit, o_orderkey AS cell_id, o_orderstatus = 'P' AS safe FROM orders WHERE o_orderstatus IN ('F', 'P')"
TARGETS = f"SELECT DISTINCT unit, 'Brand#' || (1 + length(unit) + ascii(unit[-1]) % 10) AS gene FROM ({MEMBERS})"


@query("observed_effects", f"WITH m AS ({MEMBERS}), t AS ({TARGETS}), v AS (SELECT unit, gene, safe, coalesce(value, 0) AS value FROM m JOIN t USING (unit) LEFT JOIN ({EXPR}) USING (cell_id, gene)), a AS (SELECT unit, gene, avg(value) FILTER (NOT safe) AS x, avg(value) FILTER (safe) AS y FROM v GROUP BY ALL) SELECT unit, gene, round(x, 6) AS treatment_mean, round(y, 6) AS control_mean, round(x - y, 6) + 0.0 AS effect FROM a WHERE x IS NOT NULL AND y IS NOT NULL")
def observed_effects(spark, d):
    m = table(spark, d, "orders").filter("o_orderstatus in ('F', 'P')").select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 5).cast("string")).alias("unit"), F.col("o_orderkey").alias("cell_id"), (F.col("o_orderstatus") == "P").alias("safe"))
    t = m.select("unit").distinct().select("unit", F.concat(F.lit("Brand#"), (1 + F.length("unit") + F.ascii(F.substring("unit", -1, 1)) % 10).cast("string")).alias("gene"))
    return rounded(S.observed_effects(m, expr(spark, d), t)).withColumn("effect", F.col("effect") + 0.0)


@query("hierarchy_triplets", f"""WITH p AS ({POINTS}), e AS (SELECT section, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p GROUP BY section), n AS (SELECT section, id, CASE WHEN hx > lx THEN (x - lx) / (hx - lx) ELSE 0 END AS x, CASE WHEN hy > ly THEN (y - ly) / (hy - ly) ELSE 0 END AS y FROM p JOIN e USING (section)),
c AS (SELECT section, id, least(1, floor(x * 2)) * 2 + least(1, floor(y * 2)) AS coarse, least(3, floor(x * 4)) * 4 + least(3, floor(y * 4)) AS fine, {DRAW.format("'tri', id::VARCHAR")} AS u, {DRAW.format("'tri', 'n', id::VARCHAR")} AS v FROM n),
r AS (SELECT *, coalesce(lead(id) OVER w, first_value(id) OVER w) AS positive, count(*) OVER (PARTITION BY section, fine) AS k, row_number() OVER (PARTITION BY section ORDER BY coarse, id) - 1 AS place FROM c WINDOW w AS (PARTITION BY section, fine ORDER BY u, id)),
z AS (SELECT section, coarse, count(*) AS m, min(place) AS s FROM r GROUP BY ALL), t AS (SELECT section, count(*) AS t FROM r GROUP BY section), d AS (SELECT r.section, id AS anchor, positive, u, CASE WHEN floor(v * (t - m)) < s THEN floor(v * (t - m)) ELSE floor(v * (t - m)) + m END AS place FROM r JOIN z USING (section, coarse) JOIN t USING (section) WHERE k > 1 AND t > m),
f AS (SELECT d.section, anchor, d.positive, r.id AS negative, row_number() OVER (PARTITION BY d.section ORDER BY d.u, anchor) AS o FROM d JOIN r ON r.section = d.section AND r.place = d.place) SELECT section, anchor, positive, negative FROM f WHERE o <= 40""")
def hierarchy_triplets(spark, d):
    return S.hierarchy_triplets(points(spark, d), "tri", 40)


@query("nearest_join", f"SELECT section, id, arg_min(nearest, (d2, nearest)) AS nearest, min(d2) AS d2 FROM (SELECT a.section, a.id, b.id AS nearest, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM ({POINTS}) a JOIN ({POINTS}) b ON a.section = b.section AND a.id % 3 <> 0 AND b.id % 3 = 0) GROUP BY ALL")
def nearest_join(spark, d):
    p = points(spark, d)
    return S.nearest_join(p.filter("id % 3 <> 0"), p.filter("id % 3 = 0"), "section", 120.0)
