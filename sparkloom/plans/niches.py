"""Queries over clusters, niches, dependence and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..operators import niches as N
from ..operators import space as P
from ._register import query
from .bindings import CAUSAL, CELLS, EXPR, NODE_EXPR, NODES, POINTS, causal, cells, expr, node_expr, nodes, points, table
from .evidence import DRAW
from .expression import rounded

D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2"


@query("dominant_types", "SELECT c_nationkey AS cluster, arg_min(c_mktsegment, (-n, c_mktsegment)) AS dominant, max(n)::BIGINT AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def dominant_types(spark, d):
    return N.dominant_types(table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), "c_mktsegment"), "cluster", "c_mktsegment")


@query("silhouettes", f"WITH m AS (SELECT a.section, a.id, a.cell_type AS l, b.cell_type AS k, avg(sqrt({D2})) AS m FROM ({POINTS}) a JOIN ({POINTS}) b ON a.section = b.section AND a.id <> b.id GROUP BY ALL), e AS (SELECT section, id, max(m) FILTER (l = k) AS a, min(m) FILTER (l <> k) AS b FROM m GROUP BY ALL) SELECT section, count(*)::BIGINT AS n, round(avg(CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM e WHERE b IS NOT NULL GROUP BY section")
def silhouettes(spark, d):
    return rounded(N.silhouette(points(spark, d), ["section"], "cell_type", ["x", "y"]))


@query("niche_scores", f"WITH v AS (SELECT gene, response AS niche, value FROM ({EXPR}) JOIN ({CELLS}) USING (cell_id)), m AS (SELECT gene, niche, avg(value) AS m FROM v GROUP BY ALL), b AS (SELECT gene, var_pop(m) AS b, count(*) AS k FROM m GROUP BY gene), w AS (SELECT gene, var_pop(value) AS v FROM v GROUP BY gene) SELECT gene, round(CASE WHEN k < 2 THEN 0 ELSE least(1, b / CASE WHEN v > 0 THEN v ELSE 1e-12 END) END, 8) AS score FROM b JOIN w USING (gene)")
def niche_scores(spark, d):
    rows = expr(spark, d).join(cells(spark, d), "cell_id").select("gene", F.col("response").alias("niche"), "value")
    return rounded(N.niche_score(rows, ["gene"], "niche", "value"), 8)


DISK = f"SELECT section, id, x / greatest(r, 1e-12) * t AS hx, y / greatest(r, 1e-12) * t AS hy FROM (SELECT section, id, x, y, r, least(0.995::DOUBLE, greatest(0.05::DOUBLE, tanh(r / s))) AS t FROM (SELECT section, id, x, y, sqrt(x * x + y * y) AS r FROM (SELECT section, id, x - 450 AS x, y - 500 AS y FROM ({POINTS}))), (SELECT greatest(quantile_cont(sqrt((x - 450) ** 2 + (y - 500) ** 2), 0.95), 1e-6) AS s FROM ({POINTS})))"


def disk(spark, d):
    p = points(spark, d).withColumns({"x": F.col("x") - 450, "y": F.col("y") - 500})
    return N.to_disk(p).select("section", "id", "hx", "hy")


@query("disk_neighbors", f"WITH d AS ({DISK}), e AS (SELECT section, a, b, row_number() OVER (PARTITION BY section, a ORDER BY g, b) AS rk FROM (SELECT a.section, a.id AS a, b.id AS b, (a.hx - b.hx) ** 2 + (a.hy - b.hy) ** 2 AS g FROM d a JOIN d b ON a.section = b.section AND a.id <> b.id)), c AS (SELECT section, a, b FROM e WHERE rk <= 23 UNION ALL SELECT section, id, id FROM d), h AS (SELECT c.section, c.a AS id, c.b AS neighbor, round(acosh(greatest(1 + 2 * ((p.hx - q.hx) ** 2 + (p.hy - q.hy) ** 2) / greatest((1 - (p.hx ** 2 + p.hy ** 2)) * (1 - (q.hx ** 2 + q.hy ** 2)), 1e-12), 1 + 1e-7)), 9) AS distance FROM c JOIN d p ON p.id = c.a AND p.section = c.section JOIN d q ON q.id = c.b AND q.section = c.section) SELECT section, id, neighbor, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY section, id ORDER BY distance, neighbor) AS rank FROM h) WHERE rank <= 6")
def disk_neighbors(spark, d):
    # as SQL rounds a double, of which each thousandth is halfway after its nine digits
    return N.disk_knn(disk(spark, d), 6).withColumn("distance", F.round(F.col("distance") * 1e6) / 1e6)


COLO = "SELECT o_orderpriority AS \"table\", o_custkey AS unit, l_returnflag || l_linestatus AS type, l_quantity AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query("colocation_network", f"""WITH s AS (SELECT "table" AS t, unit, type, sum(score) AS v FROM ({COLO}) GROUP BY ALL), n AS (SELECT t, count(DISTINCT unit)::DOUBLE AS n FROM s GROUP BY t), k AS (SELECT DISTINCT type FROM s), st AS (SELECT t, type, sum(v) AS s, sum(v * v) AS q FROM s GROUP BY ALL), x AS (SELECT a.t, a.type AS a, b.type AS b, sum(a.v * b.v) AS xy FROM s a JOIN s b ON a.t = b.t AND a.unit = b.unit AND a.type <> b.type GROUP BY ALL),
f AS (SELECT n.t, n, i.type AS a, j.type AS b, coalesce(xy, 0) AS xy, coalesce(p.s, 0) AS sa, coalesce(p.q, 0) AS qa, coalesce(q.s, 0) AS sb, coalesce(q.q, 0) AS qb FROM n CROSS JOIN k i JOIN k j ON i.type <> j.type LEFT JOIN x ON x.t = n.t AND x.a = i.type AND x.b = j.type LEFT JOIN st p ON p.t = n.t AND p.type = i.type LEFT JOIN st q ON q.t = n.t AND q.type = j.type),
w AS (SELECT a, b, avg(CASE WHEN qa - sa * sa / n > 1e-12 AND qb - sb * sb / n > 1e-12 THEN (xy - sa * sb / n) / sqrt((qa - sa * sa / n) * (qb - sb * sb / n)) ELSE 0 END) AS w FROM f GROUP BY ALL HAVING w > -0.2) SELECT a, b, round(w / max(w) OVER (), 6) AS weight FROM w""")
def colocation_network(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("table"), F.col("o_custkey").alias("unit"), "o_orderkey")
    items = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("type"), F.col("l_quantity").alias("score"))
    return rounded(N.colocation(o.join(items, F.col("l_orderkey") == F.col("o_orderkey")).select("table", "unit", "type", "score"), -0.2))


@query("dependence", f"""WITH p AS (SELECT a.section, a.id AS i, b.id AS j, (a.x - b.x) ** 2 AS dx, (a.y - b.y) ** 2 AS dy FROM ({POINTS}) a JOIN ({POINTS}) b ON a.section = b.section), s AS (SELECT section, coalesce(quantile_cont(sqrt(dx), 0.5) FILTER (i < j AND dx > 0), 1) AS sx, coalesce(quantile_cont(sqrt(dy), 0.5) FILTER (i < j AND dy > 0), 1) AS sy FROM p GROUP BY section),
k AS (SELECT section, i, exp(-dx / (2 * sx * sx + 1e-10)) AS k, exp(-dy / (2 * sy * sy + 1e-10)) AS l FROM p JOIN s USING (section)), r AS (SELECT section, i, sum(k * l) AS kl, sum(k) AS k, sum(l) AS l FROM k GROUP BY ALL), t AS (SELECT section, count(*)::BIGINT AS n, sum(kl) AS kl, sum(k * l) AS c, sum(k) AS k, sum(l) AS l FROM r GROUP BY section)
SELECT section, n, round(CASE WHEN n < 3 THEN 0 ELSE (kl - 2 * c / n + k * l / (n::DOUBLE * n)) / ((n - 1)::DOUBLE * (n - 1)) END, 7) AS hsic FROM t""")
def dependence(spark, d):
    return rounded(N.hsic(points(spark, d), ["section"], ["x"], ["y"]), 7)


@query("neighbor_predictivity", """WITH v AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS t, l_tax AS u FROM lineitem), m AS (SELECT count(*)::DOUBLE AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, var_pop(t) AS vt, covar_pop(a, t) AS ca, covar_pop(b, t) AS bt, var_pop(u) AS vu, covar_pop(a, u) AS au, covar_pop(b, u) AS bu FROM v),
g AS (SELECT n, n AS g, n * ab / sqrt(va * vb) AS h, n * ca / sqrt(va) AS c1, n * bt / sqrt(vb) AS c2, n * vt AS tt, n * au / sqrt(va) AS d1, n * bu / sqrt(vb) AS d2, n * vu AS uu FROM m), w AS (SELECT *, ((g + 1) * c1 - h * c2) / ((g + 1) ** 2 - h * h) AS w1, ((g + 1) * c2 - h * c1) / ((g + 1) ** 2 - h * h) AS w2, ((g + 1) * d1 - h * d2) / ((g + 1) ** 2 - h * h) AS x1, ((g + 1) * d2 - h * d1) / ((g + 1) ** 2 - h * h) AS x2 FROM g)
SELECT round(((1 - (tt - 2 * (w1 * c1 + w2 * c2) + g * (w1 * w1 + w2 * w2) + 2 * h * w1 * w2) / tt) + (1 - (uu - 2 * (x1 * d1 + x2 * d2) + g * (x1 * x1 + x2 * x2) + 2 * h * x1 * x2) / uu)) / 2, 7) AS r2 FROM w""")
def neighbor_predictivity(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", "l_tax")
    r2 = N.ridge_r2(rows, ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])
    return spark.createDataFrame([(r2,)], "r2 double").select(F.round("r2", 7).alias("r2"))


MOVED = f"SELECT id, section, x, y, x * 0.9 + 3 AS ex, y * 1.1 + (id % 13) AS ey FROM ({POINTS})"


def moved(spark, d):
    return points(spark, d).withColumns({"ex": F.col("x") * 0.9 + 3, "ey": F.col("y") * 1.1 + F.col("id") % 13})


@query("embedding_distortion", f"SELECT count(*)::BIGINT AS n_pairs, round(avg(abs(sqrt((a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2) / sqrt({D2}) - 1)), 7) AS distortion FROM ({MOVED}) a JOIN ({MOVED}) b ON a.section = b.section AND a.id < b.id WHERE sqrt({D2}) > 1e-10")
def embedding_distortion(spark, d):
    a, b = (moved(spark, d).select("section", F.col("id").alias(f"{n}_id"), *(F.col(c).alias(f"{n}_{c}") for c in ("x", "y", "ex", "ey"))) for n in "ab")
    gap = lambda x, y: F.sqrt(P.square_distance([F.col(f"a_{x}"), F.col(f"a_{y}")], [F.col(f"b_{x}"), F.col(f"b_{y}")]))
    pairs = a.join(b, "section").filter("a_id < b_id").select(gap("x", "y").alias("original"), gap("ex", "ey").alias("embedded"))
    return rounded(N.sampled_distortion(pairs), 7)


@query("triplet_accuracy", f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM ({MOVED})), n AS (SELECT count(*) AS n FROM p), t AS (SELECT r, {', '.join("floor(" + DRAW.format(f"'tri', '{c}', r::VARCHAR") + f" * n) AS {c}" for c in 'ijk')} FROM n, (SELECT unnest(range(4000)) AS r)),
q AS (SELECT (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS a, (a.x - c.x) ** 2 + (a.y - c.y) ** 2 AS b, (a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2 AS c, (a.ex - c.ex) ** 2 + (a.ey - c.ey) ** 2 AS d FROM t JOIN p a ON a.place = i JOIN p b ON b.place = j JOIN p c ON c.place = k WHERE i <> j AND i <> k AND j <> k)
SELECT count(*)::BIGINT AS n_triplets, round(avg(((a < b) = (c < d))::INT), 7) AS accuracy FROM q WHERE abs(sqrt(a) - sqrt(b)) >= 1e-10""")
def triplet_accuracy(spark, d):
    return rounded(N.triplet_accuracy(moved(spark, d), 4000, "tri", ["x", "y"], ["ex", "ey"]), 7)


#: Two columns' principal axis has a closed form: the angle atan2(2 c, a - b) / 2.
@query("principal_axis", f"WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM ({POINTS})), t AS (SELECT *, atan2(2 * c, a - b) / 2 AS w FROM m), u AS (SELECT mx, my, CASE WHEN abs(cos(w)) >= abs(sin(w)) THEN sign(cos(w)) ELSE sign(sin(w)) END * cos(w) AS p, CASE WHEN abs(cos(w)) >= abs(sin(w)) THEN sign(cos(w)) ELSE sign(sin(w)) END * sin(w) AS q FROM t) SELECT id, round((x - mx) * p + (y - my) * q, 5) + 0.0 AS coordinate FROM ({POINTS}), u")
def principal_axis(spark, d):
    v = points(spark, d).select("id", F.array("x", "y").alias("v"))
    return N.principal_axes(v, 1).select("id", (F.round(F.col("coords")[0], 5) + 0.0).alias("coordinate"))


GENERIC = "SELECT c_custkey AS id, c_nationkey AS section, c_acctbal AS x, ((c_custkey * 7919) % 10007)::DOUBLE + c_acctbal / 977 AS y FROM customer"


def generic(spark, d):
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(key.alias("id"), F.col("c_nationkey").alias("section"), balance.alias("x"), ((key * 7919) % 10007).cast("double").alias("_y"), balance).withColumn("y", F.col("_y") + F.col("c_acctbal") / 977).drop("_y", "c_acctbal")


# an edge is one of the triangulation if some circle through its ends holds no third point: the circles' centres lie on the
# ends' bisector, and a third point bounds the centre's place s on it from one side
@query("delaunay_edges", f"""WITH g AS ({GENERIC}), e AS (SELECT a.section, a.id AS a, b.id AS b, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, -(b.y - a.y) AS nx, b.x - a.x AS ny, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4 AS r FROM g a JOIN g b ON a.section = b.section AND a.id < b.id),
s AS (SELECT e.section, a, b, r, (c.x - mx) * nx + (c.y - my) * ny AS side, ((c.x - mx) ** 2 + (c.y - my) ** 2 - r) / (2 * ((c.x - mx) * nx + (c.y - my) * ny)) AS s FROM e JOIN g c ON c.section = e.section AND c.id <> a AND c.id <> b),
t AS (SELECT section, a, b, 2 * sqrt(r) AS d, max(s) FILTER (side < 0) AS lo, min(s) FILTER (side > 0) AS hi FROM s GROUP BY ALL)
SELECT section, a, b, round(d * ((lo IS NOT NULL)::INT + (hi IS NOT NULL)::INT), 5) AS weight FROM t WHERE coalesce(lo < hi, true)""")
def delaunay_edges(spark, d):
    return rounded(N.delaunay_edges(generic(spark, d)), 5)


HOPS = f"""WITH ca AS (SELECT src, dst, w FROM ({CAUSAL}) WHERE w > 0.045), xy AS (SELECT n_nationkey AS node, (n_nationkey * 37 % 101)::DOUBLE AS x, (n_nationkey * 53 % 89)::DOUBLE AS y FROM nation), e AS (SELECT src, dst, w, exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * 60.0 * 60.0)) AS c FROM ca JOIN xy a ON a.node = src JOIN xy b ON b.node = dst),
n AS (SELECT dst AS node, sum(c) AS n FROM e GROUP BY dst), h0 AS (SELECT 0 AS node, 0 AS hop, 1.0::DOUBLE AS effect), h1 AS (SELECT dst AS node, 1 AS hop, sum(effect * w * c) / greatest(any_value(n.n), 1e-12) AS effect FROM e JOIN h0 ON src = h0.node JOIN n ON n.node = dst WHERE dst NOT IN (SELECT node FROM h0) GROUP BY dst), s1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT dst AS node, 2 AS hop, sum(effect * w * c) / greatest(any_value(n.n), 1e-12) AS effect FROM e JOIN s1 ON src = s1.node JOIN n ON n.node = dst WHERE dst NOT IN (SELECT node FROM s1) GROUP BY dst) SELECT node, hop, round(effect, 9) AS effect FROM s1 UNION ALL SELECT node, hop, round(effect, 9) FROM h2"""


def _hops(spark, d, coords):
    start = spark.createDataFrame([(0, 1.0)], "node int, effect double")
    return rounded(N.decayed_propagation(causal(spark, d).filter("w > 0.045"), start, 2, coords, 60.0), 9)


@query("decayed_propagation", HOPS)
def decayed_propagation(spark, d):
    k = F.col("n_nationkey")
    return _hops(spark, d, table(spark, d, "nation").select(k.alias("node"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 89).cast("double").alias("y")))


@query("weighted_propagation", HOPS.replace("exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * 60.0 * 60.0))", "1.0::DOUBLE"))
def weighted_propagation(spark, d):
    """Without coordinates: the mean over all parents of effect times weight."""
    return _hops(spark, d, None)


@query("niche_hierarchy")
def niche_hierarchy(spark, d):
    """Four levels of niches over the nations' profiles of brands; k-means has no SQL form."""
    genes = [f"Brand#{i}" for i in range(1, 26)]
    wide = node_expr(spark, d).groupBy(F.col("node").alias("id")).pivot("gene", genes).agg(F.avg("value")).fillna(0.0)
    scan, labels = N.nested_niches(wide.select("id", F.array(*(F.col(f"`{g}`") for g in genes)).alias("v")), range(8, 13), tiny=1)
    return labels


NB = "SELECT l_returnflag AS g, l_quantity AS x, 25.0 + l_discount * 10 AS m, 2.0 + l_tax * 10 AS t, l_discount * 20 - 1 AS pi FROM lineitem"
LL = "lgamma(x + t) - lgamma(x + 1) - lgamma(t) + t * (ln(t + 1e-10) - ln(t + m + 1e-10)) + x * (ln(m + 1e-10) - ln(t + m + 1e-10))"
SOFT = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"


@query("count_losses", f"WITH v AS (SELECT g, CASE WHEN x < 5 THEN 0 ELSE x END AS x, m::DOUBLE AS m, t::DOUBLE AS t, pi::DOUBLE AS pi FROM ({NB})), z AS (SELECT g, {LL} AS nb, x, {SOFT.format('(-pi)')} AS sp, t * (ln(t + 1e-10) - ln(t + m + 1e-10)) - {SOFT.format('(-pi)')} AS zero FROM v), y AS (SELECT *, -zero + ln(exp(sp) - 1 + 1e-10) AS q FROM z) SELECT g, round(-avg(nb), 6) AS nb_loss, round(-avg(CASE WHEN x < 1e-8 THEN -{SOFT.format('(-q)')} ELSE nb - sp END), 6) AS zinb_loss FROM y GROUP BY g".replace(SOFT.format("(-q)"), SOFT.format("q")))
def count_losses(spark, d):
    from ..functions import likelihood as L

    x = F.when(F.col("l_quantity") < 5, 0.0).otherwise(F.col("l_quantity"))
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), x.alias("x"), (25.0 + F.col("l_discount") * 10).alias("m"), (2.0 + F.col("l_tax") * 10).alias("t"), (F.col("l_discount") * 20 - 1).alias("pi"))
    v = [F.col(c) for c in ("x", "m", "t", "pi")]
    return rows.groupBy("g").agg(F.round(-F.avg(L.nb_log_likelihood(*v[:3])), 6).alias("nb_loss"), F.round(-F.avg(L.zinb_log_likelihood(*v)), 6).alias("zinb_loss"))


LIST = "list_transform(list_zip({0}, {1}), lambda p: {2})"
SHIFTED = f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT id, v, list_dot_product(v, v) AS q, sqrt(1 + list_dot_product(v, v)) AS t FROM v),
g AS (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(list_transform(v, lambda y: y * acosh(t) / sqrt(q))) AS y FROM t), d AS (SELECT list(d ORDER BY i) AS d FROM (SELECT i, avg(y) FILTER (id % 3 = 0) - avg(y) FILTER (id % 3 <> 0) AS d FROM g GROUP BY i)),
m AS (SELECT id, v, t, list_transform(d, lambda y: -y) AS d, sqrt(list_dot_product(d, d)) AS n FROM t, d), c AS (SELECT *, list_dot_product(v, d) / (t + 1) AS c FROM m),
s AS (SELECT id, n, {LIST.format('v', 'd', 'cosh(n) * p[1] + sinh(n) / n * (p[2] + c * p[1])')} AS s FROM c)"""


@query("latent_arithmetic", f"{SHIFTED} SELECT id, round(sqrt(1 + list_dot_product(s, s)), 6) AS x0, round(s[1], 6) + 0.0 AS x1, round(s[len(s)], 6) + 0.0 AS x_last, round(n, 5) AS length FROM s")
def latent_arithmetic(spark, d):
    """MOD4: all vectors moved against the mean difference of every third one from the rest."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), H.lift(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    delta = N.perturbation_vector(e.withColumn("t", F.col("id") % 3 == 0), "t")
    out = N.moved_points(e, delta)
    y = F.col("moved")
    return out.select("id", F.round(y[0], 6).alias("x0"), (F.round(y[1], 6) + 0.0).alias("x1"), (F.round(F.element_at(y, -1), 6) + 0.0).alias("x_last"), F.round(H.distance(F.col("x"), y), 5).alias("length"))
