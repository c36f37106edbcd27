"""Queries over points, neighbours and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..operators import space as P
from ..sources.shared import written
from ._register import query
from .bindings import EXPR, POINTS, expr, points, table
from .expression import rounded

KNN = f"SELECT section, id, neighbor, d2, rank FROM (SELECT a.section, a.id, b.id AS neighbor, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS rank FROM ({POINTS}) a JOIN ({POINTS}) b ON a.section = b.section AND a.id <> b.id) WHERE rank <= {{}}"


def neighbors(spark, d, k, asking=None):
    return P.knn(points(spark, d), k, asking=asking)


def graph(spark, d):
    return P.knn_graph(P.lists(points(spark, d), 6, own=True))


@query("spatial_knn", KNN.format(6))
def spatial_knn(spark, d):
    return neighbors(spark, d, 6)


GRAPH = f"SELECT section, least(id, neighbor) AS a, greatest(id, neighbor) AS b, sqrt(max(d2)) AS distance FROM ({KNN.format(6)}) GROUP BY ALL"


@query("knn_graph_summary", f"SELECT section, n_nodes, count(a)::BIGINT AS n_edges, round(2 * count(a) / n_nodes::DOUBLE, 6) AS mean_degree, (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT section AS s, a AS v FROM ({GRAPH}) UNION ALL SELECT section, b FROM ({GRAPH})) WHERE s = g.section GROUP BY v))::BIGINT AS max_degree FROM ({GRAPH}) g JOIN (SELECT c_nationkey AS section, count(*)::BIGINT AS n_nodes FROM customer GROUP BY ALL) USING (section) GROUP BY section, n_nodes")
def knn_graph_summary(spark, d):
    n = points(spark, d).groupBy("section").agg(F.count(F.lit(1)).alias("n_nodes"))
    return rounded(P.graph_summary(graph(spark, d), n))


@query("decayed_adjacency", f"WITH g AS ({GRAPH}), m AS (SELECT section, quantile_cont(distance, 0.5) AS m FROM g GROUP BY section), w AS (SELECT section, exp(-distance / m) AS w FROM g JOIN m USING (section)) SELECT section, count(*)::BIGINT AS n, round(sum(w / x), 4) AS total FROM w JOIN (SELECT section, max(w) AS x FROM w GROUP BY section) USING (section) GROUP BY section")
def decayed_adjacency(spark, d):
    """Edges of equal distance have equal weights, so they are one row with their number."""
    g = written(graph(spark, d).groupBy("section", "distance").agg(F.count(F.lit(1)).alias("n")), "distances")
    return P.decayed(g, F.col("n")).groupBy("section").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("weight") * F.col("n")), 4).alias("total"))


@query("spatial_contact", f"WITH c AS (SELECT a.c_mktsegment AS source, b.c_mktsegment AS target, count(*)::BIGINT AS n FROM ({KNN.format(6)}) k JOIN customer a ON k.id = a.c_custkey JOIN customer b ON k.neighbor = b.c_custkey GROUP BY a.c_mktsegment, b.c_mktsegment) SELECT source, target, n, round(n / (sum(n) OVER (PARTITION BY source))::DOUBLE, 6) AS fraction FROM c")
def spatial_contact(spark, d):
    return rounded(P.contact_matrix(P.lists(points(spark, d), 6, carry=["cell_type"])))


@query("morans_i", f"WITH k AS ({KNN.format(6)}), p AS ({POINTS}), z AS (SELECT id, section, value - avg(value) OVER (PARTITION BY section) AS z, count(*) OVER (PARTITION BY section) AS n FROM p), zz AS (SELECT section, n::BIGINT AS n, sum(z * z) AS zz FROM z GROUP BY ALL), g AS (SELECT id, count(*) AS deg FROM k GROUP BY id), c AS (SELECT k.section, sum(a.z * b.z / deg) AS c, sum(1.0 / deg) AS s0 FROM k JOIN g USING (id) JOIN z a ON a.id = k.id JOIN z b ON b.id = k.neighbor GROUP BY ALL) SELECT section, n, round(n * c / (s0 * zz), 6) AS morans_i FROM zz JOIN c USING (section)")
def morans_i(spark, d):
    return rounded(P.morans_i(points(spark, d), 6))


@query("local_composition", f"WITH w AS (SELECT k.id, c_mktsegment AS label, sum(exp(-d2 / (2 * 100.0 * 100.0))) AS w FROM ({KNN.format(6)}) k JOIN customer ON c_custkey = neighbor WHERE d2 < 40000 GROUP BY ALL) SELECT id, label, round(w / sum(w) OVER (PARTITION BY id), 5) AS share FROM w")
def local_composition(spark, d):
    return rounded(P.local_composition(P.lists(points(spark, d), 6, carry=["cell_type"]), F.lit(100.0), within=F.lit(40000)), 5)


@query("neighbor_bands", f"""WITH k AS ({KNN.format(40)}), c AS (SELECT c_custkey AS id, c_custkey % 10 = 0 AS positive, c_custkey % 3 AS perturbation FROM customer),
r AS (SELECT k.*, s.perturbation FROM k JOIN c s ON s.id = k.id AND s.positive JOIN c t ON t.id = k.neighbor AND NOT t.positive),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, perturbation, neighbor ORDER BY rank, id) AS rn FROM r) WHERE rn = 1),
m AS (SELECT section, neighbor FROM b GROUP BY ALL HAVING count(DISTINCT perturbation) > 1 AND min(rank) <= 15)
SELECT section, perturbation, id AS source, neighbor, rank, CASE WHEN rank <= 5 THEN 'proximal' WHEN rank <= 15 THEN 'local' WHEN rank <= 30 THEN 'transition' ELSE 'distal' END AS band FROM b WHERE (section, neighbor) NOT IN (SELECT (section, neighbor) FROM m)""")
def neighbor_bands(spark, d):
    c = points(spark, d).select("section", "id", (F.col("id") % 10 == 0).alias("positive"), (F.col("id") % 3).alias("perturbation"))
    return P.perturbation_neighbors(c, neighbors(spark, d, 40, F.col("id") % 10 == 0))


@query("correlation_network", f"WITH e AS ({EXPR}), n AS (SELECT count(DISTINCT cell_id)::DOUBLE AS n FROM e), s AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM e GROUP BY gene), x AS (SELECT a.gene AS a, b.gene AS b, sum(a.value * b.value) AS xy FROM e a JOIN e b USING (cell_id) WHERE a.gene < b.gene GROUP BY ALL), r AS (SELECT x.a, x.b, (xy - sa.s * sb.s / n) / sqrt((sa.q - sa.s ** 2 / n) * (sb.q - sb.s ** 2 / n)) AS r FROM x JOIN s sa ON sa.gene = x.a JOIN s sb ON sb.gene = x.b, n) SELECT a, b, round(r, 6) AS r FROM r WHERE r > -0.035")
def correlation_network(spark, d):
    return rounded(P.correlation_edges(expr(spark, d), "cell_id", "gene", "value", -0.035))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


VEC = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings"
VKNN = f"SELECT id, neighbor, rank FROM (SELECT a.id, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY {{}}, b.id) AS rank FROM ({VEC}) a JOIN ({VEC}) b ON a.id <> b.id) WHERE rank <= 10"


BY_D2 = "round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2)), 6)"
BY_DOT = "round(-list_dot_product(a.v, b.v), 6)"


@query("embedding_knn", VKNN.format(BY_D2))
def embedding_knn(spark, d):
    """Every vector against all others."""
    return P.vector_knn(vectors(spark, d), 10)


@query("knn_preservation", f"WITH a AS ({VKNN.format(BY_D2)}), b AS ({VKNN.format(BY_DOT)}) SELECT a.id, round(count(b.id) / (20 - count(b.id))::DOUBLE, 6) AS jaccard FROM a LEFT JOIN b ON a.id = b.id AND a.neighbor = b.neighbor GROUP BY a.id")
def knn_preservation(spark, d):
    return rounded(P.knn_preservation(P.vector_knn(vectors(spark, d), 10), P.vector_knn(vectors(spark, d), 10, "product"), 10))


DIM = 64
MEANS = f"SELECT label, [{', '.join(f'avg(v[{i + 1}])' for i in range(DIM))}] AS m FROM ({VEC}) GROUP BY label"
TRANSFER = f"WITH p AS ({MEANS}), s AS (SELECT id, t.label AS truth, p.label, list_cosine_similarity(t.v, p.m) AS s FROM ({VEC}) t, p) SELECT id, truth, arg_max(label, (round(s, 9), -label)) AS predicted, exp(max(s)) / sum(exp(s)) AS confidence FROM s GROUP BY id, truth"


@query("label_transfer", f"SELECT id, predicted, round(confidence, 6) AS confidence FROM ({TRANSFER})")
def label_transfer(spark, d):
    protos = P.prototypes(vectors(spark, d), "label")
    return rounded(P.label_transfer(vectors(spark, d).select("id", "v"), protos))


@query("prediction_qc", f"WITH t AS ({TRANSFER}), l AS (SELECT truth AS l FROM t UNION SELECT predicted FROM t), f AS (SELECT l, 2.0 * count(*) FILTER (truth = l AND predicted = l) / (count(*) FILTER (truth = l) + count(*) FILTER (predicted = l)) AS f FROM t, l GROUP BY l) SELECT round((SELECT avg((truth = predicted)::INT) FROM t), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f")
def prediction_qc(spark, d):
    protos = P.prototypes(vectors(spark, d), "label")
    out = P.label_transfer(vectors(spark, d).select("id", "v"), protos).join(vectors(spark, d).select("id", "label"), "id")
    return rounded(P.accuracy_f1(out, "label", "predicted"))


@query("clustering_agreement", """WITH r AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b FROM customer), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM r GROUP BY ALL), ra AS (SELECT a, sum(n) AS x FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS x FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(x * (x - 1) / 2) FROM ra) AS pa, (SELECT sum(x * (x - 1) / 2) FROM rb) AS pb, t, (SELECT -sum(x / t * ln(x / t)) FROM ra, t) AS ha, (SELECT -sum(x / t * ln(x / t)) FROM rb, t) AS hb, (SELECT sum(n / t * ln(n * t / (ra.x * rb.x))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi FROM t)
SELECT round((ij - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM s""")
def clustering_agreement(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"))
    return rounded(P.clustering_agreement(rows, "a", "b"))


@query("within_between_separation", f"WITH p AS (SELECT sqrt({BY_D2}) AS distance, a.label = b.label AS same FROM ({VEC}) a JOIN ({VEC}) b ON a.id <> b.id), s AS (SELECT avg(distance) FILTER (same) AS within, avg(distance) FILTER (NOT same) AS between FROM p) SELECT round(within, 5) AS within, round(between, 5) AS between, round(between / within, 5) AS separation FROM s")
def within_between_separation(spark, d):
    return rounded(P.label_separation(vectors(spark, d)), 5)


CENTRES = f"SELECT label, [{', '.join(f'avg(v[{i + 1}])' for i in range(DIM))}] AS m FROM ({VEC}) GROUP BY label"


@query("hyperbolic_distance", f"WITH a AS (SELECT id, v, list_dot_product(v, v) AS q FROM ({VEC})), c AS (SELECT label, m, list_dot_product(m, m) AS q FROM ({CENTRES})), l AS (SELECT id, label, sqrt(1 + a.q) AS t, sqrt(1 + c.q) AS u, a.q AS q, c.q AS r, list_dot_product(v, m) AS p FROM a, c) SELECT id, label, round(acosh(greatest(t * u - p, 1 + 1e-7)), 6) AS lorentz, round(acosh(greatest(1 + 2 * (q / (t + 1) ** 2 + r / (u + 1) ** 2 - 2 * p / ((t + 1) * (u + 1))) / greatest((1 - q / (t + 1) ** 2) * (1 - r / (u + 1) ** 2), 1e-7), 1 + 1e-7)), 6) AS poincare, round(sqrt(greatest(t * t - q, 0)), 6) AS on_sheet FROM l")
def hyperbolic_distance(spark, d):
    """Every vector's distances from each label's mean vector in both models, over all components."""
    v = vectors(spark, d)
    parts = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"))
    pairs = v.select("id", H.lift(F.col("v")).alias("x")).crossJoin(means.select("label", H.lift(F.col("m")).alias("y")))  # labels are few
    x, y = F.col("x"), F.col("y")
    return rounded(pairs.select("id", "label", H.distance(x, y).alias("lorentz"), H.ball_distance(H.to_ball(x), H.to_ball(y)).alias("poincare"), F.sqrt(F.greatest(-H.inner(x, x), F.lit(0.0))).alias("on_sheet")))
