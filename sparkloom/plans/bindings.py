"""How the roles of measurement data are bound to the tables of the test data.

A cell is an order, its donor the customer, its type the market segment, its response the order status; a feature
is a part's brand and a value the quantity in the order's line items. Points are customers, graph nodes nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CELLS = "SELECT o_orderkey AS cell_id, o_custkey AS donor, c_mktsegment AS cell_type, o_orderstatus AS response, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, donor, cell_type, response, label)."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("cell_type"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("donor"), F.col("o_orderstatus").alias("response"), F.col("o_orderpriority").alias("label"))
    return o.join(c, F.col("donor") == F.col("c_custkey")).drop("c_custkey").select("cell_id", "donor", "cell_type", "response", "label")


RAW = "SELECT l_orderkey AS cell_id, p_brand AS gene, l_returnflag AS source, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey"


def raw_values(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, gene, source, value) of each line item."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), "l_partkey", F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("value"))
    return items.join(p, F.col("l_partkey") == F.col("p_partkey")).select("cell_id", "gene", "source", "value")


EXPR = f"SELECT cell_id, gene, sum(value) AS value FROM ({RAW}) GROUP BY ALL"


def expr(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, gene, value): a sparse matrix, one row for each value that isn't zero."""
    return raw_values(spark, d).groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))


POINTS = "SELECT c_custkey AS id, c_nationkey AS section, c_mktsegment AS cell_type, round(c_acctbal / 10.0, 0) AS x, (c_custkey % 1000)::DOUBLE AS y, c_acctbal AS value FROM customer"


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, section, cell_type, x, y, value): customers as points with whole-number coordinates, a section for each nation."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("section"), F.col("c_mktsegment").alias("cell_type"), F.round(F.col("c_acctbal") / 10.0, 0).alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"), F.col("c_acctbal").alias("value"))


NODES = "SELECT n_nationkey AS node, n_name AS name, r_name AS node_type FROM nation JOIN region ON n_regionkey = r_regionkey"
FLOW = """SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*)::BIGINT AS n, sum(l_quantity) AS qty FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey JOIN supplier s ON l_suppkey = s.s_suppkey GROUP BY ALL"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node, name, node_type): nations with their region as type."""
    r = F.broadcast(table(spark, d, "region"))  # five rows by definition
    return table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), F.col("r_name").alias("node_type"))


def nation_lines(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, l_quantity, gene key, ship date) for each line item: the customer's and the supplier's nation."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    return items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", "l_partkey", "l_quantity", "l_shipdate")


def traffic(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, gene, n, qty), written: line items by the nations of customer and supplier and the part's brand.

    The graph and the nodes' values are sums over it, so a query that uses several of them joins the line items once.
    """
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    rows = nation_lines(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return written(rows.groupBy("src", "dst", "gene").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")), "traffic")


def flow(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """(src, dst, n, qty): a directed graph of nations."""
    if base is not None:
        return base.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))
    return nation_lines(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


CAUSAL = f"SELECT src, dst, w FROM (SELECT src, dst, n / (sum(n) OVER (PARTITION BY src))::DOUBLE AS w FROM ({FLOW}) WHERE src <> dst) WHERE w > 0.043"


def causal(spark: SparkSession, d: str, floor: float = 0.043, base: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): edges whose share of what leaves src is above the floor."""
    from pyspark.sql import Window

    shares = flow(spark, d, base).filter("src <> dst").withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    return shares.filter(F.col("w") > floor).select("src", "dst", "w")


NODE_EXPR = "SELECT c_nationkey AS node, p_brand AS gene, avg(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def node_expr(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """(node, gene, value): mean quantity of a brand in the orders of a nation's customers."""
    if base is not None:
        return base.groupBy(F.col("src").alias("node"), "gene").agg((F.sum("qty") / F.sum("n")).alias("value"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    return nation_lines(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("src").alias("node"), "gene").agg(F.avg("l_quantity").alias("value"))


#: A neutral table of signal chains over brands, between region types.
CHAINS = [
    ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "ASIA", "EUROPE", "path_a"),
    ("Brand#1", "Brand#5", "Brand#6", "Brand#7", "ASIA", "EUROPE", "path_a"),
    ("Brand#8", "Brand#9", "Brand#10", "Brand#11", "EUROPE", "AMERICA", "path_b"),
    ("Brand#12", "Brand#13", "Brand#14", "Brand#15", "AMERICA", "AFRICA", "path_c"),
    ("Brand#16", "Brand#17", "Brand#18", "Brand#19", "AFRICA", "ASIA", "path_d"),
    ("Brand#20", "Brand#21", "Brand#22", "Brand#23", "MIDDLE EAST", "ASIA", "path_e"),
    ("Brand#24", "Brand#25", "Brand#99", "Brand#1", "ASIA", "ASIA", "path_f"),
]
CHAIN_COLUMNS = ("ligand", "receptor", "tf", "target", "source_type", "target_type", "pathway")
CHAINS_SQL = "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in CHAINS) + ") AS lr(" + ", ".join(CHAIN_COLUMNS) + ")"


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAINS, ", ".join(f"{c} string" for c in CHAIN_COLUMNS))
