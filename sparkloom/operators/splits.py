"""Splits of animals and space, what makes their units eligible, and the effects observed in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evidence import draw
from .space import square_distance

#: Least numbers of source cells, of neighbours of a cell type and of a band, and of blocks; least coverage.
SOURCES, TYPE_NEIGHBOURS, BAND_NEIGHBOURS, BLOCKS, COVERAGE = 20, 30, 50, 3, 0.8


def partition(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """EVD6: each perturbation's place in a whole-animal split: primary, secondary or development_only.

    rows: (animal, perturbation) of source cells; roles: (animal, role), role being train, tune or evaluation. Primary is
    seen in development (train and tune) and evaluation, secondary in evaluation alone.
    """
    seen = rows.select("animal", "perturbation").distinct().join(roles, "animal")
    has = seen.groupBy("perturbation").agg(F.bool_or(F.col("role") != "evaluation").alias("_d"), F.bool_or(F.col("role") == "evaluation").alias("_e"))
    return has.select("perturbation", F.when(F.col("_d") & F.col("_e"), "primary").when(F.col("_e"), "secondary").otherwise("development_only").alias("part"))


def primary_units(parts: DataFrame, roles: DataFrame, cell_types: DataFrame, bands: Sequence[str]) -> DataFrame:
    """EVD6: (animal, perturbation, cell_type, band) for all animals, primary perturbations, cell types and bands."""
    base = roles.select("animal").crossJoin(parts.filter("part = 'primary'").select("perturbation")).crossJoin(cell_types.select("cell_type"))
    return base.withColumn("band", F.explode(F.array(*(F.lit(b) for b in bands))))


def spread_blocks(blocks: DataFrame, adjacent: DataFrame, by: Sequence[str]) -> DataFrame:
    """EVD6: whether each group (by) has three blocks of which no two are adjacent.

    blocks: (by, block); adjacent: (a, b). Pairs of a group's blocks that aren't adjacent are joined with each other.
    """
    b = blocks.select(*by, "block").distinct()
    both = adjacent.select("a", "b").union(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = b.withColumnRenamed("block", "a").join(b.withColumnRenamed("block", "b"), list(by)).filter("a < b").join(both, ["a", "b"], "left_anti")
    on = [*by, "a"]
    triples = pairs.join(pairs.withColumnRenamed("b", "c"), on).filter("b < c")
    triples = triples.join(pairs.select(*by, F.col("a").alias("b"), F.col("b").alias("c")), [*by, "b", "c"], "left_semi")
    found = triples.select(*by).distinct().withColumn("_ok", F.lit(True))
    return b.select(*by).distinct().join(found, list(by), "left").withColumn("spread", F.coalesce("_ok", F.lit(False))).drop("_ok")


def eligibility(units: DataFrame, sources: DataFrame, neighbours: DataFrame, adjacent: DataFrame) -> DataFrame:
    """EVD6: (animal, perturbation, failures, scoreable), failures being codes joined by semicolons, in their order.

    units: from primary_units. sources: (animal, perturbation, cell_id, block, safe); neighbours: the same with cell_type and
    band. safe marks matched controls. Parents need SOURCES cells on both sides, three blocks apart from each other and
    three safe blocks; each band BAND_NEIGHBOURS distinct cells on both sides, and one cell type with TYPE_NEIGHBOURS
    cells and BLOCKS blocks on both sides.
    """
    parent = ["animal", "perturbation"]
    side = lambda f, c, safe: f(F.when(F.col("safe") if safe else ~F.col("safe"), F.col(c)))
    own = sources.groupBy(*parent).agg(*(side(F.count_distinct, c, safe).alias(f"{n}{int(safe)}") for n, c in (("n", "cell_id"), ("k", "block")) for safe in (False, True)))
    apart = spread_blocks(sources.filter("not safe"), adjacent, parent)
    parents = units.select(*parent).distinct().join(own, parent, "left").join(apart, parent, "left").fillna(0).fillna(False, ["spread"])
    unit = [*parent, "cell_type", "band"]
    local = neighbours.groupBy(*unit).agg(*(side(F.count_distinct, c, safe).alias(f"{n}{int(safe)}") for n, c in (("m", "cell_id"), ("b", "block")) for safe in (False, True)))
    local = units.join(local, unit, "left").fillna(0)
    good = (F.col("m0") >= TYPE_NEIGHBOURS) & (F.col("m1") >= TYPE_NEIGHBOURS) & (F.col("b0") >= BLOCKS) & (F.col("b1") >= BLOCKS)
    by_band = local.groupBy(*parent, "band").agg(F.sum("m0").alias("t0"), F.sum("m1").alias("t1"), F.bool_or(good).alias("any"), F.bool_or(F.col("b0") < BLOCKS).alias("few0"), F.bool_or(F.col("b1") < BLOCKS).alias("few1"), F.bool_or(F.col("m0") < TYPE_NEIGHBOURS).alias("low0"), F.bool_or(F.col("m1") < TYPE_NEIGHBOURS).alias("low1"))
    none = ~F.col("any")
    flags = by_band.groupBy(*parent).agg(F.bool_or((F.col("t0") < BAND_NEIGHBOURS) | (none & F.col("low0"))).alias("band0"), F.bool_or((F.col("t1") < BAND_NEIGHBOURS) | (none & F.col("low1"))).alias("band1"), F.bool_or(none & F.col("few0")).alias("blocks0"), F.bool_or(none & F.col("few1")).alias("blocks1"))
    out = parents.join(flags, parent)
    codes = [
        (F.col("n0") < SOURCES, "insufficient_perturbation_coverage"),
        (F.col("n1") < SOURCES, "insufficient_safe_control_coverage"),
        (F.col("band0"), "insufficient_band_neighbours"),
        (F.col("band1"), "insufficient_safe_control_band_neighbours"),
        (~F.col("spread") | F.col("blocks0"), "insufficient_spatial_blocks"),
        ((F.col("k1") < BLOCKS) | F.col("blocks1"), "insufficient_safe_control_spatial_blocks"),
    ]
    failures = F.array_join(F.array_compact(F.array(*(F.when(c, n) for c, n in codes))), ";")
    return out.select(*parent, failures.alias("failures")).withColumn("scoreable", F.col("failures") == "")


def animal_coverage(eligible: DataFrame) -> DataFrame:
    """EVD6: (animal, scoreable, total, covered): the share of scoreable perturbations of each animal against COVERAGE."""
    out = eligible.groupBy("animal").agg(F.count_if("scoreable").alias("scoreable"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("covered", F.col("scoreable") >= COVERAGE * F.col("total"))


def observed_effects(members: DataFrame, values: DataFrame, targets: DataFrame) -> DataFrame:
    """EVD7: (unit, gene, treatment_mean, control_mean, effect) of each unit's target gene.

    members: (unit, cell_id, safe), a unit's treated cells and matched controls; values: (cell_id, gene, value), zeros left
    out; targets: (unit, gene). A unit without cells on a side has no row.
    """
    rows = members.join(targets, "unit").join(values, ["cell_id", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    out = rows.groupBy("unit", "gene").agg(F.avg(F.when(~F.col("safe"), F.col("value"))).alias("treatment_mean"), F.avg(F.when(F.col("safe"), F.col("value"))).alias("control_mean"))
    return out.filter("treatment_mean is not null and control_mean is not null").withColumn("effect", F.col("treatment_mean") - F.col("control_mean"))


def hierarchy_triplets(points: DataFrame, seed: str, most: int = 4096) -> DataFrame:
    """EVD4: (section, anchor, positive, negative) from nested blocks: the positive shares the anchor's block of a 4 x 4 grid
    over the section, the negative lies in another block of the 2 x 2 grid; the first `most` anchors of a section by hash.

    points: (section, id, x, y). The positive is the next point of the block in hash order, the first after the last; the
    negative is drawn among all points of other blocks, numbered by block and id. Anchors that lack either are left out.
    """
    ends = points.groupBy("section").agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    rows = points.select("section", "id", "x", "y").join(ends, "section")
    cell = lambda c, k: F.least(F.lit(k - 1), F.floor(F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}"))).otherwise(0.0) * k)).cast("int")
    rows = rows.select("section", "id", (cell("x", 2) * 2 + cell("y", 2)).alias("coarse"), (cell("x", 4) * 4 + cell("y", 4)).alias("fine"), draw(F.lit(seed), F.col("id")).alias("u"), draw(F.lit(seed), F.lit("n"), F.col("id")).alias("v"))
    ring = Window.partitionBy("section", "fine").orderBy("u", "id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"positive": F.coalesce(F.lead("id").over(ring), F.first("id").over(whole)), "_n": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("coarse", "id")) - 1)
    sizes = rows.groupBy("section", "coarse").agg(F.count(F.lit(1)).alias("_m"), F.min("place").alias("_start"))
    totals = rows.groupBy("section").agg(F.count(F.lit(1)).alias("_all"))
    drawn = rows.join(sizes, ["section", "coarse"]).join(totals, "section").filter("_n > 1 and _all > _m")
    j = F.floor(F.col("v") * (F.col("_all") - F.col("_m")))
    drawn = drawn.select("section", F.col("id").alias("anchor"), "positive", "u", F.when(j < F.col("_start"), j).otherwise(j + F.col("_m")).cast("int").alias("place"))
    out = drawn.join(rows.select("section", "place", F.col("id").alias("negative")), ["section", "place"])
    order = F.row_number().over(Window.partitionBy("section").orderBy("u", "anchor"))
    return out.withColumn("_o", order).filter(F.col("_o") <= most).select("section", "anchor", "positive", "negative")


def nearest_join(left: DataFrame, right: DataFrame, by: str, width: float, xy: Sequence[str] = ("x", "y")) -> DataFrame:
    """JOI13: (by, id, nearest, d2), each left point's nearest right point of the same sample, the smaller id of equals.

    left, right: (by, id, coordinates). The grid cells around a point come first; points whose find there is farther than
    the width, or that find none, meet all right points of their sample. A sample without right points has no rows.
    """
    dims = range(len(xy))
    a = left.select(by, "id", *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(xy)))
    b = right.select(by, F.col("id").alias("nearest"), *(F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(xy)))
    d2 = square_distance([F.col(f"_{i}") for i in dims], [F.col(f"_n{i}") for i in dims])
    best = lambda pairs: pairs.groupBy(by, "id").agg(F.min(F.struct(d2.alias("d2"), "nearest")).alias("_b")).select(by, "id", "_b.nearest", "_b.d2")
    around = a.withColumns({f"_c{i}": F.floor(F.col(f"_{i}") / width) for i in dims})
    for i in dims:
        around = around.withColumn(f"_c{i}", F.explode(F.array(F.col(f"_c{i}") - 1, F.col(f"_c{i}"), F.col(f"_c{i}") + 1)))
    near = best(around.join(b.withColumns({f"_c{i}": F.floor(F.col(f"_n{i}") / width) for i in dims}), [by, *(f"_c{i}" for i in dims)])).filter(F.col("d2") <= width * width)
    rest = a.join(near.select(by, "id"), [by, "id"], "left_anti")
    return near.unionByName(best(rest.join(b, by)))
