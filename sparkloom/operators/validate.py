"""Checks and clean-up of tables: required columns, keys, nulls, types, labels, quality filters."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def required_columns(df: DataFrame, required: Sequence[str], table: str) -> list[str]:
    """FIL1: one issue for each missing column."""
    return [f"{table}: missing column '{c}'" for c in required if c not in df.columns]


def require(df: DataFrame, required: Sequence[str], table: str) -> DataFrame:
    """Raises where FIL1 finds issues."""
    if issues := required_columns(df, required, table):
        raise ValueError("; ".join(issues))
    return df


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """FIL2: rows, distinct keys and surplus rows; a null key is a key."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FIL3: a row for each column with its nulls and NaNs."""
    def missing(c: str) -> Column:
        bad = F.col(c).isNull()
        return bad | F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else bad

    wide = df.agg(*(F.count_if(missing(c)).alias(c) for c in columns))
    return wide.unpivot([], list(columns), "column_name", "n_missing")


def first_nonempty(*values: Column, na: Sequence[str] = ("", "nan", "none", "na", "null")) -> Column:
    """FIL8: the first value that isn't null, blank or a name for missing."""
    kept = [F.when(~F.lower(F.trim(v)).isin(*na), F.trim(v)) for v in values]
    return F.coalesce(*kept)


def label_by_rules(label: Column, rules: Sequence[tuple[Sequence[str], str]], default: str = "Unknown") -> Column:
    """FIL9: the name of the first rule one of whose texts the lowered label holds."""
    text, out = F.lower(F.coalesce(label, F.lit(""))), F.lit(default)
    for tokens, name in reversed(rules):
        held = F.lit(False)
        for token in tokens:
            held = held | F.contains(text, F.lit(token))
        out = F.when(held, name).otherwise(out)
    return out


def map_names(df: DataFrame, column: str, names: Mapping[str, str], out: str) -> DataFrame:
    """FIL10: the name that a dictionary gives, else the value itself. The dictionary is the caller's and small."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return df.withColumn(out, F.coalesce(pairs[F.col(column)], F.col(column)))


def coalesce_columns(df: DataFrame, aliases: Sequence[str], out: str) -> DataFrame:
    """The first of the alias columns that the table has, under one name; null where it has none."""
    found = next((a for a in aliases if a in df.columns), None)
    return df.withColumn(out, F.col(found) if found else F.lit(None).cast("string"))


def to_boolean(value: Column) -> Column:
    """FIL13: true/false/1/0 in any case, anything else is an error."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


@F.pandas_udf(T.BooleanType())
def _composed(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else unicodedata.is_normalized("NFC", x))


def canonical_text(value: Column) -> Column:
    """FIL12: whether a name is trimmed, not empty, free of control characters and in composed form (NFC).

    Only names with letters beyond ASCII are looked at by Python, in Arrow batches.
    """
    plain = F.octet_length(value) == F.length(value)
    return (F.length(value) > 0) & (F.trim(value) == value) & ~F.rlike(value, F.lit(r"\p{Cntrl}")) & (plain | _composed(F.when(~plain, value)))


def keep_equal(df: DataFrame, wanted: dict) -> DataFrame:
    """FIL4: the rows whose columns have these values, such as cells that are kept or spots that lie in tissue."""
    for column, value in wanted.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name", sep: str = ".") -> DataFrame:
    """FIL15: later rows of a name get .1, .2 and so on, in the given order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(sep), n.cast("string"))))


def integer_counts(df: DataFrame, value: str) -> DataFrame:
    """FIL11: non-negative values rounded half to even; NaN and null become 0."""
    x = F.greatest(F.coalesce(F.nanvl(F.col(value), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("count", F.bround(x).cast("bigint"))


def integer_audit(df: DataFrame, value: str) -> DataFrame:
    """FIL11's report: share of values that aren't whole, negatives, and sums before and after."""
    out = integer_counts(df, value)
    return out.agg(F.avg((F.col(value) != F.floor(value)).cast("double")).alias("fraction_non_integer"), F.count_if(F.col(value) < 0).alias("n_negative"), F.sum(value).alias("sum_before"), F.sum("count").alias("sum_after"))


def significant(df: DataFrame, effect: str, p: str, max_p: float = 0.05, min_effect: float = 0.5) -> DataFrame:
    """FIL6, first source: both tests must hold."""
    return df.filter((F.col(p) < max_p) & (F.abs(effect) > min_effect))


def not_insignificant(df: DataFrame, effect: str, p: str, max_p: float = 0.05, min_effect: float = 0.3) -> DataFrame:
    """FIL6, second source: a row goes only if a test fails, so that NaN stays; unreadable values go."""
    q, x = F.expr(f"try_cast(`{p}` AS DOUBLE)"), F.expr(f"try_cast(`{effect}` AS DOUBLE)")
    fails = (~F.isnan(q) & (q > max_p)) | (~F.isnan(x) & (F.abs(x) < min_effect))
    return df.filter(q.isNotNull() & x.isNotNull() & ~fails)


def filter_cells_features(expr: DataFrame, *, cell: str = "cell_id", feature: str = "gene", value: str = "value", min_features: int, max_features: int, max_marked_share: float, marked: Column, min_cells: int) -> DataFrame:
    """FIL5 over sparse triples: cells by their numbers of features and share of marked ones, then features by cells.

    In this order: at least min_features, fewer than max_features, marked share (percent) below max_marked_share, and
    among the cells that stay features in at least min_cells.
    """
    nonzero = F.col(value) != 0
    per_cell = expr.groupBy(cell).agg(F.count_if(nonzero).alias("_n"), F.sum(value).alias("_all"), F.coalesce(F.sum(F.when(marked, F.col(value))), F.lit(0.0)).alias("_marked"))
    share = F.when(F.col("_all") > 0, 100.0 * F.col("_marked") / F.col("_all")).otherwise(0.0)
    kept = per_cell.filter((F.col("_n") >= min_features) & (F.col("_n") < max_features) & (share < max_marked_share)).select(cell)
    cells = expr.join(kept, cell, "left_semi")
    per_feature = cells.groupBy(feature).agg(F.count_if(nonzero).alias("_n")).filter(F.col("_n") >= min_cells).select(feature)
    return cells.join(per_feature, feature, "left_semi")


def first_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """SET7: the first row of each key in a stated order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def star_merge(cells: DataFrame, samples: DataFrame, groups: DataFrame, sample: str, group: str, keep: Column) -> DataFrame:
    """JOI1: left joins to two dimensions whose keys are made unique first, then a filter."""
    s = samples.dropDuplicates([sample])
    g = groups.dropDuplicates([group])
    return cells.join(s, sample, "left").join(g, group, "left").filter(keep)


def outer_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """JOI4: both tables' values by key, 0 where one has none."""
    left, right = a.select(*keys, F.col(value).alias("value_a")), b.select(*keys, F.col(value).alias("value_b"))
    both = left.join(right, list(keys), "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("value_a", "value_b")})


def complete_universe(raw: DataFrame, names: DataFrame, *, source: str = "source", target: str = "target", score: str = "score") -> DataFrame:
    """JOI5 and SET5: all ordered pairs of distinct names with the largest score given, 0 and returned = false where none is.

    names: (name, place), the declared universe, which is the size of the result's square root. Pairs outside it and
    pairs of a name with itself are dropped; columns source, target, score, returned and the places.
    """
    best = raw.filter((F.col(source) != F.col(target)) & (F.col(score) >= 0)).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.max(score).alias("score"))
    a = names.select(F.col("name").alias("source"), F.col("place").alias("source_place"))
    b = names.select(F.col("name").alias("target"), F.col("place").alias("target_place"))
    pairs = a.join(b, F.col("source") != F.col("target"))
    out = pairs.join(best, ["source", "target"], "left")
    return out.withColumns({"returned": F.col("score").isNotNull(), "score": F.coalesce("score", F.lit(0.0))})


def paired_universe(a: DataFrame, b: DataFrame, reference: DataFrame, eligible: DataFrame) -> DataFrame:
    """JOI6: two complete universes side by side, with a reference flag and whether the source is eligible."""
    both = a.select("source", "target", F.col("score").alias("score_a")).join(b.select("source", "target", F.col("score").alias("score_b")), ["source", "target"])
    flagged = both.join(reference.select("source", "target").distinct().withColumn("is_reference", F.lit(True)), ["source", "target"], "left")
    flagged = flagged.join(eligible.select("source").distinct().withColumn("is_eligible", F.lit(True)), "source", "left")
    return flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_reference", "is_eligible")})


def join_or_fallback(rows: DataFrame, labels: DataFrame, key: str, label: str, sep: str = "_") -> DataFrame:
    """JOI7: labels by key; only where no row at all finds one, by what stands behind the key's last separator."""
    exact = rows.join(labels.select(key, label), key, "left")
    any_hit = exact.agg(F.max(F.col(label).isNotNull()).alias("_hit"))
    tail = labels.select(F.substring_index(key, sep, -1).alias("_tail"), F.col(label).alias("_other")).dropDuplicates(["_tail"])
    out = exact.withColumn("_tail", F.substring_index(key, sep, -1)).join(tail, "_tail", "left").crossJoin(F.broadcast(any_hit))
    return out.withColumn(label, F.when(F.col("_hit"), F.col(label)).otherwise(F.col("_other"))).drop("_tail", "_other", "_hit")


def first_match(rows: DataFrame, index: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """JOI16: the payload of the first row of index, by order and then by key column, that holds the row's key."""
    stacked = index.select(order, "payload", F.posexplode(F.array(*keys)).alias("_pos", "key")).filter("key is not null and key <> ''")
    first = stacked.groupBy("key").agg(F.min_by("payload", F.struct(order, "_pos")).alias("payload"))
    return rows.join(first, "key", "left")
