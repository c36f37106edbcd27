"""Chat formatting: logged conversations that only prefix longer ones are dropped, the others are rendered.

A conversation is the sequence of its turns' (role, text). Each turn has a hash that includes its place; the
running sums of these hashes are the hashes of all prefixes, so that no step holds a conversation as a whole:
places and sums are taken within blocks of turns and over the blocks' totals. A conversation is dropped if its
whole hash is a proper prefix of another, or the whole of one with a smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import need, table, written

BLOCK = 256
PART = 256


def _hash(*parts: Column) -> list[Column]:
    """Two numbers of 64 bits as decimals: sums of 2 ** 60 of them don't overflow."""
    return [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)") for seed in (11, 29)]


#: What tells conversations apart: the id, and for rows without one a hash of the row (0 for all others).
KEY = ["conv_id", "own"]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.own") == F.col(f"{b}.own"))


def turns_of(chats: DataFrame) -> DataFrame:
    """Columns conv_id, own, turn, role, text, place (from 1 in each conversation), n (its number of turns) and block.

    Equal rows count once. Turns are in the order of (turn, role, text), nulls first; a null role or text equals
    another null and nothing else. A row with a null conv_id is a conversation of its own, so that such rows, however
    many, don't meet in one task.
    """
    need(chats, "conv_id", "turn", "role", "text")
    rows = chats.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")).otherwise(0))
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-BLOCK)) / BLOCK).cast("bigint"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*KEY, "block").orderBy(*order)))
    blocks = rows.groupBy(*KEY, "block").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*KEY)
    blocks = blocks.withColumn("_before", F.sum("_size").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.sum("_size").over(whole))
    joined = rows.alias("r").join(blocks.alias("b"), _same("r", "b") & (F.col("r.block") == F.col("b.block")))
    return joined.select("r.conv_id", "r.own", "r.turn", "r.role", "r.text", (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_in")).cast("bigint").alias("place"), F.col("n").cast("bigint"), "r.block")


def prefixes_of(turns: DataFrame) -> DataFrame:
    """Columns conv_id, own, place, n, h1, h2: the hashes of each conversation's first `place` turns."""
    h = turns.select(*KEY, "place", "n", *(x.alias(f"t{i + 1}") for i, x in enumerate(_hash(F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")))))
    h = h.withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("bigint"))
    blocks = h.groupBy(*KEY, "block").agg(F.sum("t1").alias("_s1"), F.sum("t2").alias("_s2"))
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_b{i}": F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0).cast("decimal(38,0)")) for i in (1, 2)})
    own = Window.partitionBy(*KEY, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({f"_o{i}": F.sum(f"t{i}").over(own) for i in (1, 2)})
    joined = h.alias("h").join(blocks.alias("b"), _same("h", "b") & (F.col("h.block") == F.col("b.block")))
    return joined.select("h.conv_id", "h.own", "place", "n", *((F.col(f"_b{i}") + F.col(f"_o{i}")).alias(f"h{i}") for i in (1, 2)))


def maximal(chats: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row (conv_id, own, n) for each conversation that prefixes no other; of equal ones the smallest id stays.

    A null id is smaller than all others.
    """
    turns = turns_of(chats) if turns is None else turns
    prefixes = written(prefixes_of(turns), "prefixes")
    whole = prefixes.filter(F.col("place") == F.col("n")).groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("_least"), F.min(F.when(F.col("conv_id").isNull(), F.col("own"))).alias("_own"))
    whole = whole.select("n", "h1", "h2", F.when(F.col("_own").isNull(), F.col("_least")).alias("conv_id"), F.coalesce("_own", F.lit(0)).alias("own"))
    longer = prefixes.filter(F.col("place") < F.col("n")).select(F.col("place").alias("n"), "h1", "h2").distinct()
    return whole.join(longer, ["n", "h1", "h2"], "left_anti").select(*KEY, "n")


def render(chats: DataFrame, part: int = PART) -> DataFrame:
    """The maximal conversations as text, columns conv_id, part, n_turns and rendered.

    A turn becomes "<|role|>", a line feed, its text and a line feed; a null is empty. A conversation of more than
    `part` turns is given in parts of so many turns, which concatenated in order are the whole. Each row with a null
    conv_id is a conversation of its own. An empty table gives an empty result; columns besides conv_id, turn, role and
    text are ignored. Texts are whole, however long.
    """
    turns = written(turns_of(chats), "turns")
    keep = maximal(chats, turns)
    rows = turns.alias("t").join(keep.alias("k"), _same("t", "k"), "left_semi")
    line = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("")), F.lit("|>\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))
    rows = rows.select(*KEY, F.floor((F.col("place") - 1) / part).cast("bigint").alias("part"), F.struct("place", line.alias("line")).alias("_turn"))
    grouped = rows.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list("_turn")).alias("_turns"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join(F.col("_turns.line"), "").alias("rendered"))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """The rendered maximal conversations of the whole table."""
    return render(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT conv_id, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line,
    md5(CASE WHEN role IS NULL THEN 'n' ELSE 'r' || md5(role) END || CASE WHEN text IS NULL THEN 'n' ELSE 't' || md5(text) END) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM rows),
whole AS (SELECT conv_id, string_agg(t, '' ORDER BY place) AS s, count(*) AS n FROM placed GROUP BY conv_id),
least AS (SELECT s, min(n) AS n, min(conv_id) AS conv_id FROM whole GROUP BY s),
heads AS (SELECT DISTINCT left(s, 32 * i) AS s FROM (SELECT s, unnest(range(1, n)) AS i FROM least)),
kept AS (SELECT conv_id FROM least WHERE s NOT IN (SELECT s FROM heads))
SELECT conv_id, ((place - 1) // {PART})::BIGINT AS part, count(*)::BIGINT AS n_turns, string_agg(line, '' ORDER BY place) AS rendered
FROM placed WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY ALL
"""
