"""Benchmark decontamination: a prefix-filtered join of benchmark windows with document words.

A window is 13 consecutive words of an item, or the whole item where it has fewer. A window that occurs as it is
holds all of its words, so one of them is a necessary prefix: the rarest over all documents. Only documents' words
equal to some window's rarest word are joined; the place of that word in the window gives the only start that the
window can have, which must lie in the document; the words from there on are then compared one by one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, need, table, written

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 13
PART = 20
#: Up to so many bytes a set of words is sent to all executors; beyond, the words are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: The columns that decontaminate() adds.
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: WORD with each excluded character named, which Java looks up in a table instead of trying ranges.
_FAST = "[^" + "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))) + "]+"


def raw_words(text: Column) -> Column:
    """The words as they are; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_FAST), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """The word with A to Z lowered and all other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_FAST)), F.lit(0)).cast("bigint")


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct rows (item_id, words, n, w): each item's windows; w joins the words by a space."""
    rows = items.select("item_id", F.transform(raw_words(F.col("text")), lowered).alias("all")).withColumn("m", F.size("all")).filter("m > 0")
    rows = rows.select("item_id", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("m") - size + 1))).alias("at"))
    rows = rows.select("item_id", F.slice("all", F.col("at"), F.lit(size)).alias("words"))
    return rows.select("item_id", "words", F.size("words").alias("n"), F.array_join("words", " ").alias("w")).distinct()


def _sent(df: DataFrame, column: str, limit: int) -> DataFrame:
    """df, marked for a broadcast if its words' bytes are within the limit."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column) + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = SIZE, part: int = PART, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to the documents (doc_id, text, ...).

    A document's word is hit if it lies in an occurrence of a window; the document is contaminated if at least one
    word in `part` is hit. items_sha256 is over the ids of occurring items, sorted as strings and joined by commas;
    an item with a null id has windows but is not listed. Null and empty texts have no words; items without words
    have no windows. Repeated rows and equal ids each keep their own row and result. Texts are read whole, however long. An
    empty table of documents gives an empty result, an empty benchmark hits nothing. Other columns pass through,
    whatever their names, but columns of the names added are replaced. Rows are told apart by id and 128 bits of hash.
    """
    need(docs, "doc_id", "text")
    need(items, "item_id", "text")
    docs = docs.select(*(col(c) for c in docs.columns if c.lower() not in ADDED))
    key = fresh(docs, "_k1", "_k2", "_k3")
    (own,) = fresh(docs, "_ids")
    of_row = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *(F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("text")) for seed in (1, 2)))
    keyed = docs.withColumns(dict(zip(key, of_row, strict=True)))
    windows = written(windows_of(items, size), "windows")

    vocabulary = written(windows.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    seen = keyed.select(F.explode(raw_words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("word"))
    counts = written(seen.join(_sent(vocabulary, "word", broadcast_bytes), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("_count")), "counts")
    ranked = windows.select("w", "n", "words").distinct().select("w", "n", F.posexplode("words").alias("offset", "word"))
    ranked = ranked.join(counts, "word", "left")
    rarest = ranked.groupBy("w", "n").agg(F.min(F.struct(F.coalesce(F.col("_count"), F.lit(0)).alias("count"), "word", "offset")).alias("r"))
    prefixes = written(rarest.filter("r.count > 0").select("w", "n", F.col("r.word").alias("word"), F.col("r.offset").alias("offset")), "prefixes")

    places = keyed.select(*key, F.posexplode(raw_words(F.col("text"))).alias("_at", "word")).withColumn("word", lowered(F.col("word")))
    places = places.join(_sent(prefixes.select("word").distinct(), "word", broadcast_bytes), "word", "left_semi")
    found = places.join(_sent(prefixes, "w", broadcast_bytes), "word").withColumn("start", F.col("_at") - F.col("offset"))
    found = found.filter("start >= 0").groupBy(*key).agg(F.collect_set(F.struct("start", "n", "w")).alias("_found"))

    # the words are bound to a variable, so that they are taken from the text once for all places
    def sure(words: Column) -> Column:
        fits = lambda x: x["start"] + x["n"] <= F.size(words)
        same = lambda x: F.array_join(F.transform(F.slice(words, x["start"] + 1, x["n"]), lowered), " ") == x["w"]
        return F.filter("_found", lambda x: fits(x) & same(x))

    joined = keyed.select(*key, "text").join(found, key)
    joined = joined.select(*key, F.transform(F.array(raw_words(F.col("text"))), sure)[0].alias("_sure"))
    joined = written(joined.filter(F.size("_sure") > 0).dropDuplicates(key), "sure")
    hit = F.size(F.array_distinct(F.flatten(F.transform("_sure", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    hits = joined.select(*key, hit.cast("bigint").alias("n_hit"), F.array_distinct(F.col("_sure.w")).alias("_ws"))

    ids = hits.select(*key, F.explode("_ws").alias("w")).join(windows.filter("item_id is not null").select("w", "item_id"), "w")
    ids = ids.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias(own))
    known = hits.select(*key, "n_hit").join(ids, key, "left")

    no_ids = F.array().cast("array<string>")
    out = keyed.withColumn("n_words", n_words(F.col("text")))
    out = out.join(known, key, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("bigint"), own: F.coalesce(own, no_ids)})
    out = out.withColumns({"n_items": F.size(own).cast("bigint"), "items_sha256": F.sha2(F.array_join(own, ","), 256), "contaminated": (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words"))})
    return out.select(*(col(c) for c in docs.columns), *ADDED)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def decontaminate_sql(docs: str = "documents", size: int = SIZE, part: int = PART) -> str:
    """DuckDB's SQL: a chain of common table expressions that ends in one named judged (doc_id and the columns added)."""
    low = "translate({}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"
    words = lambda t: f"coalesce(regexp_extract_all({low.format(t)}, '{WORD}'), [])"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words('text')} AS ws FROM {docs}),
i AS (SELECT item_id, {words('text')} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + {size - 1}], ' ') AS w, least({size}, len(ws)) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {size} + 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n),
hits AS MATERIALIZED (SELECT doc_id, p, n, w FROM (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM spots) WHERE w IN (SELECT w FROM win)),
marked AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM hits JOIN win USING (w) GROUP BY doc_id),
judged AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {part} * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN ids USING (doc_id))"""


SQL = decontaminate_sql() + "\nSELECT * FROM judged"
