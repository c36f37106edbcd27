"""Mixing sources to target weights: raking of token weights, then calibrated sampling.

Iterative proportional fitting over the cells (source, language, topic): each pass scales the cells' weights
to the target share of one margin after the other, within what the cells hold. Only cells are iterated on, never
documents; the documents are read once for the cells' token counts and once for the decision, and neither pass carries
their texts through a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, need, table, written

NULL = "(null)"
WORD = r"[^\x20\x09-\x0D]+"
#: A text's topic is its register: the first class of marks of which it has at least DENSE for each word, in this order;
#: numbers, where digits are at least DENSE of all letters; else prose.
MARKS = {"table": "|", "shout": "!", "symbols": "$%&*#@^~=+<>"}
DENSE = 0.1
LANG_SHARE = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPIC_SHARE = {"prose": 0.90, "table": 0.06, "shout": 0.02, "symbols": 0.02}
KEEP, POWER = 0.5, 0.5
#: Passes over the margins at most, passes between two checks, and the distance of a margin from its target, as a part of
#: the sample, at which they end.
PASSES, BLOCK, NEAR = 40, 2, 1e-9
#: So many cells are fitted in one row.
FEW = 1 << 14
#: The columns that mix() adds.
ADDED = ("_source", "_lang", "_topic", "_tokens", "_share", "_p", "_u", "_sampled")
MARGINS = ("_source", "_lang", "_topic")


def topic_of(text: Column, tokens: Column) -> Column:
    """The register of a text with so many words; null and empty texts are prose."""
    out = F.when(F.regexp_count(text, F.lit("[0-9]")) >= DENSE * F.length(text), "numbers").otherwise("prose")
    for name, marks in reversed(MARKS.items()):
        n = F.length(text) - F.length(F.replace(text, F.lit(marks), F.lit(""))) if len(marks) == 1 else F.regexp_count(text, F.lit("[" + "".join("\\" + m for m in marks) + "]"))
        out = F.when(n >= DENSE * tokens, name).otherwise(out)
    return F.when(tokens > 0, out).otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform_of(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the seed and the key; the same key draws the same number."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return bits.cast("bigint").cast("double") / F.lit(float(2**52))


def _targets(spark, share: Mapping[str, float], name: str) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in share.items()], f"{name} string, _share double")


def _levels(margin: DataFrame, size: Column) -> DataFrame:
    """margin (value, _share, _supply) with the target of each value: least(_supply, level * _share), the level being such
    that the targets sum to size.

    Values are taken whole in the order of supply over share until the rest can be shared out; a margin's values are as
    many as there are sources, languages or topics.
    """
    open_ = margin.filter("_share > 0 and _supply > 0").withColumn("_r", F.col("_supply") / F.col("_share"))
    order = Window.orderBy("_r", F.col(margin.columns[0]))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    steps = open_.select("_r", ((size - F.coalesce(F.sum("_supply").over(before), zero)) / (F.sum("_share").over(Window.partitionBy()) - F.coalesce(F.sum("_share").over(before), zero))).alias("_l"))
    # from the first value on that can be scaled, later ones would give less
    level = steps.agg(F.coalesce(F.max(F.when(F.col("_l") <= F.col("_r"), F.col("_l"))), F.max("_r"), zero).alias("_level"))
    return margin.crossJoin(F.broadcast(level)).select(margin.columns[0], F.least("_supply", F.col("_level") * F.col("_share")).alias("_target"))


def _rake_few(cells: DataFrame, columns: list[str], passes: int) -> DataFrame:
    """_rake_many() of cells that fit into one row: all passes are one expression over arrays, so one small task."""
    names = cells.columns
    one = cells.agg(F.array_sort(F.collect_list(F.struct(*columns, "_cap", "_take", *(f"_t{c}" for c in columns), *(c for c in names if c not in {*columns, "_cap", "_take", *(f"_t{m}" for m in columns)})))).alias("x")).filter(F.size("x") > 0)
    one = one.withColumns({"i": F.sequence(F.lit(0), F.size("x") - 1), "cap": F.col("x._cap"), "take": F.col("x._take")} | {f"v{c}": F.array_sort(F.array_distinct(F.col(f"x.{c}"))) for c in columns})
    members = lambda c: F.transform(f"v{c}", lambda v: F.filter(F.col("i"), lambda i: F.col(f"x.{c}")[i] == v))
    places = lambda c: F.transform(F.col(f"x.{c}"), lambda v: (F.array_position(F.col(f"v{c}"), v) - 1).cast("int"))
    one = one.withColumns({f"m{c}": members(c) for c in columns} | {f"p{c}": places(c) for c in columns})
    targets = lambda c: F.transform(f"m{c}", lambda m: F.col(f"x._t{c}")[m[0]])
    one = one.withColumns({f"t{c}": targets(c) for c in columns})
    full = lambda take, i: take[i] >= F.col("cap")[i] * (1 - 1e-12)

    def step(take: Column, c: str) -> Column:
        added = lambda m, f: F.aggregate(m, F.lit(0.0), lambda s, i: s + f(i))
        sums = F.transform(f"m{c}", lambda m: F.struct(added(m, lambda i: take[i]).alias("sum"), added(m, lambda i: F.when(full(take, i), take[i]).otherwise(0.0)).alias("full")))

        def scaled(i: Column, held: Column) -> Column:
            at, want = held[F.col(f"p{c}")[i]], F.col(f"t{c}")[F.col(f"p{c}")[i]]
            return _scaled(take[i], F.col("cap")[i], at["sum"], at["full"], want, full(take, i))

        # the sums are bound to a variable, so that they are taken once a step
        return F.flatten(F.transform(F.array(sums), lambda held: F.transform("i", lambda i: scaled(i, held))))

    def bound(take: Column, c: str) -> Column:
        return F.flatten(F.transform(F.array(take), lambda t: step(t, c)))

    def turn(take: Column) -> Column:
        for c in columns:
            take = bound(take, c)
        return take

    done = one.select("x", F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("take"), lambda take, _: turn(take)).alias("take"))
    rows = done.select(F.explode(F.arrays_zip("x", "take")).alias("r")).select("r.x.*", F.col("r.take").alias("_new"))
    return rows.withColumn("_take", F.col("_new")).select(*names)


def _scaled(take: Column, cap: Column, total: Column, held: Column, want: Column, full: Column) -> Column:
    """A cell's next take: scaled down with its margin's total, or up with what its margin's open cells lack."""
    more = F.when(full, take).otherwise(F.least(cap, take * (want - held) / F.nullif(total - held, F.lit(0.0))))
    return F.coalesce(F.when(total < want, more).otherwise(take * want / F.nullif(total, F.lit(0.0))), take)


def _rake_many(cells: DataFrame, columns: list[str], passes: int, near: float) -> DataFrame:
    """Scales _take to the targets of one column after the other; every second pass is written, and judged by `near`."""
    out = cells
    for at in range(0, passes, BLOCK):
        for _ in range(min(BLOCK, passes - at)):
            out = out.withColumn("_gap", F.lit(0.0))
            for column in columns:
                w, want = Window.partitionBy(column), F.col(f"_t{column}")
                full = F.col("_take") >= F.col("_cap") * (1 - 1e-12)
                out = out.withColumns({"_sum": F.sum("_take").over(w), "_full": F.sum(F.when(full, F.col("_take")).otherwise(0.0)).over(w)})
                take = _scaled(F.col("_take"), F.col("_cap"), F.col("_sum"), F.col("_full"), want, full)
                out = out.withColumns({"_gap": F.greatest(F.col("_gap"), F.abs(F.col("_sum") - want)), "_take": take}).drop("_sum", "_full")
        out = written(out, "raked")
        if (out.agg(F.max("_gap")).first()[0] or 0.0) <= near:
            break
        out = out.drop("_gap")
    return out.drop("_gap")


def rake(cells: DataFrame, weight: str, margins: Mapping[str, DataFrame], keep: float, passes: int = PASSES, few: int = FEW) -> DataFrame:
    """Adds _take, the tokens to sample of each cell, at most its weight, and its margins' targets (_t and the column).

    margins: for each column of cells, a DataFrame (column, _share). The sample is the part keep of all weight, as far as
    cells hold it whose three shares are above 0. A value that holds less than its share is taken whole, and the others of
    its margin share the rest by their shares. From keep times its weight on, a cell is scaled by what its margins lack, one
    after the other; full cells stay full while their margin lacks tokens. This ends with `passes` passes, or, with more
    than `few` cells, when all margins meet their targets; up to `few` cells are scaled in one row, more by windows.
    """
    cap = F.col(weight).cast("double")
    out = cells
    for column, share in margins.items():
        out = out.join(share.select(column, F.col("_share").alias(f"_s{column}")), column, "left")
    open_ = F.lit(True)
    for column in margins:
        open_ = open_ & (F.coalesce(F.col(f"_s{column}"), F.lit(0.0)) > 0)
    out = written(out.withColumn("_open", open_ & (cap > 0)).withColumn("_cap", F.when(F.col("_open"), cap).otherwise(0.0)), "cells")
    n, whole, supply = out.agg(F.count(F.lit(1)), F.sum(weight), F.sum("_cap")).first()
    size = F.lit(min(float(keep) * float(whole or 0), supply or 0.0))
    held = out
    for column, share in margins.items():
        supply_of = held.groupBy(column).agg(F.sum("_cap").alias("_supply"))
        margin = written(supply_of.join(share.select(column, "_share"), column).select(column, "_share", "_supply"), "margin")
        out = out.join(_levels(margin, size).withColumnRenamed("_target", f"_t{column}"), column, "left")
    out = written(out.withColumn("_take", F.col("_cap") * F.lit(float(keep))).fillna(0.0, [f"_t{c}" for c in margins]), "raked")
    done = _rake_few(out, list(margins), passes) if n <= few else _rake_many(out, list(margins), passes, NEAR * float(whole or 0))
    return done.drop("_open", "_cap", *(f"_s{c}" for c in margins))


def fit(docs: DataFrame, *, source: str = "source", lang: str = "lang", text: str = "text", lang_share: Mapping[str, float] = LANG_SHARE, topic_share: Mapping[str, float] = TOPIC_SHARE, power: float = POWER, keep: float = KEEP, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(marked documents, fitted cells): the first half of mix()."""
    spark = docs.sparkSession
    marked = docs.withColumns({"_source": F.coalesce(col(source).cast("string"), F.lit(NULL)), "_lang": F.coalesce(col(lang).cast("string"), F.lit(NULL)), "_tokens": tokens_of(col(text))}).withColumn("_topic", topic_of(col(text), F.col("_tokens")))
    cells = written(marked.groupBy(*MARGINS).agg(F.sum("_tokens").alias("_cell_tokens")), "cells")
    sources = cells.groupBy("_source").agg(F.sum("_cell_tokens").cast("double").alias("_n")).withColumn("_share", F.when(F.col("_n") > 0, F.pow(F.col("_n"), F.lit(float(power)))).otherwise(0.0))
    margins = {"_source": _norm(sources, "_source"), "_lang": _stated(cells, _targets(spark, lang_share, "_lang"), "_lang"), "_topic": _stated(cells, _targets(spark, topic_share, "_topic"), "_topic")}
    margins = {c: written(share.select(c, "_share"), "share") for c, share in margins.items()}  # each is read several times
    return marked, rake(cells, "_cell_tokens", margins, keep, passes)


def margins_of(fitted: DataFrame) -> DataFrame:
    """(margin, value, target, reached) in tokens: what the fit aims at and what it samples, for each margin's values."""
    rows = F.explode(F.array(*(F.struct(F.lit(m[1:]).alias("margin"), F.col(m).alias("value"), F.col(f"_t{m}").alias("target")) for m in MARGINS))).alias("x")
    return fitted.select(rows, "_take").groupBy("x.margin", "x.value").agg(F.max("x.target").alias("target"), F.sum("_take").alias("reached"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", lang_share: Mapping[str, float] = LANG_SHARE, topic_share: Mapping[str, float] = TOPIC_SHARE, power: float = POWER, keep: float = KEEP, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """Adds _source, _lang, _topic, _tokens, _share, _p, _u and _sampled to the documents.

    Targets: sources by their tokens to the given power (1 leaves them as they are, 0 makes them equal), languages and
    topics by the given shares, of a sample with the part keep of all tokens; tokens are words. A document's probability is
    what the fit (see rake) takes of its cell over what the cell holds, and _share the cell's part of the sample. A value
    with fewer tokens than its target is taken whole; margins_of() tells what is reached. A null source or language is the
    value "(null)". A language or topic without a stated share has its part of all tokens as target, and the stated shares
    are scaled to the rest; a share stated as 0 excludes. A document without words weighs nothing and is not sampled; equal
    keys (null among them) share their draw, so repeated rows come or go together. An empty table gives an empty result.
    Texts are read whole, however long. Other columns pass through, but columns of the names added are replaced; none of
    these names can be that of the key, source, language or text (a ValueError).
    """
    need(docs, key, source, lang, text)
    if clash := set(ADDED) & {c.lower() for c in (key, source, lang, text)}:
        raise ValueError(f"columns are added under these names: {sorted(clash)}")
    docs = docs.select(*(col(c) for c in docs.columns if c.lower() not in ADDED))
    marked, fitted = fit(docs, source=source, lang=lang, text=text, lang_share=lang_share, topic_share=topic_share, power=power, keep=keep, passes=passes)
    total = fitted.agg(F.sum("_take").alias("_all"))
    fitted = fitted.crossJoin(F.broadcast(total)).select(*MARGINS, F.coalesce(F.col("_take") / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0)).alias("_share"), F.when(F.col("_cell_tokens") > 0, F.least(F.lit(1.0), F.col("_take") / F.col("_cell_tokens"))).otherwise(0.0).alias("_p"))
    out = marked.join(written(fitted, "fitted"), list(MARGINS), "left")
    out = out.withColumn("_p", F.when(F.col("_tokens") > 0, F.col("_p")).otherwise(0.0)).withColumn("_u", uniform_of(col(key), seed))
    return out.withColumn("_sampled", F.col("_u") < F.col("_p"))


def _stated(cells: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """The stated shares of the values that have tokens; a value without one gets its part of all tokens, and the stated
    shares are scaled to what these values leave."""
    found = cells.filter(F.col("_cell_tokens") > 0).groupBy(column).agg(F.sum("_cell_tokens").cast("double").alias("_n")).join(target, column, "left")
    totals = found.agg(F.sum("_share").alias("_sum"), F.coalesce(F.sum(F.when(F.col("_share").isNull(), F.col("_n"))), F.lit(0.0)).alias("_rest"), F.sum("_n").alias("_all"))
    stated = F.when(F.col("_sum") > 0, F.col("_share") / F.col("_sum") * (1 - F.col("_rest") / F.col("_all"))).otherwise(0.0)
    return found.crossJoin(F.broadcast(totals)).select(column, F.when(F.col("_share").isNull(), F.col("_n") / F.col("_all")).otherwise(stated).alias("_share"))


def _norm(target: DataFrame, column: str) -> DataFrame:
    total = target.agg(F.sum("_share").alias("_sum"))
    return target.crossJoin(F.broadcast(total)).select(column, F.when(F.col("_sum") > 0, F.col("_share") / F.col("_sum")).otherwise(0.0).alias("_share"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Per document its cell, its probability and whether it is sampled."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_share", 6).alias("share"), F.round("_p", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def mix_sql(docs: str = "documents", keep: float = KEEP, power: float = POWER, passes: int = PASSES, lang_share: Mapping[str, float] = LANG_SHARE, topic_share: Mapping[str, float] = TOPIC_SHARE) -> str:
    """DuckDB's SQL for mix(), with all passes: a chain of common table expressions that ends in one named mixed."""
    dense = lambda marks: f"length(text) - length(translate(text, '{marks}', ''))"
    case = "CASE WHEN coalesce(_tokens, 0) = 0 THEN 'prose' " + " ".join(f"WHEN {dense(m)} >= {DENSE} * _tokens THEN '{n}'" for n, m in MARKS.items()) + f" WHEN {dense('0123456789')} >= {DENSE} * length(text) THEN 'numbers' ELSE 'prose' END"
    values = lambda share: ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in share.items())
    parts = [
        f"counted AS MATERIALIZED (SELECT *, coalesce(source, '{NULL}') AS _source, coalesce(lang, '{NULL}') AS _lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS _tokens FROM {docs})",
        f"marked AS MATERIALIZED (SELECT *, {case} AS _topic FROM counted)",
        "cells AS (SELECT _source, _lang, _topic, sum(_tokens)::DOUBLE AS n FROM marked GROUP BY ALL)",
        f"s_source AS (SELECT _source AS k, w / nullif(sum(w) OVER (), 0) AS s FROM (SELECT _source, CASE WHEN sum(n) > 0 THEN pow(sum(n), {power!r}) ELSE 0 END AS w FROM cells GROUP BY _source))",
    ]
    for name, share in (("lang", lang_share), ("topic", topic_share)):
        parts.append(f"n_{name} AS (SELECT _{name} AS k, sum(n) AS n, any_value(v.s) AS s FROM cells LEFT JOIN (VALUES {values(share)}) AS v(k, s) ON v.k = _{name} GROUP BY _{name} HAVING sum(n) > 0)")
        parts.append(f"s_{name} AS (SELECT k, CASE WHEN s IS NULL THEN n / sum(n) OVER () WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () * (1 - coalesce(sum(n) FILTER (s IS NULL) OVER (), 0) / sum(n) OVER ()) ELSE 0 END AS s FROM n_{name})")
    parts.append("opened AS (SELECT c.*, CASE WHEN a.s > 0 AND b.s > 0 AND d.s > 0 THEN n ELSE 0 END AS cap FROM cells c LEFT JOIN s_source a ON a.k = _source LEFT JOIN s_lang b ON b.k = _lang LEFT JOIN s_topic d ON d.k = _topic)")
    parts.append(f"size AS (SELECT least({keep!r} * sum(n), sum(cap)) AS size FROM opened)")
    for name in ("source", "lang", "topic"):
        parts.append(f"m_{name} AS (SELECT o.k, o.supply, s.s, o.supply / s.s AS r FROM (SELECT _{name} AS k, sum(cap) AS supply FROM opened GROUP BY _{name}) o JOIN s_{name} s ON s.k = o.k)")
        steps = f"SELECT r, ((SELECT size FROM size) - coalesce(sum(supply) OVER w, 0)) / (sum(s) OVER () - coalesce(sum(s) OVER w, 0)) AS l FROM m_{name} WHERE s > 0 AND supply > 0 WINDOW w AS (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"l_{name} AS (SELECT coalesce(max(l) FILTER (l <= r), max(r), 0) AS level FROM ({steps}))")
    target = lambda x: f"(SELECT k, least(supply, level * s) AS t FROM m_{x}, l_{x})"
    parts.append(f"w0 AS MATERIALIZED (SELECT o.*, cap * {keep!r} AS w, coalesce(a.t, 0) AS t_source, coalesce(b.t, 0) AS t_lang, coalesce(d.t, 0) AS t_topic FROM opened o LEFT JOIN {target('source')} a ON a.k = _source LEFT JOIN {target('lang')} b ON b.k = _lang LEFT JOIN {target('topic')} d ON d.k = _topic)")
    n = 0
    for _ in range(passes):
        for name in ("source", "lang", "topic"):
            sums = f"SELECT _source, _lang, _topic, n, cap, w, t_source, t_lang, t_topic, sum(w) OVER p AS s, sum(CASE WHEN w >= cap * (1 - 1e-12) THEN w ELSE 0 END) OVER p AS f FROM w{n} WINDOW p AS (PARTITION BY _{name})"
            more = f"CASE WHEN w >= cap * (1 - 1e-12) THEN w ELSE least(cap, w * (t_{name} - f) / nullif(s - f, 0)) END"
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (s, f) REPLACE (coalesce(CASE WHEN s >= t_{name} THEN w * t_{name} / nullif(s, 0) ELSE {more} END, w) AS w) FROM ({sums}))")
            n += 1
    parts += [
        f"fitted AS (SELECT _source, _lang, _topic, coalesce(w / nullif(sum(w) OVER (), 0), 0) AS _share, CASE WHEN n > 0 THEN least(1.0, w / n) ELSE 0 END AS _p FROM w{n})",
        "mixed AS (SELECT m.*, f._share, CASE WHEN _tokens > 0 THEN f._p ELSE 0 END AS _p, (CASE WHEN _tokens > 0 THEN f._p ELSE 0 END) > ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS _sampled FROM marked m JOIN fitted f USING (_source, _lang, _topic))",
    ]
    return "WITH " + ",\n".join(parts)


SQL = mix_sql() + "\nSELECT doc_id, _source AS source, _lang AS lang, _topic AS topic, _tokens AS n_tokens, round(_share, 6) AS share, round(_p, 6) AS probability, _sampled AS sampled FROM mixed"
