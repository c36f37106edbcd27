"""Repeated byte strings, by suffix arrays of shards.

Which strings of `length` bytes start at two places? Strings meet in a shard through an anchor inside them (see
_winnow): strings with the same run of bytes around the anchor belong to one shard, and strings around which
nothing is repeated need none. Segments of strings that are equal as a whole count as one. A shard's text is the
segments around a repeated run, of equal ones two; its suffix array is sorted by Larsson and Sadakane's refinement,
whose ranks multiply the compared length each round, and Kasai's algorithm gives the common prefixes of neighbours, which
alone decide what is repeated; the further copies of a segment have the outcome of its first. A run with more segments
than a shard holds is dealt over several shards; their sorted strings are merged by binary search afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import narrowed, need, table, written
from ._winnow import ROW, doc_id, halves, islands, merged, pieces, row_keys

U = np.uint64
LENGTH = 400
GRAM = 64
SEEDS = (0xBEEF, 0xCAFE)
#: Segments of one run that go to one shard, about, and bytes of text at which a shard is sorted.
SHARD_SEGMENTS = 512
SHARD_BYTES = 1 << 18
#: Bytes of text that are hashed at once; a longer text is walked in stretches of so many windows.
STEP = 1 << 20
STRETCH = 16
CLASS = ["g2", "h1", "h2"]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order, a suffix before those that it starts.

    Larsson and Sadakane's refinement: a suffix's rank by its first h bytes and those of the suffixes h (and 2 h) further
    on give its rank by 2 h (3 h) bytes. A round ranks only those that still have equals; as many ranks are joined as one
    number holds.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(U)
    sa = np.argsort(key)
    key = key[sa]
    rank = np.zeros(n + 1, U)  # 0: behind the end
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    # zeros at the end look like what is behind it: of these suffixes the shortest is first, and none equals another
    if last := int((np.cumsum(text[:-9:-1]) == 0).sum()):
        none = sa[: np.searchsorted(key, 0, side="right")]
        none[:] = np.concatenate([np.arange(n - 1, n - last - 1, -1), none[none < n - last]])
        head[: last + 1] = True
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0)).astype(U)
    bits = n.bit_length()
    joined = 3 if 3 * bits <= 64 else 2
    h = 8
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        p = sa[at]
        key = rank[p]
        for k in range(1, joined):
            key = (key << U(bits)) | rank[np.minimum(p + k * h, n)]
        order = np.argsort(key)
        sa[at], key = p[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at + 1, 0)).astype(U)
        h *= joined
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int, stretch: int = STRETCH) -> np.ndarray:
    """For each place of the suffix array the bytes, depth at most, that its suffix shares with the one before.

    Kasai's walk in text order, where each suffix shares no more than one byte less than the one that starts before it;
    all stretches of the text are walked at once, eight bytes compared at a time.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.concatenate([np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,)).astype(U), np.zeros(depth + 8, U)])
    before = np.full(-(-n // stretch) * stretch, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lane = np.arange(0, n, stretch)
    shared = np.zeros(len(lane), np.int64)
    out = np.zeros((stretch, len(lane)), np.int64)
    for step in range(stretch):
        b = before[step::stretch]
        shared = np.where(b < 0, 0, np.maximum(shared - 1, 0))
        go = np.flatnonzero(b >= 0)
        x, y, s = lane[go] + step, b[go], shared[go]
        while len(go):
            differ = words[x + s] ^ words[y + s]
            more = np.where(differ == 0, 8, (differ.view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1))
            most = np.minimum(depth, n - np.maximum(x, y))
            s = np.minimum(s + more, most)
            shared[go] = s
            on = np.flatnonzero((more == 8) & (s < most))
            go, x, y, s = go[on], x[on], y[on], s[on]
        out[step] = shared
    return out.T.ravel()[:n][sa]


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which of the valid places start a string of `length` bytes that starts at another valid place too."""
    sa = suffix_array(text)
    run = np.cumsum(common_prefixes(text, sa, length) < length) - 1
    ok = valid[sa]
    several = np.bincount(run[ok], minlength=int(run[-1]) + 1 if len(run) else 0) > 1
    out = np.zeros(len(text), bool)
    out[sa[ok]] = several[run[ok]]
    return out


def _rolling(data: np.ndarray) -> list[W.Rolling]:
    return [W.Rolling(W._stream(seed, 256)[data], seed) for seed in SEEDS]


def _scan(docs: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """A row without g2 for each document, with its bytes' number and hash, and one for each segment half.

    In the first kind s is 1 where the row has no id.
    """
    half = (length + gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4, step):
                data, offsets = W.buffers(batch.column(4))
                keys = [np.asarray(batch.column(i)) for i in range(3)]
                shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield _rows(keys, np.asarray(batch.column(3).cast(pa.int32())), np.diff(offsets), shas=shas)
                # a text of more than step bytes: stretches that hold whole windows, so that each window lies in one
                cuts = range(0, max(1, len(data) - length + 1), step) if len(data) > step else (0,)
                for at in cuts:
                    part = data[at : at + step + length - 1] if len(data) > step else data
                    bounds = np.array([0, len(part)]) if len(data) > step else offsets
                    one, two = _rolling(part)
                    for d, s, c, _, g2, h1, h2 in halves(one, two, len(part), bounds, length, gram, half):
                        yield _rows([k[d] for k in keys], s + at, c, g2=g2, h1=h1, h2=h2)

    return docs.mapInArrow(run, "id bigint, t bigint, u bigint, s int, n int, g2 bigint, h1 bigint, h2 bigint, sha string")


def _rows(keys, s, n, shas=None, **hashes) -> pa.RecordBatch:
    m = len(s)
    cols = [pa.array(k, pa.int64()) for k in keys] + [pa.array(np.asarray(x).astype(np.int32)) for x in (s, n)]
    cols += [pa.array(hashes[k].view(np.int64)) if k in hashes else pa.nulls(m, pa.int64()) for k in CLASS]
    return pa.RecordBatch.from_arrays([*cols, pa.array(shas, pa.string()) if shas else pa.nulls(m, pa.string())], names=[*ROW, "s", "n", *CLASS, "sha"])


#: Slices of texts: the run and its shard, the segment's class, which of its two places this is, the place of the first
#: window in its segment, where it lies in the text, the number of windows, and their bytes.
DDL = "g2 bigint, salt int, parts int, h1 bigint, h2 bigint, copy int, at int, s int, n int, piece binary"
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
SLICE = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in DDL.split(", ")])
SPAN = SLICE.names[:-1]


def _slices(texts: DataFrame, length: int) -> DataFrame:
    """Rows of SLICE from (text, spans): the bytes of each span's n windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows, held = [], 0
            for batch in pieces(whole, 0, STEP):
                for text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = (text or "").encode()
                    for x in spans:
                        rows.append((*x.values(), data[x["s"] : x["s"] + x["n"] + length - 1]))
                        held += len(rows[-1][-1])
                        if held > STEP:
                            yield _batch(rows, SLICE)
                            rows, held = [], 0
            if rows:
                yield _batch(rows, SLICE)

    return texts.select("text", "spans").mapInArrow(run, DDL)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: What a sorted shard gives: of each class the spans [lo, hi) that are repeated, from the segment's start (w1 null); and of
#: runs in several shards a row for each different string, with two hashes, its place in its class, and whether it is alone.
FOUND = "g2 bigint, h1 bigint, h2 bigint, lo int, hi int, salt int, parts int, w1 bigint, w2 bigint, alone boolean"


def _shard(rows: list, length: int) -> Iterator[pa.RecordBatch]:
    """Sorts the segments of some runs: rows of FOUND."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    text = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)
    g2, salt, parts, h1, h2, copy, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 3, 4, 5, 8))
    sizes = np.array([len(r[-1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[row] + within
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    hit = repeated_starts(text, valid, length)[starts]

    def batch(r, lo, hi, w1=None, w2=None, alone=None) -> pa.RecordBatch:
        m = len(r)
        cols = [pa.array(x[r]) for x in (g2, h1, h2)] + [pa.array(x.astype(np.int32)) for x in (lo, hi, salt[r], parts[r])]
        cols += [pa.nulls(m, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (w1, w2)]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.bool_()) if alone is None else pa.array(alone)], names=names)

    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    k = hit[first] & (copy[row[first]] == 0)
    yield batch(row[first][k], within[first][k], within[last][k] + length)
    if (parts > 1).any():
        mine = np.flatnonzero((parts[row] > 1) & (copy[row] == 0))
        one, two = (r.at(starts[mine], length) for r in _rolling(text))
        order = np.lexsort((two, one, g2[row[mine]]))
        o, run = mine[order], g2[row[mine[order]]]
        head = np.ones(len(o), bool)
        head[1:] = (run[1:] != run[:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        o, one, two = o[head], one[order][head], two[order][head]
        yield batch(row[o], within[o], within[o] + length, one, two, ~hit[o])


def _sorted(slices: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """FOUND of the slices, those of (g2, salt) being together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= shard_bytes and rows[-1][:2] != row[:2]:
                    yield from _shard(rows, length)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1])
        if rows:
            yield from _shard(rows, length)

    return slices.mapInArrow(run, FOUND)


def _merged(strings: DataFrame, length: int) -> DataFrame:
    """Spans (g2, h1, h2, lo, hi) of strings that start in several shards of one run.

    strings: slices of one window each, copy being 1 where it is alone in its shard, those of (g2, parts) together and
    each shard's in order. One shard after the other is merged into the sorted strings so far.
    """

    def spans(rows: list) -> pa.RecordBatch:
        known, seen = np.zeros(0, f"S{length}"), np.zeros(0, bool)
        edge = [i for i in range(len(rows)) if not i or rows[i][1] != rows[i - 1][1]] + [len(rows)]
        shards = [np.array([r[-1] for r in rows[a:b]], f"S{length}") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for piece in shards:
            at = np.searchsorted(known, piece)
            same = np.zeros(len(piece), bool)
            inside = at < len(known)
            same[inside] = known[at[inside]] == piece[inside]
            seen[at[same]] = True
            known, seen = np.insert(known, at[~same], piece[~same]), np.insert(seen, at[~same], False)
        hit = np.concatenate([seen[np.searchsorted(known, piece)] for piece in shards])
        found = [(r[0], r[3], r[4], r[6], r[6] + length) for r, h in zip(rows, hit.tolist(), strict=True) if h and r[5]]
        return _batch(found, pa.schema([(x, pa.int64()) for x in CLASS] + [("lo", pa.int32()), ("hi", pa.int32())])) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (rows[0][0], rows[0][2]) != (row[0], row[2]):
                    if (out := spans(rows)) is not None:
                        yield out
                    rows = []
                rows.append(row)
        if rows and (out := spans(rows)) is not None:
            yield out

    return strings.mapInArrow(run, "g2 bigint, h1 bigint, h2 bigint, lo int, hi int")


def repeated_bytes(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS, shard_bytes: int = SHARD_BYTES, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) for docs (doc_id, text).

    documents: (id, t, u, none, n_bytes, sha) for each row, see row_keys. spans: (id, t, u, lo, hi), maximal runs of bytes
    covered by strings of `length` bytes that start at some other place too.
    """
    need(docs, "doc_id", "text")
    keyed, n = row_keys(docs), max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(_scan(keyed, length, gram, step), "segments")
    documents = rows.filter("g2 is null").select(*ROW, (F.col("s") == 1).alias("none"), F.col("n").cast("bigint").alias("n_bytes"), "sha")
    level = rows.filter("g2 is not null").drop("sha")
    several = written(level.groupBy("g2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("g2"), "several")
    level = written(level.join(several, "g2", "left_semi"), "level")
    place = F.struct(*ROW, "s", "n")
    classes = written(level.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("a"), F.max(place).alias("b")), "classes")
    runs = classes.groupBy("g2").agg(F.ceil(F.sum(F.least("copies", F.lit(2))) / shard_segments).cast("int").alias("parts"))
    runs = written(runs, "runs")

    def cut(spans: DataFrame, name: str) -> DataFrame:
        """Slices of spans (ROW, x of SPAN), each text being read once."""
        spans = written(spans.groupBy(*ROW).agg(F.collect_list("x").alias("spans")), name)
        return _slices(narrowed(keyed, spans, "id").drop("none").dropDuplicates(ROW).join(spans, ROW), length)

    salted = classes.join(runs, "g2").withColumn("salt", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
    both = F.when(F.col("copies") > 1, F.array("a", "b")).otherwise(F.array("a"))
    picked = salted.select(*CLASS, "salt", "parts", F.posexplode(both).alias("copy", "p")).select("p.*", *CLASS, "salt", "parts", "copy", F.lit(0).alias("at"))
    slices = cut(picked.select(*ROW, F.struct(*SPAN).alias("x")), "picked").repartition(n, "g2", "salt").sortWithinPartitions("g2", "salt")
    found = written(_sorted(slices, length, shard_bytes), "found")
    spans = found.filter("w1 is null").select(*CLASS, "lo", "hi")
    if not runs.filter("parts > 1").isEmpty():
        # only strings whose hashes are in two shards of a run are taken from their texts again and compared
        strings = found.filter("w1 is not null")
        twice = written(strings.groupBy("g2", "w1", "w2").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("alone").alias("_alone")).filter("_n > 1 and _alone").select("g2", "w1", "w2"), "twice")
        strings = written(strings.join(twice, ["g2", "w1", "w2"], "left_semi"), "strings")
        at = strings.join(classes.select(*CLASS, "a"), CLASS)
        part = F.pmod(F.xxhash64("w1", "w2"), F.col("parts")).cast("int")
        at = at.select("a.id", "a.t", "a.u", "g2", "salt", part.alias("parts"), "h1", "h2", F.col("alone").cast("int").alias("copy"), F.col("lo").alias("at"), (F.col("a.s") + F.col("lo")).alias("s"), F.lit(1).alias("n"))
        strings = cut(at.select(*ROW, F.struct(*SPAN).alias("x")), "places").repartition(n, "g2", "parts").sortWithinPartitions("g2", "parts", "salt", "piece")
        spans = written(spans.union(_merged(strings, length)), "decided")
    decided = written(islands(spans, *CLASS), "decided")
    of_place = level.join(decided, CLASS).select(*ROW, (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))
    return documents, islands(of_place, *ROW)


def _cut(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                kept, at, gone = hashlib.sha256(), 0, merged([(x["lo"], x["hi"]) for x in spans])
                for lo, hi in gone:
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                out.append((*key, sum(hi - lo for lo, hi in gone), len(gone), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, (*[pa.int64()] * 5, pa.string()), strict=True)], names=[*ROW, "n_removed", "n_spans", "sha"])

    return docs.mapInArrow(run, "id bigint, t bigint, u bigint, n_removed bigint, n_spans bigint, sha string")


def suffix_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text); options as of repeated_bytes.

    A text is its UTF-8 bytes, null is empty. Each byte is removed that a string of `length` bytes covers which also
    starts anywhere else, in this document or another, judged on the input; matches never cross documents. Rows with
    the same id and text are places of their own, so both lose what they share; ids may be null. n_spans counts
    maximal removed runs. Texts of more than `step` bytes are walked in stretches of it, and whole. An empty table
    gives an empty result; columns besides doc_id and text are ignored.
    """
    documents, spans = repeated_bytes(docs, **options)
    grouped = written(spans.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    cut = _cut(narrowed(row_keys(docs), grouped, "id").drop("none").dropDuplicates(ROW).join(grouped, ROW).select(*ROW, "text", "spans"))
    out = documents.join(cut.withColumnRenamed("sha", "_sha"), ROW, "left")
    return out.select(doc_id(out), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("_sha", "sha").alias("kept_sha256"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes over the whole table."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
