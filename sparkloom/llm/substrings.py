"""Repeated passages of words, by level-wise doubling.

A window of `length` words that is repeated holds a repeated run of a quarter of that length (its anchor, see
_winnow), and next to it one of half that length. Level by level, runs that are in one document alone are dropped
with all windows around them, and only the others are extended to twice the length, until whole windows are left.
There, segments of windows with equal words count as one, and only where segments differ around a surviving run do
single windows meet.

Of the runs of a level only those are kept that windows are dealt out by: a window's anchor, and the run of twice that
length beside it, which are the same for equal windows wherever they stand. A run that is in one document alone rules
out all windows that it stands for, as it would if every run were kept; a window is ruled out only by its own runs. So
the windows left are those of full doubling, and some more, which the last level compares as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import narrowed, need, table, written
from ._winnow import ROW, doc_id, halves, islands, merged, pieces, row_keys

LENGTH = 50
SEEDS = (0xC0FFEE, 0xF00D)
SPACES = re.compile(rb"[\x20\x09-\x0D]+")
#: Bytes of text whose words are hashed at once; a longer text is walked in stretches of so many.
STEP = 4 << 20


def _rollings(hashes: list[np.ndarray]) -> list[W.Rolling]:
    return [W.Rolling(h, seed) for h, seed in zip(hashes, SEEDS, strict=True)]


def _stretches(texts: pa.Array, length: int, step: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, int]]:
    """(hashes of words, first word of each text, number of words before) of texts from pieces().

    One stretch for many texts; several for a text of more than step bytes, each beginning with the length - 1 words
    before it, so that every window lies in exactly one.
    """
    data, offsets = W.buffers(texts)
    if len(data) <= step:
        starts, ends, first = W.word_bounds(data, offsets)
        yield W.word_hashes(data, starts, ends, SEEDS, lower=False), first, 0
        return
    at, words, carry = 0, 0, [np.zeros(0, W.U)] * len(SEEDS)
    while at < len(data):
        end = min(len(data), at + step)
        while end < len(data) and not W.SPACE[data[end]]:  # to the end of the word
            look = W.SPACE[data[end : end + step]]
            end += int(look.argmax()) if look.any() else len(look)
        starts, ends, _ = W.word_bounds(data[at:end], np.array([0, end - at]))
        run = [np.concatenate(x) for x in zip(carry, W.word_hashes(data[at:end], starts, ends, SEEDS, lower=False), strict=True)]
        yield run, np.array([0, len(run[0])]), words - len(carry[0])
        carry = [x[max(0, len(x) - length + 1) :] for x in run]
        words, at = words + len(starts), end


def _scan(docs: DataFrame, length: int, step: int) -> DataFrame:
    """A row without g1 for each document, with its words' number and hash, and one for each segment half.

    In the first kind s is 1 where the row has no id.
    """
    quarter = -(-length // 4)
    half = min(2 * quarter, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4, step):
                keys = [np.asarray(batch.column(i)) for i in range(3)]
                shas = [hashlib.sha256(SPACES.sub(b" ", (x or "").encode()).strip(b" ")).hexdigest() for x in batch.column(4).to_pylist()]
                words = np.zeros(len(shas), np.int64)
                for hashes, first, before in _stretches(batch.column(4), length, step):
                    words = np.diff(first) + before
                    one, two = _rollings(hashes)
                    for d, s, c, g1, g2, h1, h2 in halves(one, two, len(hashes[0]), first, length, quarter, half):
                        yield _rows([k[d] for k in keys], s + before, c, g1=g1, g2=g2, h1=h1, h2=h2)
                yield _rows(keys, np.asarray(batch.column(3).cast(pa.int32())), words, shas=shas)

    return docs.mapInArrow(run, "id bigint, t bigint, u bigint, s int, n int, g1 bigint, g2 bigint, h1 bigint, h2 bigint, sha string")


def _rows(keys, s, n, shas=None, **hashes) -> pa.RecordBatch:
    m = len(s)
    cols = [pa.array(k, pa.int64()) for k in keys] + [pa.array(np.asarray(x).astype(np.int32)) for x in (s, n)]
    cols += [pa.array(hashes[k].view(np.int64)) if k in hashes else pa.nulls(m, pa.int64()) for k in ("g1", "g2", "h1", "h2")]
    return pa.RecordBatch.from_arrays([*cols, pa.array(shas, pa.string()) if shas else pa.nulls(m, pa.string())], names=[*ROW, "s", "n", "g1", "g2", "h1", "h2", "sha"])


def _windows(reps: DataFrame, length: int, step: int) -> DataFrame:
    """(w1, w2, id, t, u, s) for each window of the spans in (id, t, u, text, spans of (s, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 3, step):
                keys = [np.asarray(batch.column(i)) for i in range(3)]
                spans = batch.column(4)
                lengths = np.diff(np.asarray(spans.offsets))
                flat = spans.flatten()
                s, n = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
                of = np.repeat(np.arange(batch.num_rows), lengths)
                for hashes, first, before in _stretches(batch.column(3), length, step):
                    # the windows of each span that start in this stretch
                    a, b = np.maximum(s, before), np.minimum(s + n, before + (first[1:] - first[:-1])[of] - length + 1)
                    c = np.maximum(b - a, 0)
                    doc = np.repeat(of, c)
                    at = np.repeat(a, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                    one, two = (r.at(first[doc] + at - before, length).view(np.int64) for r in _rollings(hashes))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *(pa.array(k[doc]) for k in keys), pa.array(at.astype(np.int32))], names=["w1", "w2", *ROW, "s"])

    return reps.mapInArrow(run, "w1 bigint, w2 bigint, id bigint, t bigint, u bigint, s int")


def _cut(docs: DataFrame) -> DataFrame:
    """(id, t, u, n_removed, sha) of (id, t, u, text, spans of (lo, hi)): the text's words without those spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                starts, ends, _ = W.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                gone = merged([(x["lo"], x["hi"]) for x in spans])
                kept, any_kept = hashlib.sha256(), False
                for a, b in zip([0, *(hi for _, hi in gone)], [*(lo for lo, _ in gone), len(starts)], strict=True):
                    if a < b:
                        kept.update(b" " * any_kept + SPACES.sub(b" ", data[starts[a] : ends[b - 1]]))
                        any_kept = True
                out.append((*key, sum(hi - lo for lo, hi in gone), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, (*[pa.int64()] * 4, pa.string()), strict=True)], names=[*ROW, "n_removed", "sha"])

    return docs.mapInArrow(run, "id bigint, t bigint, u bigint, n_removed bigint, sha string")


def repeated_words(docs: DataFrame, *, length: int = LENGTH, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) for docs (doc_id, text).

    documents: (id, t, u, none, n_words, sha) for each row, see row_keys; sha is that of all words joined by a space.
    spans: (id, t, u, lo, hi), words lo to hi - 1 of which are covered by windows of `length` words whose sequence also
    starts in a document with a smaller id. Aggregated sides of joins are written first, so that adaptive execution
    can split the rows of a hot run of words.
    """
    need(docs, "doc_id", "text")
    keyed = row_keys(docs)
    rows = written(_scan(keyed, length, step), "segments")
    documents = rows.filter("g1 is null").select(*ROW, (F.col("s") == 1).alias("none"), F.col("n").cast("bigint").alias("n_words"), "sha")
    level = rows.filter("g1 is not null").drop("sha")
    for g in ("g1", "g2"):
        several = written(level.groupBy(g).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a < _b").select(g), "several")
        level = written(level.join(several, g, "left_semi").drop(*(["g1"] if g == "g1" else [])), "level")
    classes = written(level.groupBy("g2", "h1", "h2").agg(F.min("id").alias("least")), "classes")
    marked = written(level.join(classes, ["g2", "h1", "h2"]), "marked")
    whole = marked.filter("least < id").select(*ROW, F.col("s").alias("lo"), (F.col("s") + F.col("n") + (length - 1)).alias("hi"))
    differing = written(classes.groupBy("g2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("g2"), "differing")
    reps = marked.filter("least = id").join(differing, "g2", "left_semi").groupBy(*ROW).agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    reps = written(reps, "reps")
    texts = narrowed(keyed, reps, "id").drop("none").dropDuplicates(ROW).join(reps, ROW).select(*ROW, "text", "spans")
    windows = written(_windows(texts, length, step), "windows")
    earliest = written(windows.groupBy("w1", "w2").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a < _b").select("w1", "w2", "_a"), "earliest")
    single = windows.join(earliest, ["w1", "w2"]).filter("_a < id").select(*ROW, F.col("s").alias("lo"), (F.col("s") + length).alias("hi"))
    return documents, islands(whole.union(single), *ROW)


def substring_dedup(docs: DataFrame, *, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs (doc_id, text).

    Words are runs without the six ASCII white-space characters, unchanged; null and empty texts have none. A word
    is removed if a window of `length` words that covers it has a word sequence that also starts in a document with
    a smaller doc_id, judged on the input. A null doc_id is as large as 2 ** 63 - 1; rows with equal ids are no smaller
    than each other, and each gets its row. Texts of more than `step` bytes are walked in stretches of it, and whole.
    An empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    documents, spans = repeated_words(docs, length=length, step=step)
    grouped = written(spans.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    cut = _cut(narrowed(row_keys(docs), grouped, "id").drop("none").dropDuplicates(ROW).join(grouped, ROW).select(*ROW, "text", "spans"))
    out = documents.join(cut.withColumnRenamed("sha", "_sha"), ROW, "left")
    return out.select(doc_id(out), "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("_sha", "sha").alias("kept_sha256"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of fifty words over the whole table."""
    return substring_dedup(table(spark, sf_dir, "documents"))
