"""Windows dealt out by an anchor inside them, so that equal windows meet without one row for each window.

Of all runs of `gram` items inside a window of `length` items, the one with the least hash (the first of those) is
the window's anchor. It depends on the window's content alone: equal windows have equal anchors at equal places.
Consecutive windows with the same anchor are a segment; there are about two for each length - gram + 2 items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W

U = np.uint64
PLACE = 28
#: The id of rows without one: as large as the largest.
LAST = 2**63 - 1
#: What tells rows apart: the id and two hashes, over the text and whether the id is null.
ROW = ["id", "t", "u"]


def row_keys(docs: DataFrame) -> DataFrame:
    """Columns id, t, u, none and text of (doc_id, text); rows that agree in id, t and u have equal ids and texts."""
    t, u = (F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("text")) for seed in (1, 2))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), t.alias("t"), u.alias("u"), F.col("doc_id").isNull().alias("none"), "text")


def doc_id(row: DataFrame):
    """The id as it was, of rows with columns id and none."""
    return F.when(~row["none"], row["id"]).alias("doc_id")


def pieces(batch: pa.RecordBatch, text: int, step: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `step` bytes of text; a text of more than that is a slice of its own."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step)))
        yield batch.slice(a, b - a)
        a = b


def islands(spans: DataFrame, *keys: str) -> DataFrame:
    """The maximal runs (keys, lo, hi) of places that spans (keys, lo, hi) of a key cover or that touch."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.select(*keys, "lo", "hi", F.when(F.col("lo") <= reach, 0).otherwise(1).alias("_new"))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def segments(rolling: W.Rolling, n_items: int, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, n, anchor) of each segment: windows start to start + n - 1 lie in the document.

    Items first[i] to first[i + 1] - 1 are document i's; a batch has less than 2 ** 28 items.
    """
    none = np.zeros(0, np.int64)
    if n_items < length or n_items >= 1 << PLACE:
        if n_items >= 1 << PLACE:
            raise ValueError("a batch of texts is too large")
        return none, none, none, none
    at = np.arange(n_items - gram + 1)
    keys = (rolling.at(at, gram) >> U(PLACE) << U(PLACE)) | at.astype(U)
    anchors = (W.window_minimum(keys, length - gram + 1) & U((1 << PLACE) - 1)).astype(np.int64)
    valid = np.zeros(n_items + 1, np.int32)
    whole = np.flatnonzero(first[1:] - first[:-1] >= length)
    np.add.at(valid, first[:-1][whole], 1)
    np.add.at(valid, first[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(starts):
        return none, none, none, none
    documents = np.searchsorted(first, starts, side="right") - 1
    a = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (documents[1:] != documents[:-1])
    head = np.flatnonzero(new)
    return documents[head], starts[head], np.diff(np.append(head, len(starts))), a[head]


def halves(one: W.Rolling, two: W.Rolling, n_items: int, first: np.ndarray, length: int, gram: int, half: int):
    """The segments, each cut where its windows stop to hold the run of `half` items from the anchor on.

    Windows before the cut hold the run of that length which ends with the anchor. Gives for each of the two kinds
    (document, start, n, g1, g2, h1, h2): the hashes of the anchor, of that run, and two of all the windows' items.
    """
    doc, start, count, anchor = segments(one, n_items, first, length, gram)
    split = np.clip(anchor - (length - half) - start, 0, count)
    for late in (True, False):
        s, c = (start, split) if late else (start + split, count - split)
        ok = np.flatnonzero(c > 0)
        d, s, c, p = doc[ok], s[ok], c[ok], anchor[ok]
        with np.errstate(over="ignore"):
            shape = (c.astype(U) << U(32)) | ((p - s).astype(U) << U(1)) | U(late)
            h1, h2 = (r.at(s, c + length - 1) ^ W._mix(shape + U(r.seed)) for r in (one, two))
            g2 = one.at(p + gram - half if late else p, half) ^ U(0x5851F42D4C957F2D if late else 0)
        yield d, s - first[d], c, one.at(p, gram), g2, h1, h2


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint, not touching spans with the same points."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out
