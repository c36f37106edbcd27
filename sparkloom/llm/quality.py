"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a table of values, one for each of its bins; chosen pairs of features have tables of two
dimensions. The tables are learned by boosting: round after round, feature after feature, a shallow tree over the
feature's bins is fitted to the gradient and added, a little of it, to the table. A score is a sum of looked-up
values. The model is fitted on a sample of at most MAX_ROWS labelled rows; scoring reads every whole text once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._common import col, need, table

FOLDS = 5
MAX_ROWS = 40_000
THRESHOLD = 0.3
BINS = 48
PAIR_BINS = 12
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15
RIDGE = 4.0
FEATURES = ("log_words", "word_bytes", "word_spread", "distinct", "repeat", "top_word", "upper", "lower", "digit", "blank", "line", "stop", "bang", "bar", "symbol", "other_mark", "control", "high", "entropy", "upper_words", "short_words", "line_bytes")

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "symbol": b"$%&*#@^~=+<>", "other_mark": b"/\\[]_`{}", "control": [*range(9), 11, 12, *range(14, 32), 127], "high": range(128, 256)}


def features_of(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; a null or empty text has zeros."""
    data, offsets = W.buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    starts, ends, first = W.word_bounds(data, offsets)
    (hashes,) = W.word_hashes(data, starts, ends, (0xFEED,), lower=True)
    sizes = ends - starts
    kinds = np.zeros((256, len(_KINDS)))
    for k, members in enumerate(_KINDS.values()):
        kinds[list(members), k] = 1
    counts = np.zeros((n, 256))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            counts[i] = np.bincount(data[a:b], minlength=256)
    total = np.maximum(counts.sum(axis=1), 1.0)
    share = counts / total[:, None]
    column = {name: i for i, name in enumerate(FEATURES)}
    kind_counts = counts @ kinds
    for k, name in enumerate(_KINDS):
        out[:, column[name]] = kind_counts[:, k] / total
    out[:, column["entropy"]] = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    out[:, column["line_bytes"]] = np.log1p(total / (kind_counts[:, list(_KINDS).index("line")] + 1)) * (counts.sum(axis=1) > 0)
    head_upper = (data[starts] >= 65) & (data[starts] <= 90) & (data[np.maximum(ends - 1, starts)] != 0)
    second = np.minimum(starts + 1, len(data) - 1)
    shout = head_upper & (sizes > 2) & (data[second] >= 65) & (data[second] <= 90) if len(starts) else head_upper
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        m = b - a
        if not m:
            continue
        runs = np.sort(hashes[a:b])
        new = np.flatnonzero(runs[1:] != runs[:-1])
        most = int(np.diff(np.concatenate([[-1], new, [m - 1]])).max())
        s = sizes[a:b]
        out[i, [column[x] for x in ("log_words", "word_bytes", "word_spread", "distinct", "repeat", "top_word", "upper_words", "short_words")]] = (np.log1p(m), s.mean(), s.std(), (len(new) + 1) / m, same[a + 1 : b].sum() / m, most / m, shout[a:b].sum() / m, (s <= 3).sum() / m)
    return out


@dataclass
class Model:
    """edges: each feature's inner bin edges. tables: each feature's values. pairs: (i, j, edges i, edges j, values)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, ei, ej, t in self.pairs:
            total += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges between quantiles; middles between neighbouring values, so that no value lies on an edge."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    cut = np.unique(np.searchsorted(values, np.quantile(x, np.arange(1, bins) / bins)))
    cut = cut[(cut > 0) & (cut < len(values))]
    return np.unique((values[cut] + values[cut - 1]) / 2)


def _stump(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The values of a tree of this depth over ordered bins with gradients g and weights h."""
    value = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            value = np.concatenate([_stump(g[:k], h[:k], depth - 1), _stump(g[k:], h[k:], depth - 1)])
    return value


def _cross(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree over two ordered dimensions: one split of the first, then one of the second on each side."""
    best, value = -1.0, None
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for k in range(1, gg.shape[0]):
            parts = [_stump(gg[a:b].sum(axis=0), hh[a:b].sum(axis=0), 1) for a, b in ((0, k), (k, gg.shape[0]))]
            rows = np.concatenate([np.tile(p, (m, 1)) for p, m in zip(parts, (k, gg.shape[0] - k), strict=True)])
            gain = float((rows * gg).sum())
            if gain > best:
                best, value = gain, rows.T if flip else rows
    return np.zeros_like(g) if value is None else value


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Model:
    """A model of the probability that y is 1. Without rows, or with one class only, it scores near the class's share."""
    n = len(y)
    p = (y.sum() + 1.0) / (n + 2.0)
    width = x.shape[1]
    model = Model(float(np.log(p / (1 - p))), [_edges(x[:, j], bins) if n else np.zeros(0) for j in range(width)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(n, model.base)

    def slopes():
        q = 1.0 / (1.0 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j in range(width):
            m = len(model.tables[j])
            if m < 2:
                continue
            g, h = slopes()
            step = rate * _stump(np.bincount(at[j], g, m), np.bincount(at[j], h, m), 2)
            step = np.clip(step, -1, 1)
            model.tables[j] += step
            total += step[at[j]]
    g, h = slopes()
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    found = []
    for i, j in itertools.combinations(range(width), 2):
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        if a > 1 and b > 1:
            k = cell[i] * b + cell[j]
            gs, hs = np.bincount(k, g, a * b).reshape(a, b), np.bincount(k, h, a * b).reshape(a, b)
            found.append((float((_cross(gs, hs) * gs).sum()), i, j))
    found = sorted(found, reverse=True)[:pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in found]
    for _ in range(pair_rounds):
        for i, j, _, _, t in model.pairs:
            g, h = slopes()
            k = cell[i] * t.shape[1] + cell[j]
            step = np.clip(rate * _cross(np.bincount(k, g, t.size).reshape(t.shape), np.bincount(k, h, t.size).reshape(t.shape)), -1, 1)
            t += step
            total += step.ravel()[k]
    return model


def held_out(doc_id, folds: int = FOLDS):
    """Whether the CRC-32 of the id as text is a multiple of folds; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Model:
    """Fits the model on the labelled documents that aren't held out, the max_rows of them with the least id hashes.

    Null labels and ids don't count; an id with several labels has the label that most of them give, 1 if it is even. Of rows
    that share an id the one with the least text hash is learned from, so the driver gets at most max_rows rows of features.
    Null and empty texts have features like others. Without labelled rows, or with one class only, every text scores
    near that class's share (0.5 without any). Other columns are ignored.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", label)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(~held_out(F.col("doc_id"), folds))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_t"), "text").join(F.broadcast(known), "_id").select("_id", "_y", "_t", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([r.astype("<f8").tobytes() for r in features_of(part.column(3))], pa.binary())], names=["id", "y", "t", "x"])

    one = rows.mapInArrow(run, "id bigint, y int, t bigint, x binary").groupBy("id", "y").agg(F.min_by("x", F.struct("t", "x")).alias("x"))
    got = sorted(one.collect(), key=lambda r: r[0])
    x = np.frombuffer(b"".join(bytes(r[2]) for r in got), "<f8").reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column _score, in [0, 1]; null and empty texts have one too, equal texts equal ones.

    Texts are read whole, however long. Repeated rows each have theirs; an empty table gives an empty result. A column
    _score that docs had is replaced; other columns pass through.
    """
    need(docs, "text")
    docs = docs.select(*(col(c) for c in docs.columns if c.lower() != "_score"))
    columns = docs.columns
    at = columns.index("text")
    plain = [f"c{i}" for i in range(len(columns))]  # Spark doesn't pass names with dots to Arrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features_of(part.column(at))))], names=[*plain, "_score"])

    rows = docs.toDF(*plain)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())])).toDF(*columns, "_score")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores every whole text; learns from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features_of(part.column(1))))], names=["doc_id", "score"])

    scored = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
