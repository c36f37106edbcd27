"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length 1 whose cosine is at least c are at most epsilon = sqrt(2 - 2 c) apart. They are turned to their
principal axes, and sorted by the cells, of width epsilon, in which their leading coordinates lie. Stretches of this
order are blocks; a pair of blocks is joined only if their bounding boxes, over many axes, are within epsilon, and
inside a task the join halves both stretches again and again, dropping halves that are provably distant, until they
are small enough for a matrix product. Where the coordinates left out are many, boxes rarely are distant; so a leaf first
takes the product over the box's axes alone and adds the product of the norms left, a bound of the cosine, and only
pairs within that bound are compared over all components. Equal vectors are one, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need, table, written
from .components import components

COSINE = 0.9
AXES = 8
BOX_AXES = 16
BLOCK = 4096
SUPER = 32
LEAF = 256
#: Cosines so near to the threshold are computed again, component by component.
NEAR = 1e-9
SLACK = 1e-9


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists of equal lengths as doubles."""
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the unit vectors, the leading one first; the driver gets a few matrices, dim by dim."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0), dim))
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["g"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1) ** 2)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["g"])

    parts = vectors.select("v").mapInArrow(add, "g binary").repartition(8).mapInArrow(sum_up, "g binary").collect()
    total = sum((np.frombuffer(r[0]) for r in parts), np.zeros((dim + 1) ** 2)).reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1].copy()


class _Pair:
    """The join of two stretches of the order: counts links, and gathers edges that connect what is linked."""

    def __init__(self, a, b, same: bool, cosine: float):
        (self.ia, self.ca, self.xa, self.pa), (self.ib, self.cb, self.xb, self.pb) = a, b
        self.ra, self.rb = (np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1))) for p in (self.pa, self.pb))
        self.bounded = self.compared = 0
        self.same, self.cosine, self.limit = same, cosine, 2 - 2 * cosine + SLACK
        self.na, self.la = np.zeros(len(self.ia), np.int64), self.ia.copy()
        self.nb, self.lb = (self.na, self.la) if same else (np.zeros(len(self.ib), np.int64), self.ib.copy())
        self.edges: list[np.ndarray] = []

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and a0 > b0:  # the mirror image of another pair
            return
        p, q = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(0.0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > self.limit:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.leaf(a0, a1, b0, b1)
            return
        for s, e in _halves(a0, a1):
            for u, v in _halves(b0, b1):
                self.join(s, e, u, v)

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        x, y = self.xa[a0:a1], self.xb[b0:b1]
        diagonal = self.same and a0 == b0
        near = self.pa[a0:a1] @ self.pb[b0:b1].T + self.ra[a0:a1, None] * self.rb[None, b0:b1] >= self.cosine - SLACK
        self.bounded += near.size
        if diagonal:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        self.compared += len(i)
        if 8 * len(i) < near.size:
            cos = np.einsum("ij,ij->i", x[i], y[j])
        else:
            cos = (x @ y.T)[i, j]
        for k in np.flatnonzero(np.abs(cos - self.cosine) < NEAR).tolist():
            cos[k] = float((x[i[k]] * y[j[k]]).sum())
        hit = np.zeros(near.shape, bool)
        hit[i, j] = cos >= self.cosine
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows):
            return
        self.na[a0:a1] += hit @ self.cb[b0:b1]
        if not diagonal:
            self.nb[b0:b1] += self.ca[a0:a1] @ hit
        hit = hit[np.ix_(rows, cols)]
        rows, cols = rows + a0, cols + b0
        old_a, old_b = self.la[rows], self.lb[cols]
        new_a, new_b, last = old_a, old_b, None
        most = np.iinfo(np.int64).max
        while last is None or (last != new_a).any():
            last = new_a
            new_b = np.minimum(new_b, np.where(hit, new_a[:, None], most).min(axis=0))
            new_a = np.minimum(new_a, np.where(hit, new_b[None, :], most).min(axis=1))
        edges = np.concatenate([np.stack([old_a, new_a], 1), np.stack([old_b, new_b], 1)])
        edges = edges[edges[:, 0] != edges[:, 1]]
        if len(edges):
            self.edges.append(np.unique(edges, axis=0))
        self.la[rows] = new_a
        self.lb[cols] = np.minimum(new_b, self.lb[cols])


def _halves(lo: int, hi: int) -> list[tuple[int, int]]:
    if hi - lo <= LEAF:
        return [(lo, hi)]
    mid = lo + LEAF * (-(-(hi - lo) // LEAF) // 2)
    return [(lo, mid), (mid, hi)]


def _join(classes: DataFrame, dim: int, kind: str, cosine: float, axes: int, box_axes: int, block: int) -> DataFrame:
    """(kind, a, b): kind 0 has a class and its links to other classes' vectors, kind 1 two connected classes."""
    turn = _axes(classes, dim)[:, : max(axes, box_axes)]
    width = float(np.sqrt(2 - 2 * cosine))
    dtype = np.dtype("<f4" if kind == "float" else "<f8")
    names = [f"c{i}" for i in range(axes)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dim)
                c = np.floor((_unit(x) @ turn)[:, :axes] / width).astype(np.int32)
                data = x.astype(dtype)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in data], pa.binary()), *(pa.array(c[:, i]) for i in range(axes))], names=["cid", "copies", "x", *names])

    def load(ids: bytes, copies: bytes, x: bytes):
        unit = _unit(np.frombuffer(x, dtype).astype(np.float64).reshape(-1, dim))
        return np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8"), unit, (unit @ turn)[:, :box_axes]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, number = [], 0

        def one(rows) -> pa.RecordBatch:
            nonlocal number
            ids, copies, x = np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), b"".join(r[2] for r in rows)
            p = load(ids, copies, x)[3]
            number += 1
            key = (TaskContext.get().partitionId() << 32) + number - 1
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([key // SUPER], pa.int64()), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64())), pa.array([ids]), pa.array([copies]), pa.array([x])], names=["block", "super", "lo", "hi", "ids", "copies", "x"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block:
                yield one(held[:block])
                held = held[block:]
        if held:
            yield one(held)

    spread = classes.select("cid", "copies", "v").mapInArrow(cells, "cid bigint, copies bigint, x binary, " + ", ".join(f"{n} int" for n in names))
    order = [*names, "cid"]
    packed = written(spread.repartitionByRange(*order).sortWithinPartitions(*order).select("cid", "copies", "x").mapInArrow(blocks, "block bigint, super bigint, lo array<double>, hi array<double>, ids binary, copies binary, x binary"), "blocks")

    boxes = packed.select("block", "super", "lo", "hi")
    supers = boxes.groupBy("super").agg(*(f(F.col(side)[i]).alias(f"{side}{i}") for side, f in (("lo", F.min), ("hi", F.max)) for i in range(box_axes)))
    supers = supers.select("super", F.array(*(f"lo{i}" for i in range(box_axes))).alias("lo"), F.array(*(f"hi{i}" for i in range(box_axes))).alias("hi"))
    cell = lambda x, k: F.floor(x[0] / width).cast("int") + k
    left = supers.select(F.col("super").alias("sa"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode(F.sequence(cell(F.col("lo"), 0), cell(F.col("hi"), 0))).alias("cell"))
    right = supers.select(F.col("super").alias("sb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.explode(F.sequence(cell(F.col("lo"), -1), cell(F.col("hi"), 1))).alias("cell"))

    def near(la, ha, lb, hb):
        gaps = F.transform(F.sequence(F.lit(0), F.lit(box_axes - 1)), lambda i: F.greatest(F.lit(0.0), F.get(la, i) - F.get(hb, i), F.get(lb, i) - F.get(ha, i)))
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= 2 - 2 * cosine + SLACK

    wide = left.join(right, "cell").filter(F.col("sa") <= F.col("sb")).filter(near(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"))).select("sa", "sb").distinct()
    a = boxes.select(F.col("block").alias("a"), F.col("super").alias("sa"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = boxes.select(F.col("block").alias("b"), F.col("super").alias("sb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    pairs = written(wide.join(a, "sa").join(b, "sb").filter("a <= b").filter(near(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"))).select("a", "b"), "pairs")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key_a, key_b, *data = (c[k].as_py() for c in batch.columns)
                one = load(*data[:3])
                two = one if key_a == key_b else load(*data[3:])
                pair = _Pair(one, two, key_a == key_b, cosine)
                pair.join(0, len(one[0]), 0, len(two[0]))
                counts = [(pair.ia, pair.na)] if pair.same else [(pair.ia, pair.na), (pair.ib, pair.nb)]
                for ids, n in counts:
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int32)), pa.array(ids[some]), pa.array(n[some])], names=["kind", "a", "b"])
                if pair.edges:
                    edges = np.unique(np.concatenate(pair.edges), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(edges), np.int32)), pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["kind", "a", "b"])

    data = packed.select("block", "ids", "copies", "x")
    both = pairs.join(data.toDF("a", "ids_a", "copies_a", "x_a"), "a").join(data.toDF("b", "ids_b", "copies_b", "x_b"), "b")
    return both.select("a", "b", "ids_a", "copies_a", "x_a", "ids_b", "copies_b", "x_b").mapInArrow(join, "kind int, a bigint, b bigint")


def near_vectors(table: DataFrame, *, cosine: float = COSINE, axes: int = AXES, box_axes: int = BOX_AXES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table (vec_id, embedding).

    A vector links with every other whose cosine is at least `cosine`, above 0, in double precision; n_links counts
    them, equal vectors among them; component_id is the smallest id reachable. Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing, and so do rows with a null id, whose component is null; all
    of these are kept. Vectors of different lengths don't link. Rows with equal ids are vectors of their own. An
    empty table gives an empty result. Other columns are ignored.
    """
    need(table, "vec_id", "embedding")
    kind = table.schema["embedding"].dataType.elementType.typeName()
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).withColumn("v", F.when(sound, F.col("v")))
    rows = written(rows, "vectors")
    usable = rows.filter("v is not null")
    classes = usable.groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    of_row = written(usable.join(classes, "v").select("vec_id", "cid", "copies"), "rows")
    found = None
    for dim in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        part = _join(classes.filter(F.size("v") == dim), dim, kind, cosine, min(axes, dim), min(box_axes, dim), block)
        found = part if found is None else found.union(part)
    rest = rows.filter("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return rest
    found = written(found, "found")
    counts = written(found.filter("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n")), "counts")
    known = written(components(found.filter("kind = 1").select("a", "b")).select(F.col("id").alias("cid"), F.col("component").alias("root")), "known")
    linked = of_row.join(counts, "cid", "left").join(known, "cid", "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("bigint").alias("n_links"), F.coalesce("root", "cid").alias("root"))
    linked = written(linked, "linked")
    least = written(linked.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    out = linked.join(least, "root").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(rest)


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors of the table, whatever their labels, at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
