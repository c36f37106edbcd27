"""Near-duplicate documents by HyperMinHash.

A document's shingles are dealt over REGISTERS buckets by their hash; a bucket keeps only the least remaining hash,
as its number of leading zeros and the MANTISSA bits behind the first one. An empty bucket borrows from the first
full one of a fixed order of its own (two sets agree on a borrowed register as often as on an own one). ROWS
registers make a band; documents that agree on a band may be linked. Pairs are put aside if the Jaccard estimate
from all registers, corrected for the registers that agree by chance, is far below the threshold; the others are
confirmed on the full shingle sets.

Documents with equal sets are one node. Within a bucket of a band, nodes are first compared with the least node only.
Then, in buckets that hold several components, nodes of different components are compared by their registers, block by
block inside tasks; a pair inside one component could add nothing. So no link between components is left out, and
neither all pairs of a bucket nor a whole bucket are ever held or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import narrowed, need, table, written
from .components import components

U = np.uint64
SHINGLE = 5
NUM, DEN = 4, 5
REGISTERS = 512
ROWS = 5
BANDS = 32
BLOCK = 1024
PROBES = 64
MANTISSA = 10
#: Standard deviations of the estimate by which a pair may fall short of the threshold before it is put aside.
SLACK = 5.0


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle of them all."""
    data, offsets = W.buffers(texts)
    starts, ends, first = W.word_bounds(data, offsets)
    (hashes,) = W.word_hashes(data, starts, ends, (0xA11CE,), lower=True)
    out = []
    if not len(hashes):
        return [np.zeros(0, U)] * (len(offsets) - 1)
    rolling = W.Rolling(hashes, 0xB0B)
    full = rolling.at(np.arange(max(0, len(hashes) - size + 1)), size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(rolling.at(np.array([a]), np.array([b - a])))
        else:
            out.append(np.zeros(0, U))
    return out


def _orders(k: int) -> np.ndarray:
    """For each register the order in which it looks for a full one; itself first."""
    rng = np.random.Generator(np.random.PCG64(20))
    out = np.stack([rng.permutation(k) for _ in range(k)])
    for i in range(k):
        j = int(np.flatnonzero(out[i] == i)[0])
        out[i, [0, j]] = out[i, [j, 0]]
    return out


def registers_of(hashes: np.ndarray, orders: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """The registers of a set that isn't empty, as leading zeros * 2 ** mantissa + mantissa bits."""
    k = len(orders)
    high = (hashes >> U(32)) * U(k)
    rest = (high << U(32)) | (hashes & U(0xFFFFFFFF))
    least = np.full(k, np.iinfo(U).max, U)
    np.minimum.at(least, (high >> U(32)).astype(np.int64), rest)
    used = np.zeros(k, bool)
    used[(high >> U(32)).astype(np.int64)] = True
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(least >> U(11), U(1)).astype(np.float64))).astype(np.int64) - 11, 63 - mantissa)
    bits = ((least << (zeros + 1).astype(U)) >> U(64 - mantissa)).astype(np.int64)
    out = ((zeros << mantissa) | bits).astype(np.uint16)
    if used.all():
        return out
    found = used[orders[:, :PROBES]]
    place = orders[np.arange(k), found.argmax(axis=1)]
    for i in np.flatnonzero(~found.any(axis=1)).tolist():
        place[i] = orders[i, used[orders[i]].argmax()]
    return out[place]


def chance(n: np.ndarray, m: np.ndarray, k: int, mantissa: int = MANTISSA) -> np.ndarray:
    """The probability that the registers of unrelated sets of n and m elements agree."""
    level = 2.0 ** -np.arange(0, 50)

    def share(x):
        full = np.maximum(x / k, 1.0)[:, None]
        return (1 - level[1:]) ** full - np.where(level[:-1] < 1, (1 - level[:-1]) ** full, 0.0)

    return (share(np.asarray(n, float)) * share(np.asarray(m, float))).sum(axis=1) / 2**mantissa


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows a and b, corrected for chance agreement."""
    k = a.shape[1]
    c = chance(n, m, k)
    return np.clip(((a == b).mean(axis=1) - c) / (1 - c), 0.0, 1.0)


def sketches(docs: DataFrame, size: int = SHINGLE, k: int = REGISTERS) -> DataFrame:
    """(id, n, s1, s2, registers) of (doc_id, text): the set's size, two hashes of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1), size)
                with np.errstate(over="ignore"):
                    s1, s2 = (np.array([W._mix(s ^ U(seed)).sum() for s in sets], U).view(np.int64) for seed in (0x1234567, 0x89ABCDEF012))
                regs = [registers_of(s, orders).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array(regs, pa.binary())], names=["id", "n", "s1", "s2", "registers"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, registers binary")


def band_keys(regs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """For each row of registers the hashes of its bands, their numbers included."""
    with np.errstate(over="ignore"):
        keys = np.tile(W._stream(77, bands), (len(regs), 1))
        for i in range(rows):
            keys = W._mix(keys * U(0x9E3779B97F4A7C15) + regs[:, i : bands * rows : rows].astype(U))
    return keys.view(np.int64)


def bands_of(reps: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, id): for each band of registers a hash of its number and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = band_keys(regs, rows, bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), bands))], names=["key", "id"])

    return reps.select("id", "registers").mapInArrow(run, "key bigint, id bigint")


def likely(pairs: DataFrame, reps: DataFrame, num: int, den: int, slack: float = SLACK) -> DataFrame:
    """The pairs (a, b) whose estimate isn't far below num / den."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").filter((den * F.least("na", "nb") >= num * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
            j = num / den
            ok = estimate(a, b, np.asarray(batch.column(2)), np.asarray(batch.column(3))) >= j - slack * np.sqrt(j * (1 - j) / a.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet den * intersection >= num * union; texts: (id, text)."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y in zip(shingle_sets(part.column(2), size), shingle_sets(part.column(3), size), strict=True):
                    same = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(den * same >= num * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def across(members: DataFrame, reps: DataFrame, num: int, den: int, per_band: int = ROWS, bands: int = BANDS, block: int = BLOCK, slack: float = SLACK) -> DataFrame:
    """Likely pairs (a, b) of different components in a bucket; members: (key, id, c).

    A bucket's largest component is never compared with itself; the others' blocks meet it and each other. A pair that
    shares several buckets is given by the bucket of its first common band alone.
    """
    sizes = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max_by("c", F.struct("_n", "c")).alias("main"), F.max("_n").alias("_main"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_cs"))
    sizes = written(sizes.filter("_cs > 1").select("key", "main", F.ceil(F.col("_main") / block).cast("int").alias("gs"), F.ceil((F.col("_all") - F.col("_main")) / block).cast("int").alias("os")), "sizes")
    rows = members.join(sizes, "key").withColumn("is_main", F.col("c") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("gs")).otherwise(F.col("os"))).cast("int"))
    others, mains = (F.sequence(F.lit(0), F.col(n) - 1) for n in ("os", "gs"))
    task = lambda i, j, m, left: F.struct(i.alias("i"), j.alias("j"), m.alias("m"), left.alias("left"))
    of_main = F.transform(others, lambda i: task(i, F.col("own"), F.lit(True), F.lit(False)))
    of_other = F.concat(F.transform(others, lambda j: task(F.least("own", j), F.greatest("own", j), F.lit(False), F.col("own") <= j)), F.transform(mains, lambda j: task(F.col("own"), j, F.lit(True), F.lit(True))))
    dealt = rows.select("key", "id", "c", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("t")).select("key", "t.*", "id", "c")
    dealt = dealt.join(reps, "id").select("key", "m", "i", "j", "left", "id", "c", "n", "registers")
    width = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(width, "key", "m", "i", "j").sortWithinPartitions("key", "m", "i", "j")

    def compare(rows: list) -> pa.RecordBatch:
        alone = not rows[0][1] and rows[0][2] == rows[0][3]
        left = rows if alone else [r for r in rows if r[4]]
        right = rows if alone else [r for r in rows if not r[4]]
        out = [np.zeros((2, 0), np.int64)]
        if left and right:
            ids, cs, ns = (np.array([r[k] for r in right], np.int64) for k in (5, 6, 7))
            regs = np.frombuffer(b"".join(r[8] for r in right), np.uint16).reshape(len(right), -1)
            j = num / den
            least = j - slack * np.sqrt(j * (1 - j) / regs.shape[1])
            for r in left:
                some = np.flatnonzero((cs != r[6]) & (den * np.minimum(ns, r[7]) >= num * np.maximum(ns, r[7])))
                if len(some):
                    own = np.frombuffer(r[8], np.uint16)[None, :]
                    # an eighth of the registers tells most unlike pairs
                    rough = (regs[some, ::8] == own[:, ::8]).mean(axis=1)
                    some = some[rough >= j - slack * np.sqrt(j * (1 - j) * 8 / regs.shape[1])]
                if len(some):
                    some = some[estimate(regs[some], own, ns[some], np.full(len(some), r[7])) >= least]
                if len(some):
                    common = (regs[some] == own)[:, : per_band * bands].reshape(len(some), bands, per_band).all(axis=2)
                    some = some[band_keys(own, per_band, bands)[0][common.argmax(axis=1)] == r[0]]
                    out.append(np.stack([np.minimum(ids[some], r[5]), np.maximum(ids[some], r[5])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:4] != row[:4]:
                    yield compare(held)
                    held = []
                held.append(row)
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, num: int = NUM, den: int = DEN, k: int = REGISTERS, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Words are runs without the six ASCII white-space characters, with A to Z lowered; a text's set is its distinct
    shingles of `size` words, or its whole sequence if it has fewer; null and texts without words have an empty set
    and link with nothing. Documents link if den * |intersection| >= num * |union|; component_id is the smallest id
    reachable and kept marks it. Rows with the same id are one document for links, and each gets its row. A row with a
    null id links with nothing, has a null component and is kept. Any order and repeated rows give the same result. Texts
    are whole, however long. An empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    need(docs, "doc_id", "text")
    sketch = written(sketches(docs, size, k), "sketches")
    usable = sketch.filter("n > 0 and id is not null")
    classes = written(usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = usable.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n", "registers")
    every = written(bands_of(reps, rows, bands).distinct(), "bands")
    shared = written(every.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "least"), "shared")
    inside = written(every.join(shared, "key").select("key", "id", "least"), "inside")
    busy = written(inside.select("id").distinct(), "busy")
    reps = written(reps.join(busy, "id", "left_semi"), "reps")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    texts = written(narrowed(texts, busy, "id").join(busy, "id", "left_semi"), "texts")
    star = written(inside.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "star")
    first = likely(star, reps, num, den)
    links = written(confirmed(first, texts, size, num, den), "links")
    known = written(components(links), "components")
    members = inside.select("key", "id").join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    members = written(members, "members")
    more = written(confirmed(across(members, reps, num, den, rows, bands, block), texts, size, num, den), "links")
    if not more.isEmpty():
        known = written(components(links.union(more)), "components")
    of_rep = classes.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    out = sketch.alias("d").join(of_rep.alias("c"), (F.col("d.s1") == F.col("c.s1")) & (F.col("d.s2") == F.col("c.s2")) & (F.col("d.n") == F.col("c.n")), "left")
    component = F.when(F.col("d.id").isNull(), None).otherwise(F.coalesce(F.col("c.component"), F.col("d.id")))
    return out.select(F.col("d.id").alias("id"), F.col("d.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("d.id") == component, F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Shingles of four words, linked at 100 * intersection >= 80 * union."""
    out = near_duplicates(table(spark, sf_dir, "documents"), size=4, num=80, den=100)
    return out.withColumnRenamed("id", "doc_id")
