"""The registered corpus queries against DuckDB where SQL can express them, and the pipeline's stages."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkloom.llm import decontaminate, mixing, quality
from sparkloom.llm.queries import QUERIES, SQL
from test_corpus_ops import brute_near, prose


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, name):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    df = QUERIES[name](spark, small)
    cursor = c.execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([x[0] for x in cursor.description], cursor.fetchall())


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, columns = docs, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        out = stage(spark, kept, small)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before, name
        if i < 4:
            assert out.columns == columns, name
            path = corpus_pipeline.scratch(spark, name)
            out.write.parquet(path)
            kept = spark.read.parquet(path)
    final = out.orderBy("start").collect()
    assert [r["doc_id"] for r in final] == sorted(r["doc_id"] for r in final) and len(final) == kept.count()


def plain_mix(rows):
    """The ids that the mixing stage keeps of (id, text, lang, source), by dictionaries and loops."""
    words = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, _, _ in rows}
    cell, n = {}, collections.Counter()
    for i, t, lang, source in rows:
        marks = next((k for k, m in mixing.MARKS.items() if words[i] and sum((t or "").count(c) for c in m) >= 0.1 * words[i]), None)
        digits = words[i] and sum(c in "0123456789" for c in t) >= 0.1 * len(t)
        cell[i] = (source or "(null)", lang or "(null)", marks or ("numbers" if digits else "prose"))
        n[cell[i]] += words[i]
    whole, share = sum(n.values()), []
    for k, stated in enumerate((None, mixing.LANG_SHARE, mixing.TOPIC_SHARE)):
        own = collections.Counter()
        for c, x in n.items():
            own[c[k]] += x
        own = {v: x for v, x in own.items() if x}
        if stated is None:
            power = {v: x**corpus_pipeline.POWER for v, x in own.items()}
            share.append({v: x / sum(power.values()) for v, x in power.items()})
        else:
            free = sum(x for v, x in own.items() if v not in stated) / whole
            total = sum(stated[v] for v in own if v in stated)
            share.append({v: stated[v] / total * (1 - free) if v in stated else x / whole for v, x in own.items()})
    cap = {c: float(x) for c, x in n.items() if x and all(share[k].get(c[k], 0) > 0 for k in range(3))}
    size, target = min(corpus_pipeline.KEEP * whole, sum(cap.values())), []
    for k in range(3):
        supply = collections.Counter()
        for c, x in cap.items():
            supply[c[k]] += x
        full: set = set()
        while True:
            level = (size - sum(supply[v] for v in full)) / max(sum(share[k][v] for v in supply if v not in full), 1e-300)
            more = {v for v in supply if v not in full and level * share[k][v] > supply[v]}
            if not more:
                break
            full |= more
        target.append({v: supply[v] if v in full else level * share[k][v] for v in supply})
    take = {c: corpus_pipeline.KEEP * x for c, x in cap.items()}
    for _ in range(mixing.PASSES):
        for k in range(3):
            for v, want in target[k].items():
                mine = [c for c in take if c[k] == v]
                total, held = sum(take[c] for c in mine), [c for c in mine if take[c] >= cap[c] * (1 - 1e-12)]
                full = sum(take[c] for c in held)
                for c in mine:
                    if total >= want:
                        take[c] *= want / total
                    elif c not in held:
                        take[c] = min(cap[c], take[c] * (want - full) / (total - full))
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
    return [i for i, *_ in rows if words[i] and draw(i) < take.get(cell[i], 0.0) / n[cell[i]]]


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """run() on a small corpus with copies, near copies, benchmark passages, junk, nulls and languages of no stated share."""
    import public_tokenizers
    from tokenizers import Tokenizer

    r = np.random.default_rng(1)
    passage = prose(40, 900)
    rows = [[i, prose(int(r.integers(30, 160)), i), ["en", "de", "fr", "es", "it", None][i % 6], f"s{i % 4}"] for i in range(150)]
    for i in range(120, 135):
        rows[i][1] = " ".join(f"w{x}$$$" for x in range(i % 9 + 20))
    for i in (30, 31, 75):
        rows[i][1] = rows[5][1]
    for i, at in ((40, 7), (41, 9), (42, 41)):
        words = rows[at][1].split()
        words[len(words) // 2] = "changed"
        rows[i][1] = " ".join(words)
    for i in (60, 61):
        rows[i][1] += " " + passage
    rows[100][1], rows[101][1], rows[102][3] = None, "", None
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 120 <= i < 135 else 1, 0) for i in range(20, 140)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, prose(30, 901))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    text = {i: t for i, t, *_ in rows}
    learned = sorted((i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5)
    model = quality.fit(quality.features_of(pa.array([text[i] for i, _ in learned])), np.array([y for _, y in learned], float))
    scores = model.score(quality.features_of(pa.array([t for _, t, *_ in rows], pa.string())))
    left = [x for x, s in zip(rows, scores, strict=True) if s >= 0.3]
    near = brute_near([(i, t) for i, t, *_ in left], 5, 4, 5)
    unique = [x for x in left if near[x[0]][1] == x[0]]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").encode().lower())
    windows = {tuple(w[j : j + 13]) for w in (cut(passage), cut(prose(30, 901))) for j in range(len(w) - 12)}
    clean = []
    for x in unique:
        w = cut(x[1])
        hit = {k for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for k in range(j, j + 13)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(x)
    kept = sorted(plain_mix([tuple(x) for x in clean]))
    library, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in kept:
        ids = np.array([*library.encode(text[i] or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert len(rows) > len(left) > len(unique) > len(clean) > len(kept) > 60 and 100 <= len(left) < 146
    assert decontaminate.SIZE == 13


def test_pipeline_stages_on_odd_tables(spark, small):
    """Every stage: an empty table, null columns, repeated rows, and columns under the names that operators add."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _score string, _id string, _p string, _k1 string, n_hit string, `a.b` string"
    tail = ("s", "i", "p", "k", "h", "x")
    rows = [(1, prose(50, 1), "en", "s", 1, *tail), (1, prose(50, 1), "en", "s", 1, *tail), (None, None, None, None, None, *tail), (None, "", None, "s", 0, *tail), (2, "x" * 100_000, "xx", None, 0, *tail)]
    odd = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert set(kept) <= set(rows) and all(r[5:] == tail for r in kept), name
        assert stage(spark, odd.limit(0), small).count() == 0, name
    assert {r[0] for r in corpus_pipeline.minhash_dedup(spark, odd, small).collect()} == {1, 2, None}
    assert corpus_pipeline.token_records(spark, odd, small).count() == 5 and corpus_pipeline.token_records(spark, odd.limit(0), small).count() == 0
