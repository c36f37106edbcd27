"""The corpus operators against brute force, exact round trips, and odd rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, embeddings, minhash, mixing, quality, substrings, suffixes, tokens, warc
from sparkloom.llm import _words as W
from sparkloom.llm._common import scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def prose(n, seed=0, size=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, size, n))


def documents(spark):
    """Copies, near copies, shared passages, repeated rows, nulls, empty, long and odd texts; a clashing extra column."""
    base, passage = prose(300, 1), prose(90, 2)
    near = base.split()
    near[100] = "changed"
    texts = [base, base, " ".join(near), base.upper(), passage + " " + prose(40, 3), prose(40, 4) + "\n" + passage, None, "", "  \n ", "one two", "One  TWO", "x" * 3000, prose(30, 5) + " " + passage[:200], prose(4000, 6), "é " * 120 + prose(70, 7), "é " * 120 + prose(70, 7) + " tail"]
    rows = [(i + 1, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, "en", "s0", 1, None), (None, None, None, None, None, None), (2**63 - 1, base, "en", "s0", 1, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words_of(text, lower=False):
    b = (text or "").encode()
    return WORD.findall(b.translate(bytes(x + 32 if lower and 65 <= x <= 90 else x for x in range(256))))


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["Hello  World\tfoo", None, "", "  ", "a", "\nÀb c\x1cd ", "x" * 5000 + " y"]
    data, offsets = W.buffers(pa.array(texts))
    s, e, f = W.word_bounds(data, offsets)
    assert [[bytes(data[a:b]) for a, b in zip(s[f[i] : f[i + 1]], e[f[i] : f[i + 1]], strict=True)] for i in range(len(texts))] == [words_of(t) for t in texts]
    values = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    assert all(m == values[i : i + 37].min() for i, m in enumerate(W.window_minimum(values, 37)))


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ b\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (7, "u", "<p>" + "é" * 40000), (None, "u", "same"), (3, None, "same")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, payload string").repartition(2)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    for split in (64, 1 << 20):
        got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_warc(manifest, split=split).collect())
        digest = lambda t: warc.base32_of(hashlib.sha1((t or "").encode()).hexdigest())
        expected = [(3, "response", None), (3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3)]
        assert got == collections.Counter([(p, k, x, 4, digest("same")) for p, k, x in expected] + [(1, "response", None, 0, digest("")), (2, "revisit", 1, 0, digest("")), (7, "response", None, 80003, digest(rows[5][2]))])
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")).count() == 0
    with pytest.raises(ValueError, match="missing"):
        warc.write_warc(pages.drop("html"), "file:///nowhere")


def test_magic_inside_a_payload_is_no_record(tmp_path):
    fake = warc.MAGIC * 50 + b"\x1f\x8b\x08\x00" + b"abc"
    data = warc.record(1, "u", fake, "D", None, False) + warc.record(2, "u", b"x", "D", None, False)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with path.open("rb") as f:
        found = [r for a in range(0, len(data), 7) for r in warc.records_in(warc._Window(f, len(data)), a, min(a + 7, len(data)))]
    assert [c for _, _, c in found] == [fake, b"x"]


def test_a_record_with_a_long_header_is_read(spark, tmp_path):
    url = "data:," + "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000))
    pages = spark.createDataFrame([(1, "u", "a"), (2, url, "b"), (3, "v", "c")], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    for split in (50_000, 1 << 20):
        assert sorted((r["page_id"], r["url"]) for r in warc.read_warc(manifest, split=split).collect()) == [(1, "u"), (2, url), (3, "v")]
    with pytest.raises(ValueError, match="3 records were found and 4 written"):
        warc.read_warc(manifest.withColumn("records", F.col("records") + 1))


def test_mixing_fits_the_margins(spark):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 4), "en" if i % 3 else "de", f"s{i % 2}") for i in range(400)], "doc_id bigint, text string, lang string, source string")
    out = mixing.mix(docs, lang_share={"en": 0.5, "de": 0.5}, keep=0.3).cache()
    cells = out.select("_source", "_lang", "_topic", "_share").distinct().collect()
    assert sum(r["_share"] for r in cells if r["_lang"] == "de") == pytest.approx(0.5, abs=1e-6)
    kept = out.filter("_sampled").agg(F.sum("_tokens")).first()[0] / out.agg(F.sum("_tokens")).first()[0]
    assert kept == pytest.approx(0.3, abs=0.08)
    odd = documents(spark)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd).filter("_sampled and _tokens = 0").count() == 0


def test_mixing_gives_the_surplus_of_full_cells_to_others(spark):
    # tokens of the cells (source, lang); 16,800 are wanted
    sizes = {("a", "en"): 9000, ("a", "de"): 500, ("b", "en"): 6000, ("b", "de"): 4500, ("b", "es"): 700, ("a", "es"): 300}
    rows = [(i, "w " * 100, lang, source) for i, (source, lang) in enumerate(k for k, n in sizes.items() for _ in range(n // 100))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = mixing.mix(docs, lang_share={"en": 0.68, "de": 0.2, "es": 0.12}, topic_share={"prose": 1.0}, power=1.0, keep=0.8)
    cells = {(r["_source"], r["_lang"]): r for r in out.select("_source", "_lang", "_share", "_p").distinct().collect()}
    taken = {k: cells[k]["_p"] * n for k, n in sizes.items()}
    whole = 0.8 * 21000
    by = lambda i, v: sum(t for k, t in taken.items() if k[i] == v)
    assert max(r["_p"] for r in cells.values()) <= 1 and sum(taken.values()) == pytest.approx(whole, rel=3e-4)
    assert by(1, "es") == pytest.approx(1000, rel=1e-3)  # wants 2,016, holds 1,000: taken whole
    assert by(1, "en") == pytest.approx((whole - 1000) * 0.68 / 0.88, rel=1e-3)
    assert by(1, "de") == pytest.approx((whole - 1000) * 0.2 / 0.88, rel=1e-3)
    assert by(0, "a") == pytest.approx(whole * 9800 / 21000, rel=1e-3)
    margins = mixing.margins_of(mixing.fit(docs, lang_share={"en": 0.68, "de": 0.2, "es": 0.12}, topic_share={"prose": 1.0}, power=1.0, keep=0.8)[1]).collect()
    assert len(margins) == 6 and all(r["reached"] == pytest.approx(r["target"], rel=1e-3) for r in margins)


def test_raking_in_one_row_equals_raking_by_windows(spark):
    r = np.random.default_rng(6)
    rows = [(f"s{a}", l, t, int(r.integers(0, 400))) for a in range(5) for l in ("en", "de", None) for t in ("x", "y")]
    cells = spark.createDataFrame([(a, b or "(null)", c, n) for a, b, c, n in rows], "_source string, _lang string, _topic string, n bigint")
    shares = {"_source": [(f"s{a}", 0.2) for a in range(5)], "_lang": [("en", 0.7), ("de", 0.2), ("(null)", 0.1)], "_topic": [("x", 0.9), ("y", 0.1)]}
    margins = {k: spark.createDataFrame(v, f"{k} string, _share double") for k, v in shares.items()}
    one, many = ({tuple(x[:3]): x["_take"] for x in mixing.rake(cells, "n", margins, 0.4, passes=12, few=few).select(*mixing.MARGINS, "_take").collect()} for few in (1000, 0))
    assert one == pytest.approx(many, rel=1e-9) and sum(one.values()) == pytest.approx(0.4 * sum(n for *_, n in rows), rel=1e-3)
    assert all(one[a, b or "(null)", c] <= n * (1 + 1e-12) for a, b, c, n in rows)


def test_registers_of_texts(spark):
    texts = {"a | b | c d": "table", "stop ! it now": "shout", "$$$ win $$$": "symbols", "1 2 33 4 5": "numbers", "plain words, here.": "prose", "": "prose", "| ! a b": "table"}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", mixing.topic_of(F.col("t"), mixing.tokens_of(F.col("t"))).alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == texts | {None: "prose"}


def test_clashing_columns_pass_through_or_are_replaced(spark):
    rows = [(i, "a b c " * 20, "en", "s", i, "mine", 1.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _P int, `_k1` string, `a.b` double").withColumnsRenamed({"_P": "_p"}).withColumn("_ids", F.lit(3)).withColumn("_score", F.lit(7))
    out = mixing.mix(docs, keep=0.5)
    assert out.columns.count("_p") == 1 and all(0 <= r["_p"] <= 1 for r in out.collect()) and "a.b" in out.columns
    with pytest.raises(ValueError, match="added"):
        mixing.mix(docs.withColumnRenamed("source", "_source"), source="_source")
    items = spark.createDataFrame([(1, "a b c a")], "item_id bigint, text string")
    out = decontaminate.decontaminate(docs, items).collect()
    assert {(r["_k1"], r["_ids"], r["_p"] == r["doc_id"], r["a.b"]) for r in out} == {("mine", 3, True, 1.5)}
    assert all(r["contaminated"] and r["n_hit"] == 58 for r in out)


def test_mixing_samples_languages_without_a_stated_share(spark):
    rows = [(i, "w " * 100, lang, "s") for i, lang in enumerate(["en"] * 80 + ["de"] * 60 + ["it"] * 40 + [None] * 20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), lang_share={"en": 0.5, "de": 0.5}, keep=0.5)
    cells = {r["_lang"]: r for r in out.select("_lang", "_share", "_p").distinct().collect()}
    assert {k: r["_share"] for k, r in cells.items()} == pytest.approx({"en": 0.35, "de": 0.35, "it": 0.2, "(null)": 0.1})
    assert cells["it"]["_p"] == pytest.approx(0.5) and cells["(null)"]["_p"] == pytest.approx(0.5)
    none = mixing.mix(spark.createDataFrame(rows[-60:], "doc_id bigint, text string, lang string, source string"), keep=0.5)
    assert none.select("_p").distinct().first()[0] == pytest.approx(0.5)


def chats(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, n string")


def test_prefixing_conversations_are_dropped(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 2), (2, 3), (3, 3), (4, 1)) for t in range(n)] + [(5, 0, "user", "other"), (6, 0, None, None), (7, 0, None, ""), (8, 3, "user", "t0"), (2, 0, "user", "t0")]
    out = {r["conv_id"]: r["rendered"] for r in chat.render(chats(spark, rows)).collect()}
    assert set(out) == {2, 5, 6, 7} and out[2] == "".join(f"<|user|>\nt{t}\n" for t in range(3)) and out[6] == "<||>\n\n"
    assert chat.render(chats(spark, [])).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (None, 7, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "b"), (4, 1, "user", "c"), (None, None, None, None)]
    out = sorted((r["conv_id"] or 0, r["n_turns"], r["rendered"]) for r in chat.render(chats(spark, rows)).collect())
    # "a" stands twice without an id and once as conversation 3, of which one stays; "b" prefixes conversation 4
    assert out == [(0, 1, "<|user|>\na\n"), (0, 1, "<||>\n\n"), (4, 2, "<|user|>\nb\n<|user|>\nc\n")]


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user", str(t)) for t in range(700)] + [(2, t, "user", str(t)) for t in range(650)] + [(None, 0, "user", "x")]
    out = chat.render(chats(spark, rows)).orderBy("conv_id", "part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in out] == [(None, 0, 1), (1, 0, 256), (1, 1, 256), (1, 2, 188)]
    assert "".join(r["rendered"] for r in out[1:]) == "".join(f"<|user|>\n{t}\n" for t in range(700))


def brute_near(rows, size, num, den):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = words_of(t, lower=True)
            sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    r = np.random.default_rng(5)
    base = prose(60, 9).split()
    copies = []
    for i in range(60):  # a family whose members are about as like as the threshold
        w = list(base)
        for k in r.choice(60, int(r.integers(0, 5)), replace=False):
            w[k] = f"m{i}_{k}"
        copies.append((100 + i, " ".join(w)))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id bigint, text string"))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    expected = brute_near(rows, 4, 80, 100)
    for block in (1024, 4):
        got = minhash.near_duplicates(docs, size=4, num=80, den=100, block=block).collect()
        assert len(got) == len(rows)
        assert {x["id"]: (x["n_shingles"], x["component_id"]) for x in got if x["id"] is not None} == expected
        assert all(x["kept"] == (x["id"] is None or x["id"] == x["component_id"]) for x in got)
        assert all(x["component_id"] is None for x in got if x["id"] is None)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_recall_on_real_documents(spark):
    """Links and components of the whole table equal those of all pairs of sets, for both sizes of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (4, 5):
        got = {x["id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(docs, size=size).collect()}
        assert got == brute_near(rows, size, 4, 5)


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(1)
    orders = minhash._orders(256)
    for j in (0.2, 0.5, 0.8):
        same, rest = int(3000 * j), int(3000 * (1 - j) / 2)
        h = r.integers(0, 2**63, same + 2 * rest).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.concatenate([h[:same], h[same : same + rest]]), np.concatenate([h[:same], h[same + rest :]])
        x, y = (minhash.registers_of(W._mix(s), orders)[None, :] for s in (a, b))
        assert minhash.estimate(x, y, np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(j, abs=0.12)


def test_quality_learns_and_takes_odd_texts(spark):
    good = [(i, prose(80 + i % 50, i), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"w{x}$$$" for x in range(i % 30 + 20)), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in good + bad] + [(9001, None, "a"), (9002, "", "a"), (None, "x", "a")], "doc_id bigint, text string, _score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r["_score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all(out[i] > 0.3 for i, _, _ in good) and all(out[i] < 0.3 for i, _, _ in bad)
    assert 0 <= out[9001] <= 1 and out[9001] == out[9002] and len(out) == docs.count()
    empty = quality.train(docs, labels.limit(0))
    assert all(0 < r["_score"] < 1 for r in quality.score(docs, empty).collect())
    held = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint").select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def test_quality_model_scores_as_a_plain_loop_does():
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * r.normal(size=600)) > 0).astype(float)
    model = quality.fit(x[:400], y[:400], rounds=40, pairs=2, pair_rounds=20)

    def plain(row):
        total = model.base
        for edges, values, v in zip(model.edges, model.tables, row, strict=True):
            total += values[sum(1 for e in edges if e <= v)]
        for i, j, ei, ej, values in model.pairs:
            total += values[sum(1 for e in ei if e <= row[i])][sum(1 for e in ej if e <= row[j])]
        return 1 / (1 + np.exp(-total))

    scores = model.score(x[400:])
    assert scores == pytest.approx([plain(row) for row in x[400:]], abs=1e-12)
    assert auc(scores, y[400:]) > 0.85 and (1, 2) in {(i, j) for i, j, *_ in model.pairs}


def auc(scores, y):
    good, bad = scores[y == 1], scores[y == 0]
    return float(((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean())


def test_quality_on_held_out_labels(spark):
    """The registered query on real labels: its contract's columns, and how well it ranks rows that it never saw."""
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in quality.op5_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if out[r["doc_id"]]["held_out"]]
    assert len(out) == 1000 and all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    scores, y = np.array([out[r["doc_id"]]["score"] for r in held]), np.array([r["quality"] for r in held])
    assert len(held) > 50 and auc(scores, y) > 0.95


def test_token_files_hold_the_library_ids(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(spark)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = tokens.write_tokens(docs, f"file://{tmp_path}/t", "word_bpe_49k.json", roll=4000)
    got = tokens.read_tokens(manifest).orderBy("start").collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0], x[1] or 0))
    assert [r["doc_id"] for r in got] == [i for _, i, _ in texts] and len(manifest.collect()) > 1
    at, expected = 0, collections.Counter()
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    for _, i, t in texts:
        expected[i, tuple(library.encode(t, add_special_tokens=False).ids + [1])] += 1
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == expected
    shard = manifest.orderBy(F.col("records").desc()).first()
    order = list(range(shard["records"]))[::-1]
    assert [i for i, _, _ in tokens.read_records(shard["file"], order)] == [i for i, _, _ in tokens.read_records(shard["file"], order[::-1])][::-1]
    assert tokens.read_tokens(tokens.write_tokens(docs.limit(0), f"file://{tmp_path}/e", "word_bpe_49k.json")).count() == 0


def test_encoder_equals_the_library_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    assert own.by_word
    for t in ("\x1cA b\x0bc d\xa0e f", "é x ́y <|endoftext|>z <|startoftext|>", "İstanbul ΣΑΣ don't we'll I'M 'S 123 4.5 ½", "a\r\nb\tc d", "日本語 emoji😀😀‍", "_" * 100 + "x" * 500, "", " ", "'s't're''ve"):
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == library.encode(t, add_special_tokens=False).ids


def test_damaged_records_raise():
    data = bytearray(tokens.frame(b"payload"))
    assert tokens.unframe(bytes(data), 0) == (b"payload", len(data))
    for place in (0, 14):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            tokens.unframe(bytes(broken), 0)


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + r.normal(scale=s, size=(25, 16)) for c, s in zip(centres, np.linspace(0.05, 0.6, 12), strict=True)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[3].tolist()) for i in range(20)]
    odd = [(950, None), (951, [0.0] * 16), (952, [float("nan")] * 16), (953, [None] * 16), (954, []), (None, x[0].tolist()), (955, [1.0, 2.0]), (956, [2.0, 4.0]), (900, x[3].tolist())]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows + odd], "vec_id bigint, embedding array<double>, cid string").repartition(3)
    got = sorted(tuple(t) for t in embeddings.near_vectors(df, block=40).collect() if t["vec_id"] is not None)
    ids = np.array([i for i, _ in rows] + [900])
    u = np.array([v for _, v in rows] + [x[3].tolist()])
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    label = ids.copy()
    for _ in range(40):
        label = np.minimum(label, np.where(hit, label[None, :], 10**9).min(axis=1))
    expected = [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, hit.sum(axis=1), label, strict=True)]
    expected += [(i, 0, i, True) for i in range(950, 955)] + [(955, 1, 955, True), (956, 1, 955, False)]
    assert got == sorted(expected)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_few_pairs_of_vectors_are_compared_in_full():
    r = np.random.default_rng(8)
    x = embeddings._unit(r.normal(size=(1500, 64)))
    x[700:760] = embeddings._unit(x[:60] + r.normal(scale=0.04, size=(60, 64)))
    axes = np.linalg.svd(x)[2].T[:, :16]
    side = np.arange(1500), np.ones(1500, np.int64), x, x @ axes
    pair = embeddings._Pair(side, side, True, 0.9)
    pair.join(0, 1500, 0, 1500)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    assert (pair.na == hit.sum(axis=1)).all() and hit.any() and pair.compared < 0.05 * pair.bounded


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    text = np.concatenate([r.integers(97, 99, 1200), r.integers(97, 99, 300).repeat(1)] * 2).astype(np.uint8)
    data = text.tobytes()
    order = suffixes.suffix_array(text)
    assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))
    shared = suffixes.common_prefixes(text, order, 400, stretch=7)

    def common(a, b):
        k = 0
        while k < min(len(a), len(b), 400) and a[k] == b[k]:
            k += 1
        return k

    assert shared[1:].tolist() == [common(data[order[i] :], data[order[i - 1] :]) for i in range(1, len(data))]


def test_repeated_bytes_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count = collections.Counter(b[j : j + 400] for b in ((t or "").encode() for _, t in rows) for j in range(len(b) - 399))
    expected = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if count[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        expected[i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    for options in ({}, {"shard_segments": 2, "shard_bytes": 2000}, {"shard_segments": 1, "shard_bytes": 1, "step": 700}):
        assert collections.Counter(tuple(r) for r in suffixes.suffix_dedup(docs, **options).collect()) == expected
    assert suffixes.suffix_dedup(docs.limit(0)).count() == 0


def test_texts_that_end_with_zeros(spark):
    """Bytes of 0 at the end of a shard, which once made the sort of its suffixes endless."""
    r = np.random.default_rng(2)
    for zeros in range(20):
        data = r.integers(0, 2, 9).astype(np.uint8).tobytes() + b"\0" * zeros
        assert [data[i:] for i in suffixes.suffix_array(np.frombuffer(data, np.uint8))] == sorted(data[i:] for i in range(len(data)))
    texts = ["a" * 500 + "\0" * 3, "a" * 500 + "\0" * 3, "\0" * 900, "x" + "\0" * 450, "\0" * 399]
    out = suffixes.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(tuple(x) for x in out) == [(0, 503, 503, 1, sha("")), (1, 503, 503, 1, sha("")), (2, 900, 900, 1, sha("")), (3, 451, 450, 1, sha("x")), (4, 399, 0, 0, sha(texts[4]))]


def test_repeated_words_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first: dict = {}
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    expected = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < (2**63 - 1 if i is None else i):
                gone[j : j + 50] = [True] * 50
        expected[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    for step in (substrings.STEP, 300):
        assert collections.Counter(tuple(r) for r in substrings.substring_dedup(docs, step=step).collect()) == expected
    assert substrings.substring_dedup(docs.limit(0)).count() == 0


def test_rows_without_an_id_keep_their_own_results(spark):
    # the last two texts have equal 32-bit hashes
    rows = [(1, "text number zzz"), (None, "text number 2654"), (None, "text number 91281")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, sha string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = suffixes.suffix_dedup(docs, length=8, gram=4).collect()
    assert sorted(r["kept_sha256"] for r in out) == sorted([sha("zzz"), sha("2654"), sha("91281")])
    out = substrings.substring_dedup(docs, length=2).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept_sha256"]) for r in out) == sorted([(1, 0, sha("text number zzz")), (0, 2, sha("2654")), (0, 2, sha("91281"))])


def test_texts_of_megabytes(spark):
    """Longer than a stretch: a copy shifted by some bytes, one letter over and over, and a word without spaces."""
    base = prose(500_000, 11, 50_000)
    texts = [base, "shift " + base[:1_500_000] + " end", "a" * 1_200_000, ("b" * 3_000_000) + " " + base[2_000_000:2_000_600]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in suffixes.suffix_dedup(docs, step=1 << 18).collect()}
    assert len(base) > 3_000_000 and [out[i]["n_bytes"] for i in range(4)] == [len(t) for t in texts]
    assert (out[0]["n_removed"], out[0]["n_spans"], out[1]["n_removed"], out[1]["n_spans"]) == (1_500_600, 2, 1_500_000, 1)
    assert out[2]["n_removed"] == len(texts[2]) and out[3]["n_removed"] == 3_000_600
    assert out[1]["kept_sha256"] == hashlib.sha256(b"shift  end").hexdigest()
    out = {r["doc_id"]: r for r in substrings.substring_dedup(docs, step=1 << 18).collect()}
    words = base.split()
    whole = len(base[:1_500_000].rsplit(" ", 1)[0].split()) if base[1_500_000] != " " else len(base[:1_500_000].split())
    assert out[0]["n_removed"] == 0 and out[0]["n_words"] == len(words) and out[1]["n_removed"] == whole
    assert out[3]["n_words"] == 1 + len(texts[3].split()[1:]) and out[2]["n_removed"] == 0


def test_contamination_equals_brute_force(spark):
    docs = documents(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(1, " ".join(text[1].split()[50:70]).upper()), (2, "one TWO"), (3, None), (4, ""), (5, "never seen words"), (None, "w1 w2"), (7, text[14][500:640]), (7, text[14][500:640])]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, n_hit int")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))))
    expected = collections.Counter()
    for r in docs.collect():
        w, gone, ids = cut(r["text"]), set(), set()
        for i, t in items:
            v = cut(t)
            n = min(13, len(v))
            for s in {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else ():
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) == s:
                        gone.update(range(j, j + n))
                        ids |= {str(i)} - {"None"}
        expected[r["doc_id"], len(w), len(gone), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(gone) > 0 and 20 * len(gone) >= len(w)] += 1
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for limit in (1 << 20, 0):
        out = decontaminate.decontaminate(docs, bench, broadcast_bytes=limit)
        assert "score" in out.columns
        assert collections.Counter(tuple(r) for r in out.select(*columns).collect()) == expected
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_scratch_is_in_the_shared_folder(spark):
    from sparkloom.llm._common import shared_dir

    assert scratch(spark, "x").startswith(shared_dir(spark))
