"""Token ids as length-delimited binary records, with an offset index beside each file.

A file holds records one after another: the payload's length (8 bytes, little endian), a masked checksum of these
8 bytes, the payload, a masked checksum of the payload (4 bytes each). The checksum is CRC-32, rotated right by 15
bits plus a constant, so that a checksum stored in data doesn't check itself. A payload is one byte of flags (1: no
id; 2: ids of four bytes instead of two), the document's id (8 bytes) and the token ids. The index holds, for each
record and for the end, the record's offset and the number of tokens before it in the file, 8 bytes each, so that
any record can be read at once, in any order.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import local_or_uri, need, scratch, table, written

END_ID = 1
ROLL = 512 << 20
READ_RECORDS = 2048
OUT_BYTES = 4 << 20
CACHED_WORDS = 500_000
CACHED_PIECES = 300_000
MASK = 0xA282EAD8
NO_ID, WIDE = 1, 2
MANIFEST = "shard bigint, file string, bytes bigint, records bigint, tokens bigint"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """(payload, offset behind the record) of the record at this offset; ValueError if a checksum differs."""
    length, check = struct.unpack_from("<QI", data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"the length at {at} differs from its checksum")
    payload = data[at + 12 : at + 12 + length]
    if len(payload) < length or masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"the record at {at} differs from its checksum")
    return payload, at + 16 + length


class Encoder:
    """A tokenizers file's ids of whole texts, word by word with a cache.

    For tokenizers whose normalizer works on single characters or composes them, and whose pieces don't cross white
    space, as the BPE files with word ends do; files with other parts are run on whole texts.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        normal = (parts.get("normalizer") or {}).get("normalizers", [])
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": self.PATTERN} and cuts[0]["behavior"] == "Removed" and not cuts[1]["add_prefix_space"] and parts["model"]["type"] == "BPE" and not parts.get("post_processor") and not any(x[k] for x in parts["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.marks = [x["content"] for x in parts["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.packed = [np.array([i], self.dtype).tobytes() for i in range(self.size)]
        self.tokenize = self.tokenizer.model.tokenize if self.by_word else None
        import regex

        self.pieces_of = regex.compile(self.PATTERN).findall
        self.pieces = _Cache(self._piece, CACHED_PIECES)
        self.words = _Words(self, CACHED_WORDS)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece in lower case, of ASCII and Latin-1 letters or marks."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self._model(text)

    def _model(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(text)])

    def _word(self, word: str) -> bytes:
        """The ids of any word."""
        if plain := PLAIN(word):
            # letters that lowering and composing treat alike everywhere, alone or before a mark
            return self.pieces[plain[1].lower()] + (self.pieces[plain[2]] if plain[2] else b"")
        if any(m in word for m in self.marks):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        if word.isascii() and word.isprintable():
            return b"".join(map(self.pieces.__getitem__, self.pieces_of(word.lower())))
        t = self.tokenizer
        return b"".join(self._model(p) for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word)))

    def encode(self, text: str) -> bytes:
        """The ids' bytes, of this object's dtype."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        # Python's split also cuts at these four, which are no white space to the file's parts
        words = re.split(r"[ \t\n\r]+", text) if SEPARATORS(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


class _Cache(dict):
    """Values by key, worked out when first asked for and kept while there are fewer than `most`."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key: str) -> bytes:
        out = self.work(key)
        if len(self) < self.most and len(key) < 64:
            self[key] = out
        return out


class _Words(dict):
    """Words' ids. The most common words, ASCII letters with or without a mark behind, are worked out here, without calls."""

    def __init__(self, encoder: Encoder, most: int):
        super().__init__()
        self.other, self.pieces, self.packed, self.tokenize, self.most = encoder._word, encoder.pieces, encoder.packed, encoder.tokenize, most

    def __missing__(self, word: str) -> bytes:
        stem = word if word.isalpha() else word[:-1] if word[-1] in ".," and word[:-1].isalpha() else ""
        if not stem or not stem.isascii():
            out = self.other(word)
        else:
            low = stem.lower()
            out = self.pieces.get(low)
            if out is None:
                packed = self.packed
                out = b"".join([packed[t.id] for t in self.tokenize(low)])
                if len(self.pieces) < self.pieces.most and len(low) < 64:
                    self.pieces[low] = out
            if stem is not word:
                out += self.pieces[word[-1]]
        if len(self) < self.most and len(word) < 64:
            self[word] = out
        return out


PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch
SEPARATORS = re.compile("[\x1c-\x1f]").search
#: Byte-level BPE's letter for each byte: itself if it is printable, else the next letter from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def encoder(path: str) -> Encoder:
    """One encoder, with its caches, for each file and Python worker.

    The package goes to the workers by value, so a name of this module is a new one in each task; what a worker keeps has
    to hang on a module that is there anyway.
    """
    kept = sys.__dict__.setdefault("_sparkloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, roll: int = ROLL) -> DataFrame:
    """Writes the texts' ids, in ascending order of doc_id over all files, and returns a manifest.

    tokenizer: a path, or a file's name in the public_tokenizers package. A null text is empty and is its end id alone. Null ids come first; rows with equal
    ids are in the order of a hash of their texts. Texts that are longer than a batch are whole, as all are. Files
    are of one task attempt and count only if the manifest names them. An empty table writes no file. Other columns are
    ignored.
    """
    need(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("_t"), F.spark_partition_id().alias("_p"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("_t"), F.col("_p")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = local_or_uri(path)
        task = TaskContext.get()
        stem = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        enc = encoder(_path(tokenizer))
        end = np.array([end_id], enc.dtype).tobytes()
        out, done, index = None, [], []
        size = tokens = 0
        name = ""

        def close() -> None:
            out.close()
            with fs.open_output_stream(name + ".idx", compression=None) as f:
                f.write(np.array([*index, (size, tokens)], "<u8").tobytes())
            done.append((task.partitionId() * 100_000 + len(done), path + name[len(base) :], size, len(index), tokens))

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, index, size, tokens = f"{stem}-{len(done):05d}.tok", [], 0, 0
                    out = fs.open_output_stream(name, compression=None)
                ids = enc.encode(text or "") + end
                flags = (NO_ID if doc_id is None else 0) | (WIDE if enc.dtype.itemsize == 4 else 0)
                data = frame(struct.pack("<Bq", flags, doc_id or 0) + ids)
                index.append((size, tokens))
                out.write(data)
                size, tokens = size + len(data), tokens + len(ids) // enc.dtype.itemsize
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        columns = list(zip(*done, strict=True)) if done else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    return written(rows.mapInArrow(write, MANIFEST), "manifest")


def read_records(file: str, records: Sequence[int]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, tokens before it in the file, ids as 32 bits) of the records of these numbers, in the given order."""
    fs, p = local_or_uri(file)
    with fs.open_input_file(p + ".idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(p) as f:
        known, at, data = -1, 0, b""
        for r in records:
            lo, hi = int(index[r, 0]), int(index[r + 1, 0])
            if not (at <= lo and hi <= at + len(data)):
                f.seek(lo)
                at, data = lo, f.read(max(hi - lo, (1 << 20) if r == known + 1 else 0))
            known = r
            payload, _ = unframe(data, lo - at)
            flags, doc_id = struct.unpack_from("<Bq", payload)
            ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9).astype("<u4")
            if len(ids) != int(index[r + 1, 1]) - int(index[r, 1]):
                raise ValueError(f"{file}: record {r} and the index differ")
            yield None if flags & NO_ID else doc_id, int(index[r, 1]), ids


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all records; ids are little-endian numbers of 32 bits, start counts the ids before."""
    need(manifest, "shard", "file", "records", "tokens")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    based = written(manifest.withColumn("base", before), "shards")
    ranges = based.filter("records > 0").select("file", "base", "records", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(READ_RECORDS).cast("bigint"))).alias("first"))
    ranges = ranges.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file, base, count, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for doc_id, start, ids in read_records(file, range(first, min(first + READ_RECORDS, count))):
                    rows.append((doc_id, base + start, ids.tobytes()))
                    held += 4 * len(ids)
                    if held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])

    return ranges.mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_tokens gives."""
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_token_records(spark, sf_dir: str) -> DataFrame:
    """Writes the whole table's ids, then reads them from the files."""
    manifest = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), "word_bpe_49k.json")
    return digest(read_tokens(manifest))
