"""Token-id files: one zstandard frame per document over a shared dictionary, with an index of offsets.

``encode`` runs a public tokenizer over whole texts, ``train_dictionary`` fits one dictionary on serialized id arrays of short
documents, ``write_files`` sorts the documents by id over the cluster and writes one file per range, ``read_files`` reads
every document back, and ``TokenFile`` reads single documents of one file by its index.

A file is a row of records, each followed by one line feed, written by Spark's own text writer (with its commit protocol,
to any file system): a header, one frame per document, the index, and the footer.

* header: ``MAGIC``, bytes per id (2 if all ids of the vocabulary fit, else 4), SHA-256 of the dictionary
* frame: the ids, little-endian, zstandard with the dictionary (checked against the header's hash; none: without one)
* index: one ``INDEX`` row per document, in file order
* footer: ``FOOTER``: place of the index, documents, ids, ``MAGIC``

The dictionary is a file of its own beside the files. Texts are cut at the six ASCII separators and encoded word by word: the
tokenizer's pattern never crosses white space, and its normaliser composes nothing across one, so the ids are those of the
whole text (tests compare). Null text: empty, so the end id alone. A null ``doc_id`` sorts first and is flagged in the index;
rows that repeat are kept, in the order of the encoded table. Extra columns are not read. A task holds one batch of
documents and its file's index.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import re
from functools import lru_cache
from itertools import accumulate
from typing import BinaryIO
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.llm.store import parts_of, scratch_path, written

MAGIC = b"ctkids01"
HEADER = np.dtype([("magic", "S8"), ("width", "<u4"), ("dictionary", "V32")])
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u4"), ("bytes", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8"), ("start", "<u8")])
FOOTER = np.dtype([("index", "<u8"), ("documents", "<u8"), ("ids", "<u8"), ("magic", "S8")])
FILE_IDS = 1 << 25  # ids per file, about
LEVEL = 3
# The dictionary is trained on at most so many documents, of at most so many bytes of ids each, and has at most so many bytes.
TRAIN_DOCUMENTS, TRAIN_BYTES, DICTIONARY_BYTES = 4000, 1 << 12, 1 << 16
# Pieces, and other words, whose ids a worker remembers; their longest one; about how many bytes of text are encoded at once.
MEMO, MEMO_BYTES, AT_ONCE = 1 << 19, 64, 1 << 21


# Words that only lower case, the pattern and the model change: printable ASCII but for the sign that special tokens begin with,
# and the letters of U+00C0 to U+00FF (in UTF-8), which are composed already.
_PLAIN = re.compile(rb"(?:[!-;=-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Byte-level models name a byte by its own character if that is visible, the n-th of the others by character 256 + n.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SEEN)}


def _pattern(path: str) -> re.Pattern | None:
    """The pre-tokenizer's pattern for lower-cased words of ``_PLAIN``, if the tokenizer file has no step but composing,
    collapsing white space, lower-casing, splitting by that pattern, naming bytes, and merging."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if (steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in split] != ["Split", "ByteLevel"]
            or (split[0]["behavior"], split[0]["invert"]) != ("Removed", True) or split[1]["use_regex"] or split[1]["add_prefix_space"]
            or not all(t["content"].startswith("<") for t in spec.get("added_tokens", []))):
        return None
    letters = "a-z\u00df-\u00f6\u00f8-\u00ff"
    known = (split[0]["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}0-9]").replace(r"\p{L}", letters).replace(r"\p{N}", "0-9"))
    return None if r"\p" in known else re.compile(known)


class Pieces(dict):
    """Piece of a plain word -> its ids as bytes, filled by the tokenizer's model."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.model, self.kind = model, kind

    def __missing__(self, piece: str) -> bytes:
        named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_NAMES)
        out = np.array([t.id for t in self.model.tokenize(named)], self.kind).tobytes()
        if len(self) >= MEMO:
            self.clear()
        self[piece] = out
        return out


class Words:
    """The ids of whole texts. Each distinct word of some texts is encoded once.

    A plain word takes the tokenizer's own steps one by one, which saves most of the time: lower case, the
    pre-tokenizer's pattern, and the model on each piece (the other steps do nothing to such words). All other words, and
    all words of a tokenizer with other steps, go through the whole tokenizer. Ids of pieces and of other words are remembered.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.pattern = Tokenizer.from_file(path), f"<u{width}", _pattern(path)
        self.pieces, self.others = Pieces(self.tokenizer.model, self.kind), {}

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each distinct word."""
        out: list[bytes] = []
        rest: list[int] = []
        piece = self.pieces.__getitem__
        for i, w in enumerate(words):
            if self.pattern and len(w) <= MEMO_BYTES and _PLAIN.fullmatch(w):
                parts = self.pattern.findall(w.decode().lower())
                out.append(piece(parts[0]) if len(parts) == 1 else b"".join(map(piece, parts)))
            else:
                known = self.others.get(w)
                out.append(known)
                if known is None:
                    rest.append(i)
        texts = [words[i].decode("utf-8", "replace") for i in rest]
        if len(self.others) + len(rest) > MEMO:
            self.others.clear()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = np.array(e.ids, self.kind).tobytes()
            if len(words[i]) <= MEMO_BYTES:
                self.others[words[i]] = out[i]
        return out

    def ids(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Each text's ids and ``end``, as bytes."""
        split = pc.ascii_split_whitespace(texts)  # the six separators; an edge separator leaves an empty word, without ids
        flat = split.flatten().dictionary_encode()
        table = [*self._of(flat.dictionary.cast(pa.large_binary()).to_pylist()), end]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // len(end)
        starts = np.cumsum(sizes) - sizes
        cut = np.asarray(split.offsets).astype(np.int64)
        word = np.insert(flat.indices.to_numpy(zero_copy_only=False), cut[1:] - cut[0], len(table) - 1)
        n = sizes[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        small = np.int32 if max(upto[-1], starts[-1]) < 1 << 31 else np.int64
        at = np.repeat((starts[word] - upto[:-1]).astype(small), n) + np.arange(upto[-1], dtype=small)
        body = np.frombuffer(b"".join(table), self.kind)[at]
        ends = upto[cut - cut[0] + np.arange(len(cut))] * len(end)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])


@lru_cache(maxsize=4)
def _words(path: str, width: int) -> Words:
    return Words(path, width)


def id_width(path: str) -> int:
    """Bytes per id for the vocabulary of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]], default=0)
    return 2 if most < 1 << 16 else 4


def encode(docs: DataFrame, tokenizer: str, end_id: int, width: int = 4) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text and the end id, as little-endian unsigned integers of ``width`` bytes."""
    end = np.array([end_id], f"<u{width}").tobytes()

    def per_batch(batches):
        words = _words(tokenizer, width)
        for batch in batches:
            texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // AT_ONCE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(upto)) + 1):
                at, n = int(part[0]), len(part)
                ids = words.ids(texts.slice(at, n), end).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), ids], ["doc_id", "ids"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch, "doc_id long, ids binary")


def train_dictionary(placed: DataFrame) -> bytes:
    """A dictionary fitted on the ids of documents drawn by a hash of id and ids; empty if there are too few."""
    short = placed.where(F.length("ids") <= TRAIN_BYTES)
    drawn = short.select("place", F.xxhash64("doc_id", "ids").alias("draw")).orderBy("draw", "place").limit(TRAIN_DOCUMENTS).collect()
    rows = short.where(F.col("place").isin([r["place"] for r in drawn])).orderBy("place").select("ids").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["ids"] for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _records(batches, width: int, raw: bytes):
    """The records of one file, from the documents of one range in order."""
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True)
    head = np.zeros(1, HEADER)
    head[0] = (MAGIC, width, hashlib.sha256(raw).digest())
    at, ids, index = HEADER.itemsize + 1, 0, []
    out = [head.tobytes()]
    for batch in batches:
        for doc, x in zip(batch["doc_id"].to_pylist(), batch["ids"]):
            x = x.as_py()
            frame = packer.compress(x)
            index.append((doc or 0, doc is not None, len(frame), at, len(x) // width, ids))
            at += len(frame) + 1
            ids += len(x) // width
            out.append(frame)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
        out = []
    if index:
        foot = np.zeros(1, FOOTER)
        foot[0] = (at, len(index), ids, MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([np.array(index, INDEX).tobytes(), foot.tobytes()], pa.binary())], ["record"])


def _sink(records: DataFrame, path: str) -> None:
    (records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite")
     .option("compression", "none").option("lineSep", "\n").text(path))


def write_files(encoded: DataFrame, path: str, width: int, ids_per_file: int = FILE_IDS) -> bytes:
    """Write a stored table of ``encode`` as files in ascending ``doc_id`` order under ``path``; returns the dictionary."""
    spark = encoded.sparkSession
    placed = encoded.withColumn("place", F.monotonically_increasing_id())
    raw = train_dictionary(placed)
    _sink(spark.createDataFrame([(raw,)], "record binary").coalesce(1), f"{path}/dictionary")
    total = encoded.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0)).alias("n")).first()["n"] // width
    files = max(parts_of(spark), math.ceil(total / ids_per_file))
    ordered = placed.repartitionByRange(files, F.asc_nulls_first("doc_id"), "place").sortWithinPartitions(F.asc_nulls_first("doc_id"), "place")
    _sink(ordered.select("doc_id", "ids").mapInArrow(lambda batches: _records(batches, width, raw), "record binary"), f"{path}/files")
    return raw


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/dictionary").select("content").collect()
    return bytes(rows[0]["content"])[:-1]  # one file of one record


class TokenFile:
    """One file, open for reading: ``documents()`` in order, ``ids(doc_id)`` by the index without reading other frames."""

    def __init__(self, file: BinaryIO, dictionary: bytes):
        self.file = file
        file.seek(0)
        head = np.frombuffer(file.read(HEADER.itemsize), HEADER)[0]
        end = file.seek(-FOOTER.itemsize - 1, io.SEEK_END)
        foot = np.frombuffer(file.read(FOOTER.itemsize), FOOTER)[0]
        if head["magic"] != MAGIC or foot["magic"] != MAGIC:
            raise ValueError("not a token-id file")
        if head["dictionary"].tobytes() != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.width = int(head["width"])
        file.seek(int(foot["index"]))
        self.index = np.frombuffer(file.read(end - int(foot["index"]) - 1), INDEX)
        if len(self.index) != foot["documents"]:
            raise ValueError("the index is not whole")
        self.n_ids = int(foot["ids"])
        self._unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def frame(self, row: np.void) -> bytes:
        """The ids of one index row, as little-endian unsigned 32-bit integers."""
        self.file.seek(int(row["offset"]))
        return _wide(self._unpacker.decompress(self.file.read(int(row["bytes"]))), self.width)

    def documents(self):
        for row in self.index:
            yield (int(row["doc_id"]) if row["known"] else None), int(row["start"]), self.frame(row)

    def ids(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of all documents with this id."""
        known = self.index["known"].astype(bool)
        first = int((~known).sum())  # documents without an id come first
        if doc_id is None:
            rows = self.index[:first]
        else:
            own = self.index["doc_id"][first:]
            rows = self.index[first + np.searchsorted(own, doc_id, "left"):first + np.searchsorted(own, doc_id, "right")]
        return [np.frombuffer(self.frame(r), "<u4") for r in rows]


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decompressed: ``start`` counts the ids of all documents
    before it, the checksum is that of the ids as little-endian unsigned 32-bit integers, and ``with_ids`` keeps those, too."""
    raw = read_dictionary(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/files").where("length > 0").select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")
    foot = F.expr(f"substring(content, length(content) - {FOOTER.itemsize}, {FOOTER.itemsize})")
    rows = files.select("file", foot.alias("foot")).collect()  # one row per file
    ordered = sorted((r["file"], int(np.frombuffer(r["foot"], FOOTER)["ids"][0])) for r in rows)
    before = dict(zip([f for f, _ in ordered], accumulate([n for _, n in ordered], initial=0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                        *[("ids", pa.binary())] * with_ids])

    def documents(batches):
        for batch in batches:
            for f, x in zip(batch["file"].to_pylist(), batch["content"]):
                out, size = [], 0
                for doc, start, ids in TokenFile(pa.BufferReader(x.as_buffer()), raw).documents():
                    out.append((doc, before[f] + start, len(ids) // 4, crc32(ids), ids)[:len(schema)])
                    size += len(ids)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)

    return files.mapInArrow(documents, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in schema.names))


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Encode ``docs``, write the files, read them back: (doc_id, start, n_tokens, ids_crc32) of each document."""
    spark = docs.sparkSession
    width = id_width(tokenizer)
    path = path or scratch_path(spark, "token-ids")
    write_files(written(encode(docs, tokenizer, end_id, width), "encoded"), path, width)
    return read_files(spark, path, with_ids=False)
