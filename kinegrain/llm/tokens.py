"""Token ids of whole texts by a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary: every byte is written as one
printable character, every token is a piece whose score is its negative rank (so the pair that is
merged first is the one of the lowest rank), nothing is normalised. A text is cut into pre-tokens by
the vocabulary's pattern; each pre-token is encoded by the model, and a worker keeps the ids of the
pre-tokens it has met. Decoding maps the pieces back to bytes.

Defined cases: a null text has null ids, an empty one an empty list; a blank text is ordinary text;
lone surrogates can't occur in Spark strings; texts of any length are cut whole, in one pass; special
tokens' names are ordinary text; repeated rows and further columns are kept as they are.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = "/opt/tokenizers"
#: Pre-tokens that a worker remembers at most; then it starts anew.
REMEMBERED = 400_000

# The pattern of the vocabulary, and what it means for texts of ASCII characters only.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes after them."""
    letters = byte_letters()
    by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks aren't 0, 1, 2, ...")
    out = bytearray()
    for token, rank in by_rank:
        out += _field(1, _field(1, "".join(letters[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1))
    unknown = len(by_rank)
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class _Met(dict):
    """Ids of the pre-tokens met so far, as packed 32-bit numbers; others are encoded on first sight."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, pre_token: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self.encode(pre_token)
        packed = self[pre_token] = struct.pack(f"={len(ids)}i", *ids)
        return packed


class Codec:
    """Encodes texts and decodes ids; made once per worker."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(path)))
        letters = byte_letters()
        self.back = {ch: b for b, ch in enumerate(letters)}
        self.table = dict(enumerate(letters))
        self.cut = regex.compile(PATTERN).findall
        self.cut_ascii = re.compile(ASCII_PATTERN).findall
        self.met = _Met(self._piece_ids)

    def _piece_ids(self, pre_token: str) -> list[int]:
        return self.model.encode(pre_token.encode("utf-8").decode("latin-1").translate(self.table))

    def pre_tokens(self, text: str) -> list[str]:
        return self.cut_ascii(text) if text.isascii() else self.cut(text)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers in the machine's byte order."""
        return b"".join(map(self.met.__getitem__, self.pre_tokens(text)))

    def encode(self, text: str) -> list[int]:
        data = self.packed(text)
        return list(struct.unpack(f"={len(data) // 4}i", data))

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4

    def decode(self, ids: list[int]) -> bytes:
        return bytes(self.back[ch] for i in ids for ch in self.model.id_to_piece(int(i)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary_path(name: str, folder: str = VOCABULARIES) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _ship(df: DataFrame, path: str):
    """A function that tells workers where the vocabulary is: at ``path``, or else in the files of the application, whereto the driver ships it."""
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)

    def where() -> str:
        from pyspark import SparkFiles

        return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))

    return where


def _encoder(where, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import importlib

        import numpy as np

        # the module's own registry where workers have the package, else one of this task
        try:
            code = importlib.import_module("kinegrain.llm.tokens").codec(where())
        except ImportError:
            code = codec(where())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if counts_only:
                found = pa.array([None if t is None else code.count(t) for t in texts], pa.int64())
            else:
                packed = [b"" if t is None else code.packed(t) for t in texts]
                sizes = np.cumsum([0, *map(len, packed)]) // 4
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                nulls = np.array([*[t is None for t in texts], False])
                found = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32), mask=nulls), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["__key", "__value"])

    return run


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), F.col(text)).mapInArrow(_encoder(_ship(docs, vocabulary_path(tokenizer, folder)), False), f"__key {kind}, __value array<int>")
    return out.select(F.col("__key").alias(key), F.col("__value").alias("ids"))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``n_tokens`` (null for a null text) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), F.col(text)).mapInArrow(_encoder(_ship(docs, vocabulary_path(tokenizer, folder)), True), f"__key {kind}, __value bigint")
    return out.select(F.col("__key").alias(key), F.col("__value").alias("n_tokens"))


def decode_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``text`` of every row of ids; null ids are a null text."""
    kind = rows.schema[key].dataType.simpleString()
    where = _ship(rows, vocabulary_path(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(where())
        for batch in batches:
            texts = [None if x is None else code.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__key", "__value"])

    out = rows.select(F.col(key), F.col(ids)).mapInArrow(run, f"__key {kind}, __value string")
    return out.select(F.col("__key").alias(key), F.col("__value").alias("text"))
