"""Encoding with a byte-level BPE vocabulary through a sentencepiece model (problem 7).

A sentencepiece BPE model is written directly from the vocabulary's ranks: each token becomes a piece whose bytes are
mapped to printable letters, scored by its negative rank, with identity normalisation. Texts are cut into pre-tokens,
each pre-token is encoded on its own; decoding maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from graphloom.llm.arrow import map_rows, strings

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept in a worker's cache, of at most so many letters each; then the cache starts anew.
CACHE_SIZE, CACHE_LEN = 300_000, 32


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 bytes stand for themselves, the rest for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model; ids are ranks. The piece for unknown letters comes last and never occurs in mapped texts."""
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [("".join(letters[b] for b in t), -float(i), normal) for i, t in enumerate(tokens)]
    pieces.append(("⁇", 0.0, unknown))
    out = bytearray()
    for piece, score, kind in pieces:
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
    out += _field(2, _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)))
    out += _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Encodes and decodes texts; null and empty texts give no ids."""

    def __init__(self, ranks_path: str):
        self.tokens = read_ranks(ranks_path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        letters = byte_letters()
        self.map = {i: letters[i] for i in range(256)}
        self.split = regex.compile(PRE_TOKEN).findall
        self.cache: dict[str, list[int]] = {}

    def _learn(self, words: list[str]) -> dict[str, list[int]]:
        mapped = [w.encode().decode("latin-1").translate(self.map) for w in words]
        return dict(zip(words, self.sp.encode(mapped, num_threads=1)))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of each text."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_SIZE:
            self.cache = {}
        known = self.cache
        new = self._learn([w for w in set(chain.from_iterable(cut)) if w not in known])
        known.update({w: x for w, x in new.items() if len(w) <= CACHE_LEN})
        long = {w: x for w, x in new.items() if len(w) > CACHE_LEN}
        if long:
            known = known | long
        per_text = [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in per_text], out=offsets[1:])
        return np.fromiter(chain.from_iterable(per_text), dtype=np.int32, count=offsets[-1]), offsets

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id and ids of each row's text, without special tokens.

    Null and empty texts give an empty list; text that spells a special token is ordinary text; rows are kept as they
    are, repeated ones too. Other columns, whatever their names, are left out. There is no shuffle.
    """
    path, kind = f"{folder}/{vocabulary}.tiktoken", df.schema[id_col].dataType.simpleString()

    def make():
        enc = Encoder(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, offsets = enc.encode_batch(strings(batch, "text"))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[id_col, "ids"])

        return run

    return map_rows(df.select(df[id_col], df[text_col].alias("text")), make, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id and text of each row's ids, the inverse of ``encode_texts``; a null list gives a null text."""
    path, kind = f"{folder}/{vocabulary}.tiktoken", df.schema[id_col].dataType.simpleString()

    def make():
        tokens = read_ranks(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", errors="replace") for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

        return run

    return map_rows(df.select(df[id_col], df[ids_col].alias("ids")), make, f"`{id_col}` {kind}, text string")
