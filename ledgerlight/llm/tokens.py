"""Encoding of text by a byte-level BPE vocabulary, and back.

The tokenizers library does the merges. Its pre-tokenizer's pattern is run here, so that a piece
that comes again (most do) costs a dictionary look-up instead of another run of the merges.
Pieces are bytes written as characters by the vocabulary's byte table; decoding reverses the table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern by which byte-level BPE splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to so many characters are remembered, and so many of them before the memory is emptied.
PIECE, PIECES = 48, 400_000


def byte_characters() -> list[str]:
    """For each byte the character that stands for it: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """Ids of a piece of text, as a tuple; computed when it is first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path).model
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table)))
        if len(piece) <= PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _known(path: str) -> None:
    """An error unless a vocabulary splits text as this module does: byte-level BPE with its usual pattern, nothing normalized or put before."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    split = raw.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    model = raw.get("model") or {}
    affixed = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or raw.get("normalizer") or model.get("type") != "BPE" or affixed:
        raise ValueError(f"{os.path.basename(path)} isn't a byte-level BPE vocabulary without normalizer and prefix space: its ids would be others")


_opened: dict[str, tuple] = {}


def opened(path: str) -> tuple:
    """(split function, Pieces, bytes of each id) of a vocabulary, once per worker."""
    if path not in _opened:
        import regex
        from tokenizers import Tokenizer

        _known(path)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        raw: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        _opened[path] = regex.compile(SPLIT).findall, Pieces(path), raw
    return _opened[path]


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of one text; none for null and empty text. Strings like special tokens are ordinary text."""
    split, pieces, _ = opened(path)
    return [i for piece in split(text or "") for i in pieces[piece]]


def spans(text: str, ids: list[int], path: str = VOCABULARY) -> tuple[list[int], list[int]]:
    """First character and the one after the last of each id; parts of one character share it."""
    raw = opened(path)[2]
    ends = np.cumsum([len(raw[i]) for i in ids], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return character[starts].tolist(), (character[ends - 1] + 1).tolist() if len(ids) else []


class Decoder:
    """Bytes of ids to text, piece by piece; bytes of a split character wait for the rest."""

    def __init__(self, path: str = VOCABULARY):
        import codecs

        self.raw = opened(path)[2]
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        unknown = "�".encode()
        return self.text.decode(b"".join(self.raw[i] if 0 <= i < len(self.raw) else unknown for i in ids), last)


def encode_corpus(df: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """One row per row of `df`: the columns `keep` and `ids` array<int>, with `offsets` also `starts` and `ends`.

    Null and empty texts give empty lists; special tokens are neither added nor read. Rows are
    encoded where they lie, without a shuffle; other columns, whatever their names, aren't read.
    Each of `keep` must be a column of `df`; repeated rows give repeated results.
    """
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], (F.col(f"`{text}`") if isinstance(text, str) else text).alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *[T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in ("ids", "starts", "ends")[: 3 if offsets else 1]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, _ = opened(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            flat: list[int] = []
            until, starts, ends = np.zeros(len(texts) + 1, np.int32), [], []
            for k, t in enumerate(texts):
                if t:
                    found = [i for piece in split(t) for i in pieces[piece]]
                    flat += found
                    if offsets:
                        a, b = spans(t, found, path)
                        starts += a
                        ends += b
                until[k + 1] = len(flat)
            lists = [pa.ListArray.from_arrays(pa.array(until), pa.array(np.array(x, np.int32))) for x in ([flat, starts, ends] if offsets else [flat])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=schema.names)

    return chosen.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and the `text` of `ids`: null for a null list, U+FFFD for ids outside the
    vocabulary and for characters of which bytes are missing."""
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else Decoder(path).feed([-1 if i is None else i for i in x], True) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return chosen.mapInArrow(run, schema)
