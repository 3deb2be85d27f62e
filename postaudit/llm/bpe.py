"""Byte-level BPE by a sentencepiece model that is serialised directly from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 200_000
"""Pre-tokens that a task remembers; the cache only saves time."""
CACHE_BYTES = 64
"""Longer pre-tokens are not remembered, which bounds the cache."""
PIECE_TOKENS = 1 << 16
OUT_BYTES = 4 << 20
"""Ids that a task hands on at a time."""


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (row.split() for row in lines.splitlines() if row)}


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model's protocol-buffer bytes: piece i+1 is the token of the i-th smallest rank.

    A piece is the token's bytes as letters, its score the negative rank, so sentencepiece's best merge is the
    one of the smallest rank. Nothing is normalised, no space is added, removed or replaced.
    """
    letters = byte_letters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("<unk>", 0.0, unknown)]
    pieces += [piece("".join(letters[b] for b in token), -rank, normal) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 0, bpe) + _field(40, 0, 0) + b"".join(_field(n, 0, -1) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normaliser)


@lru_cache(maxsize=2)
def newer_characters(pattern: str) -> frozenset[str]:
    """Letters and digits of a Unicode version that the regex module knows and the tiktoken library doesn't yet.

    Found by asking it: with byte pairs "a" + first byte (and "1" + first byte) as its only merges, an encoding
    merges the first two bytes just where its pattern keeps both characters in one match.
    """
    pairs = [bytes([b]) for b in range(256)] + [bytes([a, b]) for a in b"a1" for b in range(0xC2, 0xF5)]
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(pairs)}, special_tokens={})
    letter, digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    unknown = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"]
    return frozenset(c for c in unknown for lead, kind in (("a", letter), ("1", digit))
                     if kind.match(c) and probe.encode_ordinary(lead + c)[0] < 256)


class Codec:
    """Encodes and decodes by one vocabulary; made once in a task."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = read_ranks(vocabulary)
        self.ids = [rank for _, rank in sorted(ranks.items(), key=lambda x: x[1])]
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        # The inverse mapping: from a piece's letters back to its bytes.
        inverse = {letter: b for b, letter in self.letters.items()}
        self.tokens = {rank: bytes(inverse[c] for c in self.model.id_to_piece(i + 1)) for i, rank in enumerate(self.ids)}
        self.known: dict[str, bytes] = {}
        self.newer = newer_characters(pattern)
        self.any_newer = regex.compile("[" + "".join(self.newer) + "]") if self.newer else None
        self.unlike = dict.fromkeys(map(ord, self.newer), "\uE000")  # a character that is neither letter nor digit

    def pre_token(self, text: str) -> bytes:
        """The ids of one match, as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            made = struct.pack("<I", whole)
        else:
            found = self.model.encode(raw.decode("latin-1").translate(self.letters))
            made = struct.pack(f"<{len(found)}I", *[self.ids[i - 1] for i in found])
        if len(raw) <= CACHE_BYTES:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[text] = made
        return made

    def split(self, text: str) -> Iterator[str]:
        """The pattern's matches; newer letters and digits divide as the tiktoken library has it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.any_newer and self.any_newer.search(text):
                return (text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.unlike)))
        if len(text) <= PIECE_TOKENS:
            return iter(self.pattern.findall(text))
        return (m[0] for m in self.pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        known, new, out, matches = self.known.get, self.pre_token, [], self.split(text)
        while part := [known(m) or new(m) for m in islice(matches, PIECE_TOKENS)]:  # long texts in pieces
            out.append(b"".join(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def tokenise(docs: DataFrame, vocabulary: str, pattern: str, digests_only: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids (array of int) unless
    `digests_only`.

    `vocabulary` is the path of a rank file on the driver, read there and sent with the tasks (a few hundred
    KB, as much for any input). A null or empty text has no ids. Strings of special tokens are ordinary text. Row order
    and other columns play no part; repeated rows give repeated rows.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(ranks.value, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * (not digests_only)]
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids = own.encode(text or "")
                decoded = hashlib.sha256(own.decode(ids)).hexdigest()
                row = [doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded]
                rows.append(row if digests_only else [*row, np.frombuffer(ids, "<i4")])
                held += len(ids)
                if held > OUT_BYTES and not digests_only:  # ids of a whole batch would be many times its texts
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(run, schema + ("" if digests_only else ", ids array<int>"))


def detokenise(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    with open(vocabulary, "rb") as file:
        ranks = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            raw = [b"".join(own.tokens[int(i)] for i in (ids if ids is not None else ())) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [r.decode("utf-8", "replace") for r in raw]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")
