"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Of all ways to cut a prefix into tokens exactly one is what merging would give, and its last token is the only one
that matches the end of the prefix and is compatible with the last token of what is left before it. So one table of
last tokens, filled from left to right, replaces the merge loop: an automaton lists every token that ends at a
position, the pair test picks one of them, and back-pointers give the ids from the right end.

Two neighbouring tokens are compatible when merging their joint bytes would not join across the boundary. The test
walks down the merges that built both tokens, latest merge first, and looks for a merge across the boundary that
would have come before them.

A text is cut into pieces first, as the tokenizer does; tokens never cross pieces. Pieces repeat, so each worker keeps
those it has seen, two generations of at most ``CACHE`` pieces: memory is bounded, and results do not depend on it.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tongueprint.llm.common import map_rows

CACHE = 300_000

# Fixed value: how byte-level tokenizers of this family cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, following = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else following))
        following += byte not in printable
    return letters


class Tokens:
    """Vocabulary and merges of a tokenizer file. Inside, tokens are numbered in the order merging makes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        number = {letter: byte for byte, letter in enumerate(letters)}
        self.parts: list[tuple[int, int]] = [(byte, byte) for byte in range(256)]
        self.bytes: list[bytes] = [bytes([byte]) for byte in range(256)]
        self.ids: list[int] = [vocab[letter] for letter in letters]
        self.joined: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = left + right
            if made in number:
                raise ValueError(f"two merges make {made!r}; a prefix would have no unique last token")
            pair = number[left], number[right]
            number[made] = self.joined[pair] = len(self.parts)
            self.parts.append(pair)
            self.bytes.append(bytes(byte_of[letter] for letter in made))
            self.ids.append(vocab[made])
        self.special = {token["content"]: token["id"] for token in spec.get("added_tokens", [])}
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, content in enumerate(self.bytes):
            self.matches.add_word(content.decode("latin-1"), token)
        self.matches.make_automaton()
        self.lengths = [len(content) for content in self.bytes]
        self.known_pairs: dict[int, bool] = {}
        by_id = {token_id: content for token_id, content in zip(self.ids, self.bytes)}
        by_id |= {token_id: content.encode() for content, token_id in self.special.items()}
        self.flat, self.starts, self.sizes = flatten(by_id)
        cut = "|".join(regex.escape(content) for content in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({cut})") if cut else None
        self.pieces = regex.compile(PIECES)
        self.cache = Pieces(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two."""
        latest = len(self.parts)
        while True:
            across = self.joined.get((left, right), latest)
            if across < latest:
                return False
            # Undo the later of the two merges; what is undone bounds the merges across that would have come first.
            if left > right:
                undone, (_, left_part) = left, self.parts[left]
                right_part = right
            else:
                undone, (right_part, _) = right + 1, self.parts[right]
                left_part = left
            if left_part == left and right_part == right:
                # A single byte: only the other side can still be undone.
                if left > right:
                    undone, right_part = right + 1, self.parts[right][0]
                else:
                    undone, left_part = left, self.parts[left][1]
                if left_part == left and right_part == right:
                    return True
            latest, left, right = undone, left_part, right_part

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        last = [-1] * (len(piece) + 1)
        known, lengths = self.known_pairs, self.lengths
        for position, token in self.matches.iter(piece.decode("latin-1")):
            end = position + 1
            if last[end] >= 0:
                continue
            start = end - lengths[token]
            if start:
                before = last[start]
                key = before << 20 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) > CACHE:
                        known.clear()
                    fits = known[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        ids, end = [], len(piece)
        while end:
            token = last[end]
            ids.append(self.ids[token])
            end -= lengths[token]
        return tuple(reversed(ids))

    def encode(self, text: str) -> np.ndarray:
        cache = self.cache
        parts = self.specials.split(text) if self.specials else [text]
        out: list = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append((self.special[part],))
            else:
                out.extend(map(cache.__getitem__, self.pieces.findall(part)))
        return np.fromiter(chain.from_iterable(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the tokens one after another; bytes that are no UTF-8 become the replacement character."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[places + shift].tobytes().decode("utf-8", "replace")


class Pieces(dict):
    """Pieces encoded so far. A full generation becomes the old one; pieces met again move to the new one."""

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens = tokens
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.tokens.encode_piece(piece.encode("utf-8"))
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def flatten(by_id: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in one array of bytes, with the start and size of each id."""
    size = max(by_id) + 1
    sizes = np.zeros(size, dtype=np.int64)
    for token_id, content in by_id.items():
        sizes[token_id] = len(content)
    flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), dtype=np.uint8)
    return flat, np.cumsum(sizes) - sizes, sizes


@lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    return Tokens(path)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col array<int>`` to every row; a null text has no ids, like an empty one.

    Special tokens in the text get their own id. Other columns stay; a column of the new name is replaced.
    """
    return _add(df.drop(ids_col), path, text_col, ids_col, "array<int>", _encoder)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col string`` to every row, special tokens included; null ids decode to the empty text."""
    return _add(df.drop(text_col), path, ids_col, text_col, "string", _decoder)


def _encoder(tokens: Tokens):
    def column(values: pa.Array) -> pa.Array:
        return _lists([tokens.encode(text.as_py() or "") for text in values])

    return column


def _decoder(tokens: Tokens):
    def column(values: pa.Array) -> pa.Array:
        nothing = np.zeros(0, dtype=np.int32)
        texts = [tokens.decode(v.values.to_numpy(zero_copy_only=False) if v.is_valid else nothing) for v in values]
        return pa.array(texts, pa.string())

    return column


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, dtype=np.int32)])))


def _add(df: DataFrame, path: str, source: str, name: str, kind: str, build) -> DataFrame:
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes), f"`{name}` {kind}"])
    place = df.columns.index(source)

    def make():
        column = build(load(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*batch.columns, column(batch.column(place))], names=[*batch.schema.names, name]
            )

        return step

    return map_rows(df, make, schema)
