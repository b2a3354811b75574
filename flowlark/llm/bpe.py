"""Exact byte-pair encoding in linear time by backtracking, and decoding by an offset table.

The encoder never merges. An Aho-Corasick automaton over all tokens gives the longest token at each place. Tokens are
taken from left to right, longest first; a token may follow another only if the two are compatible: if merging the
bytes of both would end in just these two. When nothing fits, the encoder steps back, marks the place as dead, and
tries a shorter token before it. What it ends with is the one sequence whose neighbours are all compatible, which is
what the merges give. Pair compatibility is a table filled on demand.

Within a text, encoding is by the pieces that the vocabulary's pattern makes; a worker remembers those it met lately.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .tokens import BYTE_PATTERN, byte_of_symbol, from_parts, load, space_pieces

CHUNK = 1 << 20
#: Pairs whose compatibility is remembered before the table is begun anew.
PAIRS = 1 << 20


class Tables:
    """The tables of a byte-level BPE file in the tokenizers library's format. Tokens are numbered by age here: bytes
    first, then merges in their order; ``ids`` turns these numbers into the vocabulary's ids."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        spec = load(path)
        model, symbols = spec["model"], byte_of_symbol()
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        raw = lambda token: bytes(map(symbols.__getitem__, token)).decode("latin-1")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        names = sorted((s for s in symbols if s in model["vocab"]), key=model["vocab"].__getitem__)
        age = {s: k for k, s in enumerate(names)}
        self.first_merge = len(names)
        self.left, self.right = [-1] * len(names), [-1] * len(names)
        self.merged: dict[int, int] = {}
        for a, b in merges:
            age.setdefault(a + b, len(names))
            if age[a + b] == len(names):
                names.append(a + b)
                self.left.append(age[a])
                self.right.append(age[b])
            self.merged[age[a] << 32 | age[b]] = age[a + b]
        self.text = [raw(s) for s in names]
        self.length = [len(t) for t in self.text]
        self.number = {t: k for k, t in enumerate(self.text)}
        self.ids = np.array([model["vocab"][s] for s in names], np.uint32)
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.text):
            self.automaton.add_word(t, (len(t), k))
        self.automaton.make_automaton()
        self.pattern = regex.compile(BYTE_PATTERN)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        # Decoding: the bytes of all tokens by id, one after the other, and where each begins.
        by_id = {int(i): t.encode("latin-1") for i, t in zip(self.ids, self.text, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        top = max(by_id, default=-1) + 1
        self.blob, self.offsets = table([by_id.get(i, b"") for i in range(top)])
        self.decimals, self.decimal_offsets = table([b"%d," % i for i in range(top)])
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = from_parts(self.pattern.findall, self.part_ids)

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the bytes of a and b end in a and b? Undoes their merges, the youngest first, and looks whether
        the two tokens that meet at the border would have been merged before the merges that were undone took place.
        Merges of one rule run from the left: at equal age the one within a comes before, the one within b after."""
        key = a << 32 | b
        if (got := self.pairs.get(key)) is not None:
            return got
        x, y, before, fine = a, b, 1 << 62, True
        while True:
            if self.merged.get(x << 32 | y, 1 << 62) < before:
                fine = False
                break
            if x > y and x >= self.first_merge:
                x, before = self.right[x], x
            elif y >= self.first_merge:
                y, before = self.left[y], y + 1
            else:
                break
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def prefix(self, token: int) -> int:
        """The longest token that the token begins with, besides itself; -1 if none."""
        if (got := self.shorter.get(token)) is None:
            t = self.text[token]
            got = next((self.number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.number), -1)
            self.shorter[token] = got
        return got

    def encode_piece(self, text: str) -> list[int]:
        """Token numbers of one piece, given as Latin-1 characters for its bytes."""
        longest = [-1] * (len(text) + 1)
        for end, (n, token) in self.automaton.iter(text):
            longest[end - n + 1] = token  # ends ascend, so the last at a place is its longest
        taken: list[int] = []
        dead = bytearray(len(text) + 1)
        length, at, token = self.length, 0, longest[0]
        while at < len(text):
            last = taken[-1] if taken else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.prefix(token)
            if token >= 0:
                taken.append(token)
                at, token = end, longest[end]
            elif last < 0:
                raise ValueError("the vocabulary lacks a byte")
            else:
                dead[at] = 1
                taken.pop()
                at -= length[last]
                token = last
        return taken

    def part_ids(self, part: str) -> bytes:
        return self.ids[self.encode_piece(part.encode().decode("latin-1"))].tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a text; the special tokens' strings in it become their ids."""
        if self.special_pattern and self.special_pattern.search(text):
            out = [
                np.uint32(self.special[x]).tobytes() if i % 2 else self.encode_plain(x)
                for i, x in enumerate(self.special_pattern.split(text))
            ]
            return b"".join(out)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        pieces = space_pieces(text)
        return self.pieces(self.pattern.findall(text) if pieces is None else pieces)


@functools.cache
def tables(path: str) -> Tables:
    return Tables(path)


def table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=offsets[1:])
    return np.frombuffer(b"".join(items), np.uint8), offsets


def gather(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of an offset table for the ids, one after the other, and where each begins."""
    sizes = offsets[ids + 1] - offsets[ids] if ids.dtype == np.int64 else offsets[ids.astype(np.int64) + 1] - offsets[ids]
    ends = np.cumsum(sizes)
    where = np.repeat(offsets[ids] - (ends - sizes), sizes)
    where += np.arange(len(where))
    return blob[where], np.append(0, ends)


def decode_bytes(t: Tables, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gather(t.blob, t.offsets, ids)


def encode_chunk(t: Tables, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin."""
    coded = [t.encode(x or "") for x in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in coded], out=starts[1:])
    return np.frombuffer(b"".join(coded), np.uint32).astype(np.int64), starts


def map_encoded(df: DataFrame, path: str, make: Callable, schema: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes each whole text (null: empty) and hands chunks of rows to ``make(tables, doc_ids, ids, starts)``, which
    returns the result's other columns; doc_id comes first. Ids stay in the task unless ``make`` returns them."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", *[x.split()[0] for x in schema.split(",")]]

    def run(batches):
        t = tables(path)
        for part in chunks(batches, most=CHUNK):
            ids, starts = encode_chunk(t, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *make(t, ids, starts)], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have none. Very long texts are encoded whole. Rows
    and ids may repeat; an empty table gives no rows; other columns are not read."""

    def listed(t, ids, starts):
        return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))]

    return map_encoded(df, path, listed, "ids array<int>", text_col, id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of rows of ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null: empty.
    Rows and ids may repeat; an empty table gives no rows; other columns are not read."""
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        t = tables(path)
        for part in batches:
            lists = part.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
            data, at = decode_bytes(t, ids)
            cut = at[starts]
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
