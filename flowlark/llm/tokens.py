"""Token ids of whole texts from public tokenizer files, with a bounded memory of the pieces seen before."""

from __future__ import annotations

import base64
import functools
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import utf8

#: How many pieces a worker remembers in each of its two generations.
REMEMBERED = 250_000


class Remembering:
    """Encodes pieces of texts, remembering the results of the pieces used lately.

    New results go to the young generation; when it is full it becomes the old one, and what was only in the old one is
    forgotten. ``encode`` gets a set of pieces and returns the little-endian uint32 ids of each, as bytes.
    """

    def __init__(self, encode: Callable[[set[str]], dict[str, bytes]], most: int = REMEMBERED):
        self.encode, self.most, self.young, self.old = encode, most, {}, {}

    def __call__(self, pieces: list[str]) -> bytes:
        """The ids of all pieces, one after the other."""
        known = self.young
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > self.most:
            self.old, self.young = known, {}
            known = self.young
        missing = set(pieces).difference(known)
        new = missing.difference(self.old)
        for piece in missing - new:
            known[piece] = self.old[piece]
        if new:
            known.update(self.encode(new))
        return b"".join(map(known.__getitem__, pieces))


def from_parts(split: Callable, part_ids: Callable[[str], bytes], most: int = REMEMBERED) -> Remembering:
    """Remembers pieces that ``split`` cuts into parts, with the parts: a word with a comma costs nothing new after the word."""

    def encode(pieces: set[str]) -> dict[str, bytes]:
        out, young, old = {}, held.young, held.old
        for piece in pieces:
            parts = split(piece)
            for x in parts:
                if x not in young:
                    young[x] = old[x] if x in old else part_ids(x)
            if len(parts) != 1:
                out[piece] = b"".join([young[x] for x in parts])
        return out

    held = Remembering(encode, most)
    return held


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def public(name: str) -> str:
    """Where the tokenizer files of this machine are; every worker has them, as it has its libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Byte-level BPE: splitting ------------------------------------------------------------------------------------------

#: How the byte-level vocabularies split texts before merging (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space: there, texts can't simply be cut at their spaces.
_MIXED = re.compile(r" \s|\s ")


def space_pieces(text: str) -> list[str] | None:
    """The text cut before each space, where no token can cross: each space has black characters on both sides, and a
    token that begins with a space begins there. None if the text has other spaces than that."""
    if _MIXED.search(text) or text[-1:] == " ":
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


@functools.cache
def rank_encoding(path: str):
    """A tiktoken encoding of a rank file; the ids are those of the same vocabulary in the tokenizers library."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


@functools.cache
def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def library_ids(path: str, texts: list[str]) -> list[bytes]:
    got = library_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    return [np.array(e.ids, np.uint32).tobytes() for e in got]


# White-space-free byte-level BPE -------------------------------------------------------------------------------------

#: How the one file of this kind splits lower-case texts before merging (fixed value); white space is dropped.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: In Latin-1 texts without these - the separators U+001C to U+001F and the specials' opening - lower-casing, normal forms and
#: white space are the same in Python and in the tokenizers library, and no token crosses white space.
_ODD = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"<|")
_LATIN = bytes(range(256)).decode("latin-1")
_LOWER = _LATIN.lower().encode("latin-1")
#: White space, letters, digits and the rest, as the pattern tells them apart.
_KIND = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if unicodedata.category(c)[0] == "N" else 3 for c in _LATIN], np.uint8)
#: How many parts are encoded as one line: in longer lines, the library takes longer for each.
_LINE = 200


def _plain(text: str) -> bytes | None:
    """The text in lower-case Latin-1; None if it has other characters or anything odd."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if any(x in data for x in _ODD) else data.translate(_LOWER)


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of lower-case Latin-1 that ends with two line feeds begin the pattern's parts, and which are in parts."""
    kind = _KIND[data]
    new = kind == 2
    new[0] = True
    new[1:] |= kind[1:] != kind[:-1]
    # An apostrophe that begins a part takes the letters of a contraction after it, and the other letters are a part.
    at = np.flatnonzero(new & (data == ord("'")))
    one, two = data[at + 1], data[at + 2]
    short = np.isin(one, list(b"stmd"))
    long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    new[at[short | long] + 1] = False
    new[at[short] + 2] = True
    new[at[long] + 3] = True
    black = kind > 0
    return new & black, black


@functools.cache
def _part_encoder(path: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
    """Gives all ids of lower-case Latin-1 parts, which lie one after the other with a space between any two and begin at
    the given places, and each one's number of ids, by the library's own model; None for a file that cuts texts in another way."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    spec = load(path)
    kinds = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
    if kinds != ["Split", "ByteLevel"] or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("a file that lower-cases, drops white space and works on bytes is needed")
    if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _WORD_PATTERN}:
        return None
    symbols = str.maketrans({chr(b): s for s, b in byte_of_symbol().items() if b != ord(" ")})
    lines = Tokenizer(library_tokenizer(path).model)
    lines.pre_tokenizer = WhitespaceSplit()
    suffix = spec["model"].get("end_of_word_suffix")
    last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
    last[[i for s, i in spec["model"]["vocab"].items() if suffix and s.endswith(suffix)]] = True

    def encode(parts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, at = parts.tobytes().decode("latin-1"), [*starts[::_LINE].tolist(), len(parts) + 1]
        texts = [text[a : b - 1].encode().decode("latin-1").translate(symbols) for a, b in itertools.pairwise(at)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in lines.encode_batch_fast(texts, add_special_tokens=False)])
        # A part's last token has the suffix. Should another token look like one, there are more of them than parts.
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) == len(starts):
            return ids, np.diff(ends, prepend=0)
        each = [[t.id for t in lines.model.tokenize(x)] for line in texts for x in line.split(" ")]
        return np.array([k for x in each for k in x], np.uint32), np.array([len(x) for x in each])

    return encode


def white_space_ids_of(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text by a tokenizer that drops white space. The parts that its pattern cuts are numbered over all texts,
    and each different one is encoded by the library once."""
    encode = _part_encoder(path)
    plain = [encode and _plain(text) for text in texts]
    found = [np.frombuffer(library_ids(path, [text])[0], np.uint32) if x is None else np.zeros(0, np.uint32) for text, x in zip(texts, plain, strict=True)]
    mine = [k for k, x in enumerate(plain) if x is not None]
    data = np.frombuffer(b"".join([plain[k] + b"\n" for k in mine]) + b"\n", np.uint8)
    begin, black = _cut(data)
    starts, letters = np.flatnonzero(begin), data[black]
    if not len(starts):
        return found
    bounds = np.append(np.flatnonzero(begin[black]), len(letters))
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    letters, at = utf8(parts.dictionary)
    ids, sizes = encode(np.insert(letters, at[1:-1], ord(" ")), at[:-1] + np.arange(len(at) - 1))
    # The ids of each different part lie from ``heads`` on in ``ids``, those of each part up to ``tails`` in ``flat``.
    number = parts.indices.to_numpy()
    heads, counts = np.cumsum(sizes) - sizes, sizes[number]
    tails = np.cumsum(counts)
    flat = ids[np.repeat(heads[number] + counts - tails, counts) + np.arange(tails[-1])]
    firsts = np.searchsorted(starts, np.cumsum([0, *[len(plain[k]) + 1 for k in mine]]))
    cuts = np.append(0, tails)[firsts].tolist()
    for k, a, b in zip(mine, cuts[:-1], cuts[1:], strict=True):
        found[k] = flat[a:b]
    return found


def white_space_ids(path: str, text: str) -> bytes:
    return white_space_ids_of(path, [text])[0].tobytes()


def rank_ids(path: str, library_path: str, text: str) -> np.ndarray:
    """Ids by a rank file; a text that its library can't take goes to the tokenizers library."""
    try:
        return rank_encoding(path).encode_to_numpy(text, allowed_special="all")
    except BaseException as e:  # a panic of the library's regex engine on very long runs is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.frombuffer(library_ids(library_path, [text])[0], np.uint32)
