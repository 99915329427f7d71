"""Byte-level BPE by the tiktoken library with a rank file that is on every executor.

Texts over LONG characters are cut where the split expression always starts a new match: before a space that
follows a character that isn't white space, and before the last character of a run of white space that text
follows. Pieces are then encoded one after the other; ids are those of the whole text.

Null and empty texts have no ids and no bytes; special tokens that stand in a text are text. A long text without any
white space is encoded in one call. Merges of equal rank are taken from the left, as the library does. Repeated rows
give repeated results, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array

from pyspark.sql import DataFrame

from .common import fields, id_and_text, per_batch

#: Characters of a text that is encoded in one call.
LONG = 1 << 16

#: A safe cut (before the space), or a long run of white space, whose last character belongs to what follows.
#: U+001C-U+001F are white space to Python and not to tiktoken.
_SAFE = re.compile(r"(?<=[\S\x1c-\x1f]) (?=[\S\x1c-\x1f])")
_RUN = re.compile(r"[^\S\x1c-\x1f]{256,}(?=[\S\x1c-\x1f])")

_codecs: dict = {}


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for piece in cuts(text):
            out += self.encoding.encode_ordinary(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; they need not be whole characters."""
        return self.encoding.decode_bytes(ids)


def cuts(text: str, size: int = LONG) -> list[str]:
    """A long text in pieces that the split expression never joins."""
    at, marks = 0, {m.end() - 1 for m in _RUN.finditer(text)}
    while (found := _SAFE.search(text, at + size)) is not None:
        at = found.start()
        marks.add(at)
    edges = [0, *sorted(marks), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b]


def codec(ranks_path: str, pattern: str) -> Codec:
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: What encode() can return for each document.
OUTPUTS = {
    "n_tokens": ("bigint", lambda text, ids, back: len(ids)),
    "ids": ("array<int>", lambda text, ids, back: ids),
    "ids_le32": ("binary", lambda text, ids, back: little_endian(ids)),
    "ids_sha256": ("string", lambda text, ids, back: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()),
    "decoded": ("binary", lambda text, ids, back: back(ids)),
    "decoded_sha256": ("string", lambda text, ids, back: hashlib.sha256(back(ids)).hexdigest()),
}


def encode(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id and the named OUTPUTS of every whole text."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        own = codec(ranks_path, pattern)
        out = {"doc_id": rows["doc_id"]} | {name: [] for name in outputs}
        for text in rows["text"]:
            ids = own.encode(text)
            for name in outputs:
                out[name].append(OUTPUTS[name][1](text, ids, own.decode))
        return out

    return per_batch(id_and_text(docs), run, fields(docs, *((name, OUTPUTS[name][0]) for name in outputs)))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of `ids`; null ids give no bytes."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        own = codec(ranks_path, pattern)
        return {"doc_id": rows["doc_id"], "decoded": [own.decode(ids or []) for ids in rows["ids"]]}

    return per_batch(encoded.select("doc_id", "ids"), run, fields(encoded, ("decoded", "binary")))
