"""Ids of the tokenizers library, with a bounded cache of the pieces that its pre-tokenizer makes.

Both vocabularies split text by a regular expression before any merge, so the ids of a text are the ids of its
pieces in a row. For texts of Latin-1 characters the pieces come from the same expression written out for those
characters; each distinct piece is encoded once by the library's model and kept. Any other text goes to the
library whole, and so does every text that holds an added token such as <|endoftext|>, which the library's default
makes one id wherever it stands. The results are the library's either way.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

BIG = sys.byteorder == "big"

#: Letters, numbers and white space among the Latin-1 characters.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
WHITE = "\t-\r \x85\xa0"

#: The steps of a vocabulary file, before its model, for which the splits below hold.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
KNOWN = {
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                _BYTE_LEVEL | {"use_regex": False},
            ],
        },
    ),
    "byte": (None, _BYTE_LEVEL | {"use_regex": True}),
}

#: The splits of the two kinds of vocabulary over Latin-1; runs of letters stand first, being the most frequent.
PIECES = {
    "word": re.compile(f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{WHITE}{LETTER}{NUMBER}]+"),
    "byte": re.compile(
        f" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBER}]+| ?[^{WHITE}{LETTER}{NUMBER}]+"
        f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    ),
}


def printable_bytes() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers.

    Two generations of at most `limit` pieces each: when the young one is full it becomes the old one, and pieces
    that are met again move back; what isn't met for a whole generation is forgotten.
    """

    def __init__(self, model, limit: int):
        # encode(text, pair, is_pretokenized, add_special_tokens)
        self.encode, self.limit, self.shown, self.old = model.encode, limit, printable_bytes(), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            seen = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.shown)
            ids = packed(self.encode(seen, None, False, False).ids)
            if len(piece) > 48:
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if BIG:
        out.byteswap()
    return out.tobytes()


class Encoder:
    def __init__(self, path: str, cached_pieces: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.kind = self._kind(spec)
        #: Lower-case contents of added tokens, as some are looked for after the text was made lower case.
        self.added = [token["content"].lower() for token in spec["added_tokens"]]
        if self.kind:
            bare = spec | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "decoder")) | {"added_tokens": []}
            model = Tokenizer.from_str(json.dumps(bare))
            self.split, self.pieces = PIECES[self.kind].findall, Pieces(model, cached_pieces)

    @staticmethod
    def _kind(spec: dict) -> str | None:
        """Which of the known splits a tokenizer file has, if any; every field of its steps counts."""
        plain = spec["post_processor"] is None and spec["truncation"] is None and spec["padding"] is None
        for kind, steps in KNOWN.items():
            if plain and (spec["normalizer"], spec["pre_tokenizer"]) == steps:
                return kind
        return None

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, little-endian unsigned 32-bit integers."""
        if self.kind:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                lower = text.lower()
                if not any(token in lower for token in self.added):
                    return b"".join(map(self.pieces.__getitem__, self.split(lower if self.kind == "word" else text)))
        return packed(self.whole.encode(text, add_special_tokens=False).ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; it stays for the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
