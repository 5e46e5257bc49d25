"""Token ids of whole texts by a public tokenizer file, packed as little-endian unsigned 32-bit integers.

The word tokenizer of the default file cuts texts at white space before anything else, so equal pieces between white
space have equal ids wherever they stand: ids are kept by piece and a text is a join of kept ids. That path serves
texts of plain ASCII and Latin-1 letters; a text with any other character, or a file of another kind, goes through
the tokenizer as a whole.
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np

from .common import per_process

DEFAULT = "word_bpe_49k.json"
KEPT_PIECES = 250_000  # of a generation; the one before stays too, so frequent pieces are never lost
_LETTERS = bytes([*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_PLAIN = bytes([9, 10, 13, *range(32, 127)]) + _LETTERS
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The tokenizer parts that the fast path stands for.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.fast = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])] == _NORMALIZERS and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed"
        self.kept: dict[str, bytes] = {}
        self.kept_before: dict[str, bytes] = {}
        self.kept_words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words_before.get(word)
        if ids is None:
            own = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE))]
            ids = pack(f"<{len(own)}I", *own)
        if len(self.kept_words) >= KEPT_PIECES:
            self.words_before, self.kept_words = self.kept_words, {}
        self.kept_words[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.kept_before.get(piece)
        if ids is None:
            known = self.kept_words
            ids = known.get(piece) or self._word(piece) if piece.isalpha() else b"".join([known.get(w) or self._word(w) for w in _PIECE.findall(piece)])
        if len(self.kept) >= KEPT_PIECES:
            self.kept_before, self.kept = self.kept, {}
        self.kept[piece] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The text's ids, four bytes each."""
        if not text:
            return b""
        own = text.decode()
        if self.fast:
            try:
                plain = not own.encode("latin-1").translate(None, _PLAIN)
            except UnicodeEncodeError:
                plain = False
            if plain:
                pieces = own.lower().split()
                found = list(map(self.kept.get, pieces))
                if None in found:
                    found = [self._piece(p) if x is None else x for p, x in zip(pieces, found, strict=True)]
                return b"".join(found)
        return np.array(self.whole.encode(own, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    return per_process(f"encoder:{path}", lambda: Encoder(path))
