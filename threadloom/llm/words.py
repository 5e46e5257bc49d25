"""Word lists of UTF-8 bytes, by C-level byte operations only."""

from __future__ import annotations

#: A-Z lower-cased; digits, letters and all bytes of non-ASCII characters stay; every other byte parts words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_WORD).split()


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes.lower and bytes.split are ASCII-only)."""
    return text.lower().split()
