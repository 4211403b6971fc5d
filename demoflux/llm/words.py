"""Words of whole texts as bytes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20  # bytes of a text that are split into words at once

#: Letters A-Z become small; separators of words become blanks.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
MARKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def word_table(separators: bytes) -> bytes:
    """A translation table that makes A-Z small and every separator a blank."""
    return bytes(0x20 if (small := LOWER[b]) in separators else small for b in range(256))


def word_pieces(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The text's words in order, in lists that each come from about `piece` bytes. UTF-8 letters beyond ASCII are kept."""
    clean = text.translate(table)
    begin = 0
    while begin < len(clean):
        end = clean.find(b" ", begin + piece)
        end = len(clean) if end < 0 else end
        words = clean[begin:end].split()
        if words:
            yield words
        begin = end
