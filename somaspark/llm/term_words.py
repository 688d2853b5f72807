"""Words of letters, digits and everything beyond ASCII, in bytes; A-Z are lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

#: Upper case goes to lower case, every other ASCII character but letters and digits to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK = 1 << 22


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words in order, in lists of about BLOCK bytes, so that a very long text needs bounded memory."""
    data, at = plain(text), 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
