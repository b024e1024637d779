"""Bounded text of results: truncation by lines and bytes, and lossless pages by cursor."""

from __future__ import annotations

import hashlib
import re

MAX_LINES, MAX_BYTES = 198, 11_400


class StaleCursor(ValueError):
    pass


def prefix(text: str, most: int) -> str:
    """The longest prefix of at most ``most`` UTF-8 bytes that does not split a character."""
    return text.encode("utf-8", "surrogatepass")[: max(0, most)].decode("utf-8", "ignore")


def truncate(text: str, lines: int = MAX_LINES, size: int = MAX_BYTES) -> tuple[str, bool]:
    """Cut by lines, then by bytes; and whether anything was cut."""
    out = "\n".join(text.split("\n")[:lines])
    out = prefix(out, size) if len(out.encode("utf-8", "surrogatepass")) > size else out
    return out, out != text


def page(text: str, cursor: str | None = None, size: int = MAX_BYTES) -> tuple[str, str | None]:
    """A page and the cursor of the next one (None at the end). Cursors name the text's hash and an offset; one of another text is stale."""
    body, digest, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), 0
    if cursor is not None:
        m = re.fullmatch(r"([0-9a-f]{64}):(\d+)", cursor)
        if not m or m[1] != digest or int(m[2]) > len(body):
            raise StaleCursor(cursor)
        at = int(m[2])
    end = min(len(body), at + size)
    while at < end < len(body) and body[end] & 0xC0 == 0x80:
        end -= 1
    if end == at < len(body):  # a character larger than the page
        end = at + 1
        while end < len(body) and body[end] & 0xC0 == 0x80:
            end += 1
    return body[at:end].decode("utf-8", "surrogatepass"), f"{digest}:{end}" if end < len(body) else None
