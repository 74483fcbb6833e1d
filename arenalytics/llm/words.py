"""Words of UTF-8 texts: runs of ASCII digits, letters and all other code points, with A-Z in lower case."""

from __future__ import annotations

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def byte_words(text: bytes | None) -> list[bytes]:
    """Words of a text; null has none. Bytes of code points beyond ASCII are never parted, so bytes do for code points."""
    return text.translate(FOLD).split() if text else []
