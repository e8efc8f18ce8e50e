"""Words of a text: lower-cased maximal runs of a-z and 0-9."""

from __future__ import annotations

#: All bytes but a-z and 0-9 become blanks; after lower-casing, bytes of other characters are blanks too.
_TABLE = bytes(b if chr(b).isascii() and (chr(b).isdigit() or chr(b).islower()) else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of `text` in order, as ASCII bytes."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()
