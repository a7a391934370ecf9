"""Surrogate keys and tie-break keys by digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of the digests that decide the order of equal scores.
ITEM_TIE_KEY = b"tripwright item ties 1"
USER_TIE_KEY = b"tripwright user ties 1"


def surrogate_key(*parts: Column | str) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer blocks of HMAC for a key of at most 64 bytes."""
    block = key.ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)


def tie_key(key: bytes, *parts: str) -> Column:
    """HMAC-SHA-256 of the NUL-joined parts, in hex."""
    inner, outer = (F.lit(bytearray(x)) for x in pads(key))
    message = F.encode(F.concat_ws("\0", *parts), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
