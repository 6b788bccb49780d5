"""Keyed hashes as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # bytes of a SHA-256 block


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer key blocks of HMAC-SHA256."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string (in UTF-8) or binary column as lowercase hex; null stays null."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def pseudonym(c: Column, key: bytes, length: int = 12) -> Column:
    """The first hex digits of the keyed hash of a value as text: not invertible without the key, equal for equal ids."""
    return F.substring(hmac_sha256(c.cast("string"), key), 1, length)
