"""Keyed message signature (HMAC-SHA256) out of built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 64


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer key blocks; a secret longer than a block is hashed first."""
    key = secret.encode()
    if len(key) > BLOCK_BYTES:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK_BYTES, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex digest of ``body`` (text or bytes) under a constant secret."""
    inner_pad, outer_pad = (F.unhex(F.lit(p.hex())) for p in hmac_pads(secret))
    inner = F.sha2(F.concat(inner_pad, body.cast("binary")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def signature_of(body: Column, secret: str) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(body, secret))
