"""Identities: canonical numbers and keyed pseudonyms."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from baraza.functions.text import strip

_BLOCK = 64


def canonical_number(value: Column) -> Column:
    """Trim, drop a ``whatsapp:`` prefix and put ``+`` in front."""
    bare = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), "^whatsapp:", "")
    return F.when((bare == "") | bare.startswith("+"), bare).otherwise(F.concat(F.lit("+"), bare))


def _pads(key: bytes) -> tuple[str, str]:
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def pseudonym(value: Column, secret: bytes) -> Column:
    """Keyed hash (HMAC-SHA256, hex) with two nested built-in digests."""
    inner_pad, outer_pad = _pads(secret)
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)
