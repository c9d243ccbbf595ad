"""Identifiers and fingerprints: hashes over separator-joined parts, as Columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZE_VERSION = 2


def _le32(value: Column) -> Column:
    """A number's four bytes, least first."""
    h = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def _joined(*parts: Column) -> Column:
    """Bytes of the parts, each followed by the unit separator."""
    end = F.unhex(F.lit("1F"))
    return F.concat(*(x for p in parts for x in (p.cast("binary"), end)))


def drawer_id(wing: Column, room: Column, source: Column, chunk: Column, domain: str | None = None) -> Column:
    """32 hex digits over wing, room, source, chunk index and normalisation version; diverted records hash under a domain."""
    head = _joined(*([F.lit(domain)] if domain else []), wing, room, source)
    body = F.concat(head, _le32(chunk), F.unhex(F.lit("1F")), _le32(F.lit(NORMALIZE_VERSION)))
    return F.substring(F.sha2(body, 256), 1, 32)


def triple_id(subject: Column, predicate: Column, obj: Column, valid_from: Column) -> Column:
    """32 hex digits over a fact's subject, predicate, object and start."""
    return F.substring(F.sha2(_joined(subject, predicate, obj, F.coalesce(valid_from, F.lit(""))), 256), 1, 32)


def content_fp(text: Column) -> Column:
    """SHA-256 of the text."""
    return F.sha2(text, 256)


def hmac(key: bytes, text: Column) -> Column:
    """HMAC-SHA-256 of a text, in hex, on the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def fingerprint(key: Column, secret: bytes | None = None) -> Column:
    """16 bytes of hash over a match key, for finding equal texts; with a secret only its holders can make it."""
    head = F.concat(F.lit("fp").cast("binary"), F.unhex(F.lit("1F")), key.cast("binary"))
    return F.substring(F.sha2(head, 256) if secret is None else hmac(secret, head), 1, 32)
