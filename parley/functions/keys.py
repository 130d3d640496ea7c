"""Keyed and plain digests as column expressions; equal to Python's hmac and hashlib."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column under a driver-side secret."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key)
    outer = bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def hmac_id(secret: str, kind: str, *parts, length: int = 24) -> Column:
    """``kind_<hex>`` over the parts; null parts count as empty."""
    message = F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(kind + "_"), F.substring(hmac_sha256(secret, message), 1, length))


def content_digest(text) -> Column:
    return F.substring(F.sha2(_col(text).cast("binary"), 256), 1, 24)


#: Hundredths below which a key belongs to a split.
SPLIT_EDGES = {"train": 70, "validation": 85, "test": 100}


def split_bucket(digest: str) -> int:
    """0 to 99 by the first 32 bits of a hex digest."""
    return int(digest[:8], 16) % 100


def split_of(bucket: int) -> str:
    return next(name for name, edge in SPLIT_EDGES.items() if bucket < edge)


def stable_split(secret: str, key) -> Column:
    """train (70), validation (15) or test (15): a key never changes its split."""
    bucket = F.conv(F.substring(hmac_sha256(secret, _col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < SPLIT_EDGES["train"], "train").when(bucket < SPLIT_EDGES["validation"], "validation").otherwise("test")


def phone_hmac(secret: str, phone, account=None) -> Column:
    """Digest of a phone: global, or within one account; the two never meet. Null phones have none."""
    scope = [F.lit("global")] if account is None else [F.lit("account"), _col(account)]
    return F.when(_col(phone).isNotNull(), hmac_id(secret, "phone", *scope, phone))


def key_fingerprint(secret: str, label: str = "parley-key-fingerprint-v1") -> str:
    """What identifies a secret without showing it; for guards between runs."""
    import hmac

    return hmac.new(secret.encode(), label.encode(), hashlib.sha256).hexdigest()
