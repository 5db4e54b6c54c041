"""Content encryption with per-organization keys."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake import fixed_values as fx

_IV, _TAG = 12, 16


def derive_key(master: bytes, org: str, info: str) -> bytes:
    """32-byte HKDF-SHA256 key of one organization (salt = organization id)."""
    if len(master) < 32:
        raise ValueError("the content master key must have at least 32 bytes")
    pseudo_random = hmac.new(org.encode(), master, hashlib.sha256).digest()
    return hmac.new(pseudo_random, info.encode() + b"\x01", hashlib.sha256).digest()


def key_id(org: str) -> str:
    return fx.KEY_ID_FORMAT.format(digest=hashlib.sha256(org.encode()).hexdigest()[: fx.KEY_ID_DIGITS])


def encrypt_content(plain: Column, key: Column) -> Column:
    """AES-256-GCM under a random IV, as base64 of IV, tag, ciphertext."""
    # aes_encrypt emits IV, ciphertext, tag; the stored layout has the tag second.
    sealed = F.transform(
        F.array(F.aes_encrypt(F.encode(plain, "UTF-8"), key, F.lit("GCM"))),
        lambda b: F.base64(
            F.concat(
                F.substring(b, F.lit(1), F.lit(_IV)),
                F.substring(b, F.length(b) - (_TAG - 1), F.lit(_TAG)),
                F.substring(b, F.lit(_IV + 1), F.length(b) - (_IV + _TAG)),
            )
        ),
    )
    return F.element_at(sealed, 1)


def decrypt_content(stored: Column, key: Column) -> Column:
    raw = F.unbase64(stored)
    head = _IV + _TAG
    reordered = F.concat(
        F.substring(raw, F.lit(1), F.lit(_IV)),
        F.substring(raw, F.lit(head + 1), F.length(raw) - head),
        F.substring(raw, F.lit(_IV + 1), F.lit(_TAG)),
    )
    return F.decode(F.aes_decrypt(reordered, key, F.lit("GCM")), "UTF-8")
