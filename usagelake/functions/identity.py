"""Pseudonyms and content hashes as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.fixed_values import HASH_LENGTH
from usagelake.functions.maps import entry, text
from usagelake.functions.text import number_text

_BLOCK = 64  # SHA-256 block size, the HMAC key length


def _short_digest(hex_digest: Column) -> Column:
    """base64url of a hex digest, cut to the id length."""
    encoded = F.substring(F.base64(F.unhex(hex_digest)), 1, HASH_LENGTH)
    return F.replace(F.replace(encoded, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def content_hash(value: Column) -> Column:
    """SHA-256 id of a text (not secret)."""
    return _short_digest(F.sha2(F.encode(value, "UTF-8"), 256))


def pseudonymize(value: Column, pepper: str) -> Column:
    """HMAC-SHA256 of a text under a secret pepper; NULL stays NULL."""
    if not pepper:
        raise ValueError("the identity pepper must be a non-empty secret")
    key = pepper.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(value, "UTF-8")), 256))
    return _short_digest(F.sha2(F.concat(outer_pad, inner), 256))


def device_identity(attributes: Column) -> Column:
    return F.coalesce(entry(attributes, "user.id"), entry(attributes, "session.id"), F.lit("anonymous"))


def account_identity(attributes: Column) -> Column:
    """Raw account id; an empty one counts as absent."""
    raw = F.coalesce(entry(attributes, "user.account_uuid"), entry(attributes, "user.account_id"))
    return F.when(F.length(raw) > 0, raw)


def email_identity(attributes: Column) -> Column:
    """Raw e-mail, only when no account id is present."""
    email = entry(attributes, "user.email")
    return F.when(account_identity(attributes).isNull() & (F.length(email) > 0), email)


def metric_dedup_id() -> Column:
    """Id over source, name, session, time, value and the promoted dimensions."""
    promoted = [
        text(F.col(c))
        for c in ("model", "language", "edit_type", "subtype", "start_type", "query_source", "tool_name", "decision")
    ]
    return content_hash(
        F.concat(
            text(F.col("source")),
            text(F.col("name")),
            text(F.col("session_id")),
            F.col("ts_ns").cast("string"),
            number_text(F.col("value")),
            F.concat_ws("|", *promoted),
        )
    )


def _pairs(map_column: Column, value_text) -> Column:
    ordered = F.sort_array(F.map_entries(map_column))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit("="), value_text(e["value"]))), ",")


def event_dedup_id() -> Column:
    """Id over type, session, time, correlation and all numbers and dims in key order."""
    return content_hash(
        F.concat_ws(
            "|",
            text(F.col("source")),
            text(F.col("event_type")),
            text(F.col("session_id")),
            F.col("ts_ns").cast("string"),
            text(F.col("correlation_id")),
            _pairs(F.col("numbers"), number_text),
            _pairs(F.col("dims"), lambda v: v),
        )
    )


def partition_key(org: Column, session: Column) -> Column:
    return F.concat_ws(":", org, session)
