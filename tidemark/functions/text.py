"""Masking, encoding and encryption of text and payload columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.events import by_class, c

# JSON fields whose string values never reach a log line.
SENSITIVE_FIELDS = ["password", "token", "secret", "apiKey"]
MASK = "****"
SNIPPET_BYTES = 2048
IV_BYTES = 12


def mask_sensitive(text: Column | str) -> Column:
    """Hide the string value of each sensitive JSON field, whatever its letter case."""
    masked = c(text)
    for field in SENSITIVE_FIELDS:
        masked = F.regexp_replace(masked, f'(?i)"{field}"\\s*:\\s*"[^"]*"', f'"{field}":"{MASK}"')
    return masked


def log_snippet(body: Column | str, max_bytes: int = SNIPPET_BYTES) -> Column:
    """What an access log keeps of a request body: its first bytes, masked."""
    head = F.substring(F.encode(c(body), "UTF-8"), 1, max_bytes)
    return mask_sensitive(F.make_valid_utf8(head.cast("string")))


def encode_payload(payload: Column | str) -> Column:
    return F.base64(c(payload))


def decode_payload(encoded: Column | str) -> Column:
    """Payload bytes; null for a blank or an undecodable text."""
    text = c(encoded)
    return F.when(F.trim(text) != "", F.try_to_binary(text, F.lit("base64")))


def payload_rejected(encoded: Column | str) -> Column:
    """True for a non-blank text that is not valid base64."""
    text = c(encoded)
    return (F.coalesce(F.trim(text) != "", F.lit(False))
            & F.try_to_binary(text, F.lit("base64")).isNull())


def payload_digest(payload: Column | str) -> Column:
    """SHA-256, where an absent or empty payload has the empty digest."""
    p = c(payload)
    return F.when(F.coalesce(F.octet_length(p), F.lit(0)) == 0, F.lit("")).otherwise(F.sha2(p, 256))


def needs_cmk(cls: Column | str) -> Column:
    return c(cls).isin(S.ENRICHED_CLASSES)


def needs_audit(cls: Column | str) -> Column:
    return c(cls) == "RESTRICTED"


def rotation_days(cls: Column | str) -> Column:
    return by_class(S.ROTATION_DAYS, cls)


def owner_context(tenant: Column | str, cls: Column | str) -> Column:
    """Additional authenticated data that ties a ciphertext to tenant and classification."""
    return F.encode(F.concat_ws(":", c(tenant), c(cls)), "UTF-8")


def encrypt(payload, key, tenant, cls) -> Column:
    """AES-256-GCM with a random 12-byte IV, which Spark prepends to the ciphertext."""
    return F.aes_encrypt(c(payload), c(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""),
                         owner_context(tenant, cls))


def decrypt(ciphertext, key, tenant, cls) -> Column:
    """Plaintext bytes, or null for a wrong owner, a wrong key or tampered bytes."""
    return F.try_aes_decrypt(c(ciphertext), c(key), F.lit("GCM"), F.lit("DEFAULT"),
                             owner_context(tenant, cls))
