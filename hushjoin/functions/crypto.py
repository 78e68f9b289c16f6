"""Hashes, keyed hashes, AES-GCM and token envelopes as native Column expressions. Keys are literals made on the driver.

aes_encrypt draws its vector when it is evaluated, and the optimizer may evaluate it again above a filter: write or
checkpoint encrypted columns before filtering on them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushjoin.functions.text import base64_line, base64_url, from_base64_url, let

#: The token of a rule whose signature is blank.
BLANK = "0" * 64
PREFIX = "olt."  # fixed format: prefix and version of an envelope
VERSION = "V1"
ISSUER = "org.hushjoin"  # pass the issuer of an existing deployment where tokens must carry it
IV, TAG = 12, 16


def secret_bytes(secret: str | bytes | None, what: str = "Hashing secret") -> bytes:
    if secret is None or not secret.strip():
        raise ValueError(f"{what} cannot be empty")
    return secret.encode() if isinstance(secret, str) else bytes(secret)


def key_bytes(key: str | bytes | None) -> bytes:
    raw = secret_bytes(key, "Encryption key")
    if len(raw) != 32:
        raise ValueError(f"Encryption key must be exactly 32 bytes for AES-256. Got {len(raw)} bytes")
    return raw


def _lit(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def hmac_base64(c: Column, secret: bytes) -> Column:
    """Base64 of HMAC-SHA256 of the text."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = _lit(bytes(b ^ 0x36 for b in key)), _lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, c.cast("binary")), 256))
    return base64_line(F.unhex(F.sha2(F.concat(outer, first), 256)))


def aes_encrypt(c: Column, key: bytes) -> Column:
    """Base64 of vector, ciphertext and tag."""
    return base64_line(F.aes_encrypt(c.cast("binary"), _lit(key), F.lit("GCM")))


def aes_decrypt(c: Column, key: bytes) -> Column:
    """The text; null where it is no ciphertext of this key."""
    raw = F.try_to_binary(c, F.lit("base64"))
    return let(raw, lambda x: F.when(F.octet_length(x) > IV + TAG, F.decode(F.try_aes_decrypt(x, _lit(key), F.lit("GCM")), "UTF-8")))


def _header(ring: str) -> str:
    text = json.dumps({"alg": "dir", "enc": "A256GCM", "typ": "match-token", "kid": ring}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def envelope(token: Column, rule: Column, ring: str, key: bytes, issuer: str = ISSUER, issued_at: int | None = None) -> Column:
    """olt.V1. and a compact JWE (direct key, A256GCM) whose payload holds the token."""
    header = _header(ring)
    payload = F.to_json(
        F.struct(
            rule.alias("rlid"),
            F.lit("SHA-256").alias("hash_alg"),
            F.lit("HS256").alias("mac_alg"),
            F.array(token).alias("ppid"),
            F.lit(ring).alias("rid"),
            F.lit(issuer).alias("iss"),
            F.lit(int(time.time()) if issued_at is None else issued_at).cast("long").alias("iat"),
        )
    )
    sealed = F.aes_encrypt(payload.cast("binary"), _lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(header).cast("binary"))

    def parts(x: Column) -> Column:
        size = F.octet_length(x)
        cut = [F.substring(x, F.lit(1), F.lit(IV)), F.substring(x, F.lit(IV + 1), size - IV - TAG), F.substring(x, size - TAG + 1, F.lit(TAG))]
        return F.concat_ws(".", F.lit(PREFIX + VERSION + "." + header), F.lit(""), *map(base64_url, cut))

    # one ciphertext, bound to a name inside the lambda, gives all three parts
    return let(sealed, parts)


def is_envelope(c: Column) -> Column:
    return c.startswith(PREFIX + VERSION + ".")


def open_envelope(c: Column, key: bytes) -> Column:
    """The JSON payload; null where it cannot be opened."""

    def opened(part: Column) -> Column:
        sealed = F.concat(from_base64_url(part[4]), from_base64_url(part[5]), from_base64_url(part[6]))
        plain = F.try_aes_decrypt(sealed, _lit(key), F.lit("GCM"), F.lit("DEFAULT"), part[2].cast("binary"))
        return F.when(F.size(part) == 7, F.decode(plain, "UTF-8"))

    return F.when(is_envelope(c), let(F.split(c, "\\."), opened))


def payload_token(payload: Column) -> Column:
    """The first token of a payload; empty if it has none."""
    return F.coalesce(F.get_json_object(payload, "$.ppid[0]"), F.get_json_object(payload, "$.ppid"), F.lit(""))


def decrypt(c: Column, key: bytes) -> Column:
    """The token that can be compared: opens envelopes and ciphertexts, and leaves anything else as it is. Null stays null."""
    inner = lambda token: F.when(token == "", token).otherwise(F.coalesce(aes_decrypt(token, key), token))
    opened = let(open_envelope(c, key), lambda payload: F.when(payload.isNull(), c).otherwise(let(payload_token(payload), inner)))
    return F.when(is_envelope(c), opened).otherwise(F.coalesce(aes_decrypt(c, key), c))


def decrypt_strict(c: Column, key: bytes) -> Column:
    """The token of an envelope or ciphertext; a value that cannot be opened raises. Null stays null."""
    failed = F.raise_error(F.lit("Decryption failed for a token")).cast("string")
    opened = let(open_envelope(c, key), lambda payload: F.when(payload.isNull(), failed).otherwise(let(payload_token(payload), lambda t: F.when(t == "", t).otherwise(F.coalesce(aes_decrypt(t, key), t)))))
    return F.when(c.isNull(), c).when(is_envelope(c), opened).otherwise(F.coalesce(aes_decrypt(c, key), failed))


def decrypt_ok(c: Column, key: bytes) -> Column:
    """Whether decrypt() found something to open, for the counts of a decryption run."""
    return F.when(is_envelope(c), open_envelope(c, key).isNotNull()).otherwise(aes_decrypt(c, key).isNotNull())


def real(c: Column) -> Column:
    """Neither null, empty nor the blank token: what encrypting and decrypting runs work on."""
    return c.isNotNull() & (c != "") & (c != BLANK)
