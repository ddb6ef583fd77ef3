"""Encrypted entries: keys from a passphrase, AES-256-GCM, listing without secrets.

The passphrase is an argument or the environment's MEMORY_PASSPHRASE; it never
stands in a plan as a literal of a query: keys are derived in an Arrow function.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the key derivation, and the salt's and nonce's lengths in bytes.
ITERATIONS, SALT, NONCE = 600_000, 32, 12


def passphrase(explicit: str | None = None) -> str | None:
    return explicit or os.environ.get("MEMORY_PASSPHRASE")


def _derive(salt_hex: Column, secret: str, iterations: int) -> Column:
    @F.pandas_udf("binary")
    def derive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            seen: dict[str, bytes] = {}
            for x in s.dropna().unique():
                seen[x] = hashlib.pbkdf2_hmac("sha256", secret.encode(), bytes.fromhex(x), iterations, 32)
            yield s.map(seen)

    return derive(salt_hex)


def encrypted(df: DataFrame, text: str, secret: str, salt: Column | None = None, nonce: Column | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """``df`` without ``text`` but with ciphertext_hex (tag included), nonce_hex and salt_hex; null texts stay null.

    Salt and nonce are random unless given (as hex columns, for tests).
    """
    random = lambda n: F.substring(F.hex(F.concat(*[F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))) for _ in range(-(-n // 16))])), 1, 2 * n)
    d = df.withColumn("salt_hex", F.lower(salt if salt is not None else random(SALT))).withColumn("nonce_hex", F.lower(nonce if nonce is not None else random(NONCE)))
    d = d.withColumn("_key", _derive(F.col("salt_hex"), secret, iterations))
    box = F.expr(f"aes_encrypt(cast(`{text}` as binary), _key, 'GCM', 'DEFAULT', unhex(nonce_hex))")
    return d.withColumn("ciphertext_hex", F.lower(F.substring(F.hex(box), 2 * NONCE + 1, 1 << 30))).drop("_key", text)


def decrypted(df: DataFrame, secret: str, to: str = "plaintext", iterations: int = ITERATIONS) -> DataFrame:
    """``df`` with the decrypted text; a wrong passphrase gives null."""
    d = df.withColumn("_key", _derive(F.col("salt_hex"), secret, iterations))
    return d.withColumn(to, F.expr("cast(try_aes_decrypt(unhex(concat(nonce_hex, ciphertext_hex)), _key, 'GCM', 'DEFAULT') as string)")).drop("_key")


def keys(df: DataFrame) -> DataFrame:
    """Entries without their secret columns."""
    return df.drop("ciphertext_hex", "nonce_hex", "salt_hex")


def deleted(df: DataFrame, secret: str, gone: Column, iterations: int = ITERATIONS) -> DataFrame:
    """Entries without those that ``gone`` names; reading fails if one of them can't be decrypted with ``secret``, so nothing is deleted with a wrong one.

    Rows for which ``gone`` is null stay.
    """
    named = F.coalesce(gone, F.lit(False))
    out = decrypted(df.withColumn("_gone", named), secret, "_plain", iterations)
    bad = F.col("_gone") & F.col("_plain").isNull() & F.col("ciphertext_hex").isNotNull()
    return out.where(F.when(bad, F.raise_error(F.lit("wrong passphrase: nothing is deleted")).cast("boolean")).otherwise(~F.col("_gone"))).select(*df.columns)
