"""Deterministic encryption of single values: equal plaintexts give equal ciphertexts, so keys still join. An opt-in for sinks."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

PREFIX = "enc:v1:"


def _xor(key: bytes, pad: int) -> bytes:
    return bytes(b ^ pad for b in key.ljust(64, b"\0"))


def _nonce(value: Column, key: bytes) -> Column:
    """The first 12 bytes of an HMAC-SHA256 over the plaintext."""
    own = hmac.digest(key, b"nonce-derivation", hashlib.sha256)
    inner = F.unhex(F.sha2(F.concat(F.lit(_xor(own, 0x36)), F.encode(value, "UTF-8")), 256))
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(_xor(own, 0x5C)), inner), 256)), 1, 12)


def encrypted(c: Column | str, key: bytes) -> Column:
    """Values that are encrypted already stay; null and empty too."""
    x = col(c)
    sealed = F.aes_encrypt(F.encode(x, "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _nonce(x, key))
    return F.when(x.isNull() | (x == "") | x.startswith(PREFIX), x).otherwise(F.concat(F.lit(PREFIX), F.translate(F.base64(sealed), "+/\r\n", "-_")))


ENCRYPTED = {"encrypted": True}


def marked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows whose schema says that the columns are kept encrypted."""
    return rows.withMetadata(columns[0], rows.schema[columns[0]].metadata | ENCRYPTED) if len(columns) == 1 else marked(marked(rows, columns[:1]), columns[1:]) if columns else rows


def catalogue(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """The encrypted columns of each table, out of the schemas: a column that is marked cannot be missing from a list."""
    found = {name: [f.name for f in df.schema.fields if f.metadata.get("encrypted")] for name, df in tables.items()}
    return {name: columns for name, columns in found.items() if columns}


def states(tables: dict[str, DataFrame], configured: bool, usable: bool = True, key_present: bool = True) -> DataFrame:
    """A row for each table with encrypted columns: encrypted_values, plaintext_values, pending (values that are not as configured), active, unreadable. One pass for each table, over its marked columns only."""
    out = None
    for name, columns in catalogue(tables).items():
        sealed = sum((F.count_if(F.col(c).startswith(PREFIX)) for c in columns[1:]), F.count_if(F.col(columns[0]).startswith(PREFIX)))
        plain = sum((F.count_if((F.col(c) != "") & ~F.col(c).startswith(PREFIX)) for c in columns[1:]), F.count_if((F.col(columns[0]) != "") & ~F.col(columns[0]).startswith(PREFIX)))
        one = tables[name].agg(sealed.alias("encrypted_values"), plain.alias("plaintext_values")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table has encrypted columns")
    pending = F.col("encrypted_values") if not configured else F.col("plaintext_values") if usable else F.lit(0).cast("long")
    return out.select("name", "encrypted_values", "plaintext_values", pending.alias("pending"), F.lit(configured and usable).alias("active"), ((F.col("encrypted_values") > 0) & F.lit(not key_present)).alias("unreadable"))


def conversion(rows: DataFrame, key: bytes, back: bool = False, emails: Sequence[str] = ()) -> tuple[DataFrame, Column, Column]:
    """(rows with their marked columns as configured, how many values a row changes, how many of it could not be decrypted): the counts are for an aggregate or an observation of the pass that writes. Values that are as they should be stay."""
    columns = catalogue({"rows": rows}).get("rows", [])
    sealed = {c: F.col(c).startswith(PREFIX) for c in columns}
    if back:
        told = {c: F.coalesce(sealed[c], F.lit(False)) for c in columns}
        lost = {c: told[c] & decrypted(c, key).isNull() for c in columns}
        out = converted_back(rows, columns, key)
    else:
        told = {c: F.coalesce((F.col(c) != "") & ~sealed[c], F.lit(False)) for c in columns}
        lost = {c: F.lit(False) for c in columns}
        out = converted(rows, columns, key, emails)
    total = lambda flags: sum((f.cast("long") for f in flags), F.lit(0).cast("long"))
    return marked(out, columns), total(told[c] & ~lost[c] for c in columns), total(lost.values())


def converted(rows: DataFrame, columns: Sequence[str], key: bytes, emails: Sequence[str] = ()) -> DataFrame:
    """rows with the columns encrypted; addresses are trimmed and folded first, so that they can be found by equality."""
    return rows.withColumns({c: encrypted(F.lower(F.trim(F.col(c))) if c in emails else F.col(c), key) for c in columns})


def converted_back(rows: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """rows with the columns decrypted; what cannot be decrypted stays as it is."""
    return rows.withColumns({c: F.coalesce(decrypted(c, key), F.col(c)) for c in columns})


def decrypted(c: Column | str, key: bytes) -> Column:
    """Plaintext passes; what cannot be decrypted is null."""
    x = col(c)
    body = F.unbase64(F.translate(F.substr(x, F.lit(len(PREFIX) + 1)), "-_", "+/"))
    return F.when(x.startswith(PREFIX), F.decode(F.try_aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")), "UTF-8")).otherwise(x)
