"""Text and key expressions."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_uid(uid: Column) -> Column:
    return F.lower(F.trim(uid))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed hash in hex. The key travels with the function's code and so stands in no plan, explanation or event log, as
    it would as a literal of built-in functions. The price is a pass through Python workers, by Arrow batches: hash users
    and not their messages."""

    def one(text: str | None) -> str | None:
        return None if text is None else hmac.digest(key, text.encode(), "sha256").hex()

    @F.arrow_udf("string")
    def keyed_hash(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return keyed_hash(message.cast("string"))


def fingerprint(key: bytes) -> str:
    """What is stored to tell, later, whether the same key is used."""
    return hashlib.sha256(key).hexdigest()
