"""Hashes, stable ids and null-safe identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("string").cast("binary"), 256)


def stable_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    """prefix-hash of the parts joined by '|'; a null part is the word None."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256_text(joined), 1, length))


def identity(*parts: Column) -> Column:
    """Parts joined by '|', a null as nothing."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
