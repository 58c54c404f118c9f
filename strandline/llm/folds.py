"""Folds and bounded samples by hashes of the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(folds))


def sample_rows(rows: DataFrame, bound: int, fraction_of: int, seed: int) -> DataFrame:
    """About ``bound`` of ``fraction_of`` rows, by a hash of the id."""
    share = min(1.0, bound / max(1, fraction_of))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
