"""Text expressions of the loaders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider_of(origin: Column) -> Column:
    """``'PROVIDER - CODE'`` to ``'PROVIDER'``."""
    return F.trim(F.split_part(origin, F.lit(" - "), F.lit(1)))


def starts_like(cell: Column, word: str) -> Column:
    """Whether the trimmed, lower-cased cell starts with ``word``."""
    return F.lower(F.trim(cell)).startswith(word)
