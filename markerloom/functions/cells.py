"""Cell-level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that count as present; every other text is absent.
PRESENT_TOKENS = ("1", "TRUE", "T", "True", "true")


def is_present(cell: Column) -> Column:
    """True for a present token, False for anything else including NULL."""
    return F.coalesce(cell.isin(*PRESENT_TOKENS), F.lit(False))


def to01(cell: Column) -> Column:
    """Raw text cell to 0/1."""
    return F.when(cell.isin(*PRESENT_TOKENS), F.lit(1)).otherwise(F.lit(0))


def round_even(value: Column, digits: int = 4) -> Column:
    """Round half to even; infinities pass through."""
    endless = F.abs(value) == F.lit(float("inf"))
    return F.when(endless, value).otherwise(F.bround(F.when(~endless, value), digits))
