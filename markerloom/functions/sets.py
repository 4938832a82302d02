"""Array expressions on item sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_union(left: Column, right: Column) -> Column:
    """Sorted union of two item arrays."""
    return F.array_sort(F.array_union(left, right))


def drop_one_subsets(items: Column) -> Column:
    """All subsets of size n-1 of a sorted array of n items, as an array."""
    return F.transform(items, lambda dropped: F.filter(items, lambda item: item != dropped))


def proper_splits(items: Column) -> Column:
    """Every way to cut a set into two non-empty parts, as an array of structs.

    Item i goes to the antecedent when bit i of the mask is set, so masks
    1 .. 2^n - 2 give each ordered split once.
    """
    size = F.size(items)
    masks = F.when(size > 1, F.sequence(F.lit(1), F.greatest((F.pow(F.lit(2.0), size) - 2).cast("int"), F.lit(1))))

    def side(mask: Column, bit: int) -> Column:
        return F.filter(items, lambda item, index: (F.call_function("shiftright", mask, index).bitwiseAND(1)) == bit)

    return F.transform(
        masks,
        lambda mask: F.struct(side(mask, 1).alias("antecedent"), side(mask, 0).alias("consequent")),
    )
