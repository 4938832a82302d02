from markerloom.functions.cells import is_present, round_even, to01
from markerloom.functions.sets import drop_one_subsets, proper_splits, set_union
from markerloom.functions.tails import binomial_spread_p, binomial_two_sided_p

__all__ = [
    "binomial_spread_p",
    "binomial_two_sided_p",
    "drop_one_subsets",
    "is_present",
    "proper_splits",
    "round_even",
    "set_union",
    "to01",
]
