from itertools import combinations
from math import ceil
import random

import pytest
from pyspark.sql import functions as F

from markerloom.operators import patterns, rules


@pytest.fixture
def basket5(baskets):
    return baskets(
        {("1", "x"): "abc", ("2", "x"): "ab", ("3", "x"): "abc", ("4", "x"): "c", ("5", "x"): ""}
    )


def as_dict(itemsets):
    return {tuple(r.itemset): r.freq for r in itemsets.collect()}


def brute(sets, min_support, max_len):
    need = ceil(min_support * len(sets))
    items = sorted({i for s in sets for i in s})
    out = {}
    for k in range(1, max_len + 1):
        for c in combinations(items, k):
            n = sum(set(c) <= s for s in sets)
            if n >= max(need, 1):
                out[c] = n
    return out


@pytest.mark.parametrize("support,max_len", [(0.15, 4), (0.3, 5), (0.5, 2), (0.3, 1)])
def test_itemsets_match_brute_force(baskets, support, max_len):
    rng = random.Random(5)
    sets = [{f"i{j}" for j in range(9) if rng.random() < 0.15 + 0.08 * j} for _ in range(80)] + [set()] * 3
    table = baskets({(str(n), "x"): sorted(s) for n, s in enumerate(sets)})
    assert as_dict(patterns.frequent_itemsets(table, support, max_len)) == brute(sets, support, max_len)


def test_repeated_baskets_count_each_time(baskets):
    rng = random.Random(6)
    sets = [{f"i{j}" for j in range(7) if rng.random() < 0.5} for _ in range(30)] * 2
    table = baskets({(str(n), "x"): sorted(s) for n, s in enumerate(sets)})
    assert as_dict(patterns.frequent_itemsets(table, 0.2, 3)) == brute(sets, 0.2, 3)


def test_subsets_of_frequent_sets_are_frequent(basket5):
    found = as_dict(patterns.frequent_itemsets(basket5, 0.4, 3))
    assert found == {("a",): 3, ("b",): 3, ("c",): 3, ("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 2, ("a", "b", "c"): 2}


def test_rule_metrics_by_hand(basket5):
    found = rules.association_rules(patterns.frequent_itemsets(basket5, 0.4, 3), 0.0)
    table = {(tuple(r.antecedents), tuple(r.consequents)): r for r in found.collect()}
    assert len(table) == 3 * 2 + 6
    ab = table[("a",), ("b",)]
    assert (ab.support, ab.confidence, ab.conviction) == (0.6, 1.0, float("inf"))
    assert ab.lift == pytest.approx(1 / 0.6) and ab.leverage == pytest.approx(0.24)
    assert ab.zhangs_metric == pytest.approx(0.24 / 0.24)
    ca = table[("c",), ("a",)]
    assert ca.confidence == pytest.approx(2 / 3) and ca.lift == pytest.approx(0.4 / 0.36)
    assert ca.conviction == pytest.approx(0.4 / (1 / 3)) and ca.leverage == pytest.approx(0.04)
    assert ca.zhangs_metric == pytest.approx(0.04 / max(0.4 * 0.4, 0.6 * 0.2))
    for (a, c), row in table.items():
        assert row.lift == pytest.approx(table[c, a].lift)


def test_constant_item_has_zero_zhang(baskets):
    table = baskets({("1", "x"): "ab", ("2", "x"): "ab"})
    found = rules.association_rules(patterns.frequent_itemsets(table, 0.5, 2), 0.8).collect()
    assert {r.zhangs_metric for r in found} == {0.0} and {r.conviction for r in found} == {float("inf")}


def test_infinite_conviction_passes_and_leverage_is_optional(basket5):
    found = rules.association_rules(patterns.frequent_itemsets(basket5, 0.4, 3), 0.8)
    assert rules.filter_rules(found, 1.0, 5.0, 0.0).count() > 0
    assert rules.filter_rules(found, 1.0, 1.0, 0.0, 0.23).count() < rules.filter_rules(found, 1.0, 1.0, 0.0).count()


def test_collapse_is_sorted_and_unique(basket5):
    found = rules.association_rules(patterns.frequent_itemsets(basket5, 0.4, 3), 0.0)
    markers = rules.collapse_rules(found).collect()
    keys = [(tuple(r.orthogroups), r.support, r.lift) for r in markers]
    assert len(keys) == len(set(keys)) and all(list(k[0]) == sorted(k[0]) for k in keys)
    assert all(r.num_orthogroups == len(r.orthogroups) for r in markers)


def markers(spark, sets):
    rows = [(sorted(s), len(s), 0.5, 0.9, 1.0 + i / 10, 0.1, 2.0, 0.5) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, rules.MARKER_SCHEMA)


def test_subtraction(spark):
    left = rules.subtract_rules(markers(spark, ["ab", "bc", "cd", "ab"]), markers(spark, ["cx"]))
    assert sorted("".join(r.orthogroups) for r in left.collect()) == ["ab", "ab"]
    assert rules.subtract_rules(markers(spark, ["ab"]), rules.empty_markers(spark)).count() == 1


def test_groups_count_rule_rows(spark):
    table = markers(spark, ["abc", "abc", "abd", "ab"])
    got = [(r.group, r.co_occurance) for r in rules.suggest_groups(table, 2).collect()]
    assert got[0] == ("a, b", 3) and dict(got)["a, d"] == 1 and "c, d" not in dict(got)


def test_empty_input_gives_typed_tables(baskets, spark):
    none = baskets({("1", "x"): ""})
    found = patterns.frequent_itemsets(none, 0.5, 3)
    assert found.isEmpty()
    assert rules.collapse_rules(rules.association_rules(found)).schema.simpleString() == rules.empty_markers(spark).schema.simpleString()
    assert patterns.frequent_itemsets(none.filter("false"), 0.5, 3).isEmpty()
