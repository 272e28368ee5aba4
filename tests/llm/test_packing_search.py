"""The packing search finds solutions however deep its leaves are."""

from collections import Counter

from sitegrain.llm import packing


def _pieces(plan):
    return sum((Counter({s: m * c for s, c in f.items()}) for m, f in plan), Counter())


def test_deep_search_completes_partial_paths():
    counts = {s: 1 for s in range(301, 1501)}
    alone = [(1, {s: 1}) for s in counts]
    found = packing.branch_and_bound(counts, 2048, alone)
    assert _pieces(found) == Counter(counts)
    assert all(sum(s * c for s, c in f.items()) <= 2048 for _, f in found)
    assert sum(m for m, _ in found) <= 1.1 * packing.lower_bound(counts, 2048)


def test_levels_without_a_choice_are_free():
    counts = {s: 1 for s in range(1100, 1150)}
    found = packing.branch_and_bound(counts, 2048, [(1, {s: 1}) for s in range(60)], nodes=5)
    assert _pieces(found) == Counter(counts) and sum(m for m, _ in found) == 50
