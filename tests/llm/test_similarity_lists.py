"""Lists of the similarity join whose members are of several parts: which are compared, and in how many passes."""

import functools
import random
from itertools import combinations

import numpy as np
import pytest

from gneiss.llm import similarity as S


def sets_of(rows):
    words = {d: t.split() for d, t in rows}
    return {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in words.items()}


def plain(rows):
    sets, least = sets_of(rows), {d: d for d, _ in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {(d, len(sets[d]), least[d]) for d in sets}


def joined(spark, rows):
    return {tuple(r) for r in S.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


@pytest.fixture
def compared(monkeypatch):
    """The calls that compare sets."""
    calls, linked = [], S._linked
    monkeypatch.setattr(S, "_linked", lambda *a: calls.append(1) or linked(*a))
    return calls


def passages(name, number, length):
    return [" ".join(f"{name}{i}w{j}" for j in range(length)) for i in range(number)]


def test_lists_of_unlinked_sets_take_no_rounds(spark, compared):
    """All shingles but four are in other sets too, and a passage's lists hold 15 sets, but no two sets are linked."""
    rows = [(d, " ".join(two)) for d, two in enumerate(combinations(passages("p", 16, 60), 2))]
    assert joined(spark, rows) == {(d, 116, d) for d, _ in rows}
    assert len(compared) == 2


@pytest.mark.parametrize("sizes", [{}, {"long_list": 3, "piece": 7}, {"rounds": 1, "long_list": 3}])
def test_chains_in_long_lists_equal_all_pairs(spark, monkeypatch, compared, sizes):
    """Windows of long texts, of which only neighbours are linked, and sets that share half with many others."""
    r, rows = random.Random(3), []
    monkeypatch.setattr(S, "MOST_ROUNDS", sizes.get("rounds", S.MOST_ROUNDS))
    monkeypatch.setattr(S, "_pairs_across", functools.partial(S._pairs_across, **{k: v for k, v in sizes.items() if k != "rounds"}))
    for c, step in enumerate([3, 7, 9]):
        w = [f"c{c}w{j}" for j in range(400)]
        rows += [" ".join(w[i : i + 90]) for i in range(0, 310, step)]
    rows += [" ".join(two) for two in combinations(passages("q", 7, 50), 2)]
    ids = r.sample(range(1000), len(rows))
    rows = list(zip(ids, rows))
    assert joined(spark, rows) == plain(rows)
    assert len(compared) > 2 or not sizes


def test_pairs_of_lists(monkeypatch):
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 50)
    r = np.random.default_rng(3)
    lengths = np.array([1, 2, 70, 5, 100, 3])
    ends = np.cumsum(lengths)
    starts, n = ends - lengths, np.concatenate([np.sort(r.integers(20, 200, k)) for k in lengths])
    got = [(int(x), int(y)) for a, b in S._pairs_of(starts, ends, n) for x, y in zip(a, b)]
    fits = {(x, y) for s, e in zip(starts, ends) for x, y in combinations(range(s, e), 2) if n[x] * 100 >= n[y] * 80}
    assert len(got) == len(set(got)) and fits <= set(got)
    assert all(any(s <= x < y < e for s, e in zip(starts, ends)) for x, y in got)
    assert not list(S._pairs_of(starts[:0], ends[:0], n))
