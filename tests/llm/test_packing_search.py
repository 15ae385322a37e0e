"""The local search's indexes, its results on packings with a known optimum, and packing in several groups."""

import random
import time
from collections import defaultdict

import pytest

from lumenlake.llm import packing


def triplets(n, capacity=2048, seed=1):
    """Lengths of n full bins of three, none of which fits with three others."""
    rng, out = random.Random(seed), []
    least, most = capacity // 4 + 8, capacity // 2 - 24
    while len(out) < 3 * n:
        a, b = rng.randint(least, most), rng.randint(least, most)
        if least <= capacity - a - b <= most:
            out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def state(search):
    return search._by_room, search._rooms, [({k: set(v) for k, v in x._bins.items()}, x._rooms, x._most.tolist()) for x in (search._one, search._two)]


@pytest.mark.parametrize("seed", range(6))
def test_indexes_stay_those_of_the_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([3, 7, 7, 20, 33, 41]) + rng.randrange(5) for _ in range(150)]
    bins = packing.best_fit(lengths, 100)
    rng.shuffle(bins)
    search, steps = packing._Search(lengths, bins, 100), 0
    squares = lambda: sum((100 - r) ** 2 for r in search.room)
    for e in range(len(bins)):
        if not bins[e] or not search.room[e]:
            continue
        search.leave(e)
        while bins[e]:
            before = squares()
            if not search.step(e):
                break
            steps += 1
            assert squares() > before
        search.enter(e)
        fresh = state(packing._Search(lengths, [list(b) for b in bins], 100))
        mine = state(search)
        assert [set(x) for x in mine[0]] == [set(x) for x in fresh[0]] and mine[1:] == fresh[1:]
        assert search.room == [100 - sum(lengths[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(150)) and steps


def brute_step(lengths, bins, capacity, e):
    """Whether a move or an exchange of one for one, two for one or one for two fills another bin over e's fill."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    ways = lambda b: [(i,) for i in b] + [(i, j) for k, i in enumerate(b) for j in b[:k]]
    for b, other in enumerate(bins):
        if b == e or not other or fill[b] == capacity:
            continue
        for give in ways(bins[e]):
            x = sum(lengths[i] for i in give)
            takes = ([()] if len(give) == 1 else []) + [(j,) for j in other] + ([p for p in ways(other) if len(p) == 2] if len(give) == 1 else [])
            for take in takes:
                y = sum(lengths[j] for j in take)
                if y < x and fill[e] < fill[b] - y + x <= capacity:
                    return True
    return False


def test_a_step_is_found_if_and_only_if_there_is_one():
    rng, some = random.Random(8), 0
    for _ in range(400):
        lengths = [rng.randint(2, 30) for _ in range(rng.randint(4, 14))]
        bins = packing.best_fit(lengths, 40)
        search = packing._Search(lengths, bins, 40)
        e = max((b for b in range(len(bins))), key=lambda b: search.room[b])
        if not search.room[e]:
            continue
        search.leave(e)
        want = brute_step(lengths, bins, 40, e)
        some += want
        assert search.step(e) == want
    assert 50 < some < 400


def test_triplets_of_a_full_group():
    lengths = triplets(packing.GROUP_PIECES // 3)
    begin = time.time()
    first, after, bound = packing.packing_report(lengths, 2048)
    assert time.time() - begin < 120
    assert bound == packing.GROUP_PIECES // 3 and first > 1.1 * bound and after < 1.015 * bound


def test_many_short_pieces_and_equal_ones():
    assert len(packing.pack([1] * 50_000, 2048)) == 25
    assert len(packing.pack([1025] * 2000 + [1] * 3, 2048)) == 2000
    assert packing.pack([], 2048) == []


def test_groups_come_near_the_bound(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["the"] * rng.choice([20, 30, 41, 60, 75, 90, 130]))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, capacity=200, mean_pieces=100).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    bound = packing.lower_bound([r.length for r in got], 200)
    one = len(packing.pack([r.length for r in got], 200))
    assert len(got) == 1500 and max(fill.values()) <= 200
    assert bound <= one <= len(fill) <= 1.03 * one + 1
