"""Links that near-duplicate classes return, and exact weighted links within a block."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lumenlake.llm import probminhash
from lumenlake.llm.queries import QUERIES


def test_links_of_the_query_hold_its_classes_together(spark, data):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op9_probminhash"](spark, data).collect()
    links = probminhash.near_duplicate_links(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert len(got) == len(docs) == len({r.doc_id for r in got})
    ends = defaultdict(dict)
    for r in links:
        for x, y in ((r.a, r.b), (r.b, r.a)):
            ends[docs[x]][docs[y]] = r.similarity
    texts, degree = defaultdict(set), defaultdict(int)
    for r in got:
        texts[r.class_id].add(docs[r.doc_id])
    for r in got:
        own = ends.get(docs[r.doc_id], {})
        assert r.class_texts == len(texts[r.class_id]) and set(own) <= texts[r.class_id]
        assert r.n_links == len(own) and (r.n_links > 0) == (r.class_texts > 1)
        assert r.most_alike == (pytest.approx(max(own.values())) if own else None)
        degree[r.class_id, docs[r.doc_id]] = r.n_links
    for c, members in texts.items():
        assert sum(degree[c, t] for t in members) >= 2 * (len(members) - 1)
    assert any(len(x) > 1 for x in texts.values())


def test_links_of_no_and_of_odd_texts(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "a b"), (None, "a b"), (3, "x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = probminhash.near_duplicate_classes(docs, with_links=True).collect()
    assert len(got) == 6 and {(r.class_texts, r.n_links, r.most_alike) for r in got} == {(1, 0, None)}
    assert probminhash.near_duplicate_classes(docs.limit(0), with_links=True).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_weighted_links_of_a_block_are_exact(seed):
    rng = random.Random(seed)
    lines = [" ".join(f"l{rng.randrange(10**6)}" for _ in range(6)) for _ in range(4)]
    texts = []
    for _ in range(60):
        tail = [f"t{rng.randrange(30)}" for _ in range(rng.randint(0, 12))]
        texts.append(" ".join([rng.choice(lines)] * rng.randint(1, 25) + tail))
    texts = sorted(set(texts)) + ["", "a b"]
    label, links = probminhash.linked_classes(texts)
    sets, up = [probminhash.weighted_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    weighted = 0
    for i in range(len(texts)):
        for j in range(i):
            p, plain = probminhash.similarity(sets[i], sets[j])
            weighted += p >= 0.8 > plain
            if max(p, plain) >= probminhash.THRESHOLD - 1e-12:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert weighted > 20 and label.tolist() == [root(i) for i in range(len(texts))]
    assert all(s == pytest.approx(max(probminhash.similarity(sets[i], sets[j]))) for i, j, s in links)


def test_shares_overlap_no_less_than_probability_jaccard():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        h = np.arange(8, dtype=np.uint64)
        x, y = (rng.integers(0, 2, 8) * rng.integers(1, 40, 8) for _ in range(2))
        a, b = (h[x > 0], x[x > 0]), (h[y > 0], y[y > 0])
        overlap = np.minimum(x / max(x.sum(), 1), y / max(y.sum(), 1)).sum()
        assert probminhash.similarity(a, b)[0] <= overlap + 1e-12
