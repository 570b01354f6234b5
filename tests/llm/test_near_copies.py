import itertools
import random

import numpy as np
import pytest

from distloom.llm import near_copies, simhash
from tests.llm import brute
from tests.llm.conftest import make_docs


def shingles(text):
    w = brute.ascii_words(brute.lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def kept(rows, similarity=0.8):
    """The least (doc_id, nulls last) row of each group, for rows whose ids decide."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    root, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            x, y = sorted((root[i], root[j]))
            root = [x if r == y else r for r in root]
    return sorted((rows[i] for i in set(root)), key=str)


@pytest.fixture(scope="module")
def edited():
    """Chains of edits: similarities on both sides of 0.8, far beyond three bits."""
    rng = random.Random(5)
    rows = []
    for _ in range(20):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 100, 200]))]
        for _ in range(5):
            rows.append((len(rows), " ".join(words)))
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(1, 8)] = [f"x{rng.randrange(400)}" for _ in range(rng.randrange(1, 8))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [1, 4])
def test_stage_keeps_one_of_all_near_copies(spark, corpus, edited, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rows = corpus + [(1000 + d, t) for d, t in edited]
    docs = make_docs(spark, rows)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == kept(rows)
    assert simhash.keep_one(make_docs(spark, [])).count() == 0


def test_parities_never_differ_in_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(1)
    for n in (1, 20, 300):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[: n * 3 // 4], rng.integers(-(1 << 62), 1 << 62, n // 3)]))
        apart = int(np.bitwise_count((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b)) and near_copies.parity(a).shape == (near_copies.PARITY,)


def test_postings_meet_only_groups_of_their_length(spark):
    """A long text beside a group of short ones, one short stranger of it, and a list of one group alone."""
    rows = [(1, i, 5, 10) for i in range(4)] + [(1, 9, 9, 99)] + [(2, i, 5, 10) for i in range(4)] + [(2, 7, 6, 70)] + [(3, i, i, 10) for i in range(4)]
    left = spark.createDataFrame(rows, "s long, id long, length int, known long")
    assert sorted((r.s, r.id) for r in near_copies._contested(left).collect()) == [(2, 0), (2, 1), (2, 2), (2, 3), (2, 7)]
