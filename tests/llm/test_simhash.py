import itertools
import random

import numpy as np

from distloom.llm import simhash
from tests.llm import brute
from tests.llm.conftest import make_docs


def unsigned(x):
    return x % (1 << 64)


def test_fingerprints(corpus):
    for _, text in corpus:
        assert simhash.fingerprint(text) == brute.simhash(text)


def test_groups(spark, corpus):
    got = {(r.doc_id, unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(make_docs(spark, corpus)).collect()}
    roots = brute.components(list({(d, brute.simhash(t)) for d, t in corpus}))
    assert got == {(d, brute.simhash(t), roots[d]) for d, t in corpus}
    assert len({r for _, _, r in got}) < len(roots)


def test_null_ids(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (None, "only here in the world")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make_docs(spark, rows)).collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, None)]


def test_links_of_chosen_fingerprints(spark):
    """Chains and balls of fingerprints: components equal those of all pairs."""
    rng = random.Random(8)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.append(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    roots = brute.components(list(enumerate(prints)))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    linked = {unsigned(r.node): unsigned(r.root) for r in simhash.components(simhash.near_edges(df)).collect()}
    place = {p: i for i, p in enumerate(prints)}
    groups = {}
    for p in prints:
        groups.setdefault(linked.get(p, p), set()).add(place[p])
    expected = {}
    for i, r in roots.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_quad_stands_outside_of_any_three_bytes():
    assert len(simhash.QUADS) == 14
    for three in itertools.combinations(range(8), 3):
        assert any(not set(three) & set(q) for q in simhash.QUADS)


def test_tally_and_bits_decide_in_a_list():
    rng = random.Random(2)
    quad = simhash.QUADS[3]
    free = [b for b in range(64) if b // 8 not in quad]
    members = np.unique(np.array([sum(1 << b for b in rng.sample(free, rng.randrange(1, 6))) for _ in range(500)], dtype=np.uint64))
    index = simhash.ByteIndex(members, quad)
    for x in members[::7]:
        bits = np.bitwise_count(members ^ x)
        assert sorted(index.near(x)) == sorted(np.flatnonzero(bits <= 3))
        shared = sum((members >> np.uint64(8 * p)).astype(np.uint8) == (x >> np.uint64(8 * p)).astype(np.uint8) for p in range(8))
        assert (shared[bits <= 3] >= simhash.SHARED).all() and (shared[bits > 3] >= simhash.SHARED).any() and (shared < simhash.SHARED).any()
    got = sorted(sorted({int(r), *map(int, o)}) for r, o in _grouped(*simhash.list_edges(members, quad)).items())
    groups = {}
    for i, r in brute.components(list(enumerate(map(int, members)))).items():
        groups.setdefault(r, []).append(int(members[i]))
    assert got == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def _grouped(roots, others):
    out = {}
    for r, o in zip(np.concatenate(roots), np.concatenate(others), strict=True):
        out.setdefault(r, []).append(o)
    return out
