import hashlib
import itertools

import pytest

from distloom.llm import spotsigs
from tests.llm.conftest import make_docs
from tests.llm.test_licenses import words


def signatures(text, common, chain=2):
    w = words(text or "")
    content = [i for i, x in enumerate(w) if x not in common]
    found = {(w[i - 1], *(w[j] for j in content[k : k + chain])) for k, i in enumerate(content[: len(content) - chain + 1]) if i > 0 and w[i - 1] in common}
    return found or {("whole", *w)}


def like(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [200, 4_000_000])
def test_likeness(spark, corpus, size):
    rows = [r for r in corpus if r[0] != 5] + [(5, "of the of a the b of c"), (-7, "the first of all")]
    common = ["a", "the", "of", "b", "ab", "é"]
    got = {r.doc_id: r for r in spotsigs.likeness(make_docs(spark, rows), common, size).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n, r = t or "", n or "", got[d]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(signatures(t, common), signatures(edited, common)))
        assert r.near_next == pytest.approx(like(signatures(t, common), signatures(n, common)))
    for (a, ta), (b, tb) in itertools.combinations(rows, 2):
        assert (got[a].fingerprint == got[b].fingerprint) == (signatures(ta, common) == signatures(tb, common))


def test_next_of_repeated_null_and_single_ids(spark):
    got = spotsigs.with_next(make_docs(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "z")]), ["text"], 1).collect()
    assert sorted((r.text, r.next_text) for r in got) == [("a", "b"), ("b", "c"), ("c", "z"), ("z", "a")]
    assert [r.next_text for r in spotsigs.with_next(make_docs(spark, [(9, "only")]), ["text"]).collect()] == ["only"]
    assert spotsigs.likeness(make_docs(spark, [])).count() == 0
    texts = [(i, f"text {i}") for i in range(500)]
    got = spotsigs.with_next(make_docs(spark, texts).repartition(5), ["text"], 40).collect()
    assert {r.doc_id: r.next_text for r in got} == {i: f"text {(i + 1) % 500}" for i in range(500)}


def test_common_words(spark):
    docs = make_docs(spark, [(1, "b a b b"), (2, "A c"), (3, None), (4, "der der hund"), (5, "die der")])
    assert spotsigs.common_words(docs, 2) == ["a", "der"]
    by_language = docs.withColumn("lang", spotsigs.F.expr("if(doc_id > 3, 'de', null)"))
    assert spotsigs.common_words(by_language, 2) == ["a", "b", "der", "die"]
    assert spotsigs.common_words(docs.drop("lang"), 2) == ["a", "der"]


def test_pairs(spark, corpus):
    common = ["a", "the", "of", "b", "ab"]
    rows = list({(d, t) for d, t in corpus})
    classed = spotsigs.classes(make_docs(spark, rows), common)
    for threshold in (0.5,):
        got = {(min(r.a, r.b), max(r.a, r.b)): r.jaccard for r in spotsigs.similar_pairs(classed, threshold).collect()}
        sets = {}
        for d, t in sorted(rows):
            sets.setdefault(frozenset(signatures(t, common)), d)
        expected = {(min(x, y), max(x, y)): like(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if like(a, b) >= threshold}
        assert got == pytest.approx(expected) and set(got) == set(expected)
