import random

from distloom.llm import quality
from tests.llm import brute
from tests.llm.conftest import make_docs


def test_measures(spark, corpus):
    got = sorted(map(tuple, quality.ledger(make_docs(spark, corpus)).drop("failures").collect()))
    assert got == sorted((d, *brute.quality(t)) for d, t in corpus)


def test_repeats_of_long_texts_are_exact():
    rng = random.Random(1)
    for n in (6, 50, 9000):
        words = [str(rng.randrange(3 if n < 100 else 40)).encode() for _ in range(n)]
        assert quality.repeated_words(words) == brute.quality(b" ".join(words).decode())[5]


def test_policies_and_ablations(spark, corpus):
    entries = quality.ledger(make_docs(spark, corpus)).cache()
    rows = entries.collect()
    names = list(quality.RULES)
    for r in quality.ablations(entries).collect():
        mask = quality.mask(r.policy)
        bit = 1 << names.index(r.rule)
        assert r.n_kept == sum(not x.failures & mask for x in rows)
        assert r.n_only_this_rule == sum(x.failures & mask == bit for x in rows)
    assert all(r.failures & 1 == (r.n_words < 10) for r in rows)


def test_keep(spark, corpus):
    docs = make_docs(spark, corpus)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.ledger(docs).where(quality.accepted(quality.F.col("failures"))).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in corpus if d in good)


def test_a_stored_ledger_serves_every_policy(spark, corpus):
    docs = make_docs(spark, [*corpus, (None, corpus[0][1]), (None, corpus[1][1])])
    entries = quality.stored_ledger(docs)
    for policy in quality.POLICIES:
        expected = quality.ledger(docs).where(quality.accepted(quality.F.col("failures"), policy)).count()
        assert quality.keep(docs, policy, entries).count() == expected


def test_sole_rules(spark):
    texts = [(1, "one"), (2, "a b c d e " * 9), (3, "# * $ % & | < > a b c d"), (4, " ".join(map(str, range(40)))), (5, "# # #")]
    found = quality.ledger(make_docs(spark, texts)).select("doc_id", quality.sole_rule(quality.F.col("failures")).alias("rule"))
    assert {r.doc_id: r.rule for r in found.collect()} == {1: "few_words", 2: "repeated_windows", 3: "symbols", 4: None, 5: None}


def test_empty(spark):
    assert quality.ledger(make_docs(spark, [])).count() == 0
