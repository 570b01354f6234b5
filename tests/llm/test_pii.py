import hashlib
import random
import re

import numpy as np
import pytest

from distloom.llm import pii
from tests.llm.conftest import make_docs


def plain_base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_rules():
    rng = random.Random(9)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "x", " ", "-", "+", "9", "0", "(", "e.f%g@h-i.jk.lm", "@@", "..", "a@b", "1.2.3.4.5.6.7.8", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_of_zeros_in_an_address():
    text = "a 0." + "0" * 5000 + ".0.0 b " + "0" * 9000 + "9.1.1.1 " + "0" * 5000 + "256.1.1.1"
    found = [s for s in pii.base_spans(text) if s[0] == "ip"]
    assert [text[s:e].split(".")[0].lstrip("0") for _, s, e in found] == ["", "9"]


@pytest.fixture(scope="module")
def model():
    return pii.fit(*pii.examples(["the quick brown fox jumps over the lazy dog"]))


def test_held_out_accuracy(model):
    x, y = pii.examples(["another line of other words stands here"], n=600, seed=99)
    chosen = model.probability(x) >= model.threshold
    assert y[chosen].mean() > 0.95
    assert chosen[y == 1].mean() > 0.8
    assert model.threshold >= 0.5


def test_spans(model):
    text = 'mail a.b@c.org, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962.'
    base, every = pii.spans(text, model)
    assert [k for k, _, _ in base] == ["email"]
    assert [k for k, _, _ in every] == ["email", "secret"]
    assert pii.redacted(text, every).startswith('mail [EMAIL], token = "[SECRET]" and commit 04')
    assert pii.spans("plain words and the year 1999 in 3 parts", model) == ([], [])
    assert pii.spans(None, model) == ([], [])


def test_detect_and_redact(spark):
    rows = [(1, "call +1 (555) 123-4567 now"), (2, None), (3, ""), (1, "call +1 (555) 123-4567 now"), (4, "9" * 200_000), (5, "a" * 200_000 + "@"), (6, "clean text")]
    docs = make_docs(spark, rows)
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.detect(docs, model).collect()}
    assert got[1].spans == "phone:5:22" and got[1].n_phone == 1
    assert got[1].base_sha256 == hashlib.sha256(b"phone:5:22").hexdigest()
    assert got[2].spans == got[6].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert (texts[1], texts[2], texts[6]) == ("call [PHONE] now", None, "clean text")
    assert pii.detect(make_docs(spark, []), pii.train(make_docs(spark, []))).count() == 0


def test_isotonic_levels_rise(model):
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.knots) >= 0).all()
