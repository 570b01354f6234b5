import random

from distloom.llm import licenses
from tests.llm import brute
from tests.llm.conftest import make_docs


def words(text):
    out, word = [], ""
    for c in brute.lower(text) + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def base(text):
    w = words(text)
    places = [(i, t.label) for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases(spark):
    rng = random.Random(1)
    pieces = ["CC", "by", "cc-BY", "General Public", "license", "all rights", "Reserved.", "all", "xé", "--", "\x7f", "İ", "K", "rights\nreserved", "0"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(300)] + [(900, None), (901, ""), (902, "cc by " * 5000), (903, "!!")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_notices(spark):
    words = licenses._MIT.split()
    rows = [
        (1, "text Licensed under the Apache License, Version 2.0. more"), (2, "Released under the MIT License"), (3, "under GNU General Public License, version 3"),
        (4, "Licensed under CC BY-NC 4.0."), (5, "the apache licence"), (6, " ".join(words[:40] + ["other"] * 9 + words[49:])), (7, "an apache license stands alone"),
        (8, licenses._GPL.format(2).upper()), (9, " ".join(words[:12])), (10, "-- " + licenses._BSD + " x " + licenses._BSD_3), (11, "free of charge to any person hereby granted"), (12, " ".join(words[2:])),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(make_docs(spark, rows)).collect()}
    assert got == {1: "apache-2", 2: "mit", 3: "gpl,gpl-3", 4: "cc-by,cc-by-nc", 5: "", 6: "mit", 7: "", 8: "gpl,gpl-2", 9: "", 10: "bsd,bsd-3", 11: "", 12: "mit"}
    assert licenses.scan(make_docs(spark, [])).count() == 0


def test_every_template_is_found_where_it_stands(spark):
    rows = [(i, f"some words {t.text} and others") for i, t in enumerate(licenses.NOTICES)]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.scan(make_docs(spark, rows)).collect()}
    for i, t in enumerate(licenses.NOTICES):
        assert t.label in got[i][0] and got[i][1] == 1.0


def test_rarest_words_come_first():
    t = [licenses.Template("x", "the apache license", "apache license")]
    assert licenses.by_rarity(t, {"apache": 5, "license": 9}) == ["apache", "license"]
    assert licenses.by_rarity(t, {"apache": 9, "license": 5}) == ["license", "apache"]
    assert licenses.by_rarity(t, {}) == ["apache", "license"]
