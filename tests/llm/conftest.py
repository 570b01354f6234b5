import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows, schema=SCHEMA):
    """documents rows from (doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, schema)
    extra = {"key": "'x'", "region": "1", "n_words": "2", "fp": "3", "words": "'w'", "size": "4L", "marks": "5", "copies": "6", "anchor": "7", "component_id": "8"}
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).replace(" a", "\n").strip()
    passage = text(60)
    rows = [(i, text(rng.randrange(1, 120))) for i in range(30)]
    rows += [(30 + i, f"{text(20)} {passage} {text(20)}") for i in range(12)]
    base = text(150).split(" ")
    for i in range(12):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        rows.append((50 + i, " ".join(near)))
    rows += [(70 + i, rows[3][1]) for i in range(5)]
    rows += [(80, None), (81, ""), (82, " \t\n "), (83, "one"), (84, "ONE"), (85, "word " * 3000), (86, "ab" * 4000), (87, text(3000)), (88, "x y"), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows
