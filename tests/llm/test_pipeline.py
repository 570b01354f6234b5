import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from distloom.llm import pii, queries
from distloom.llm.common import cut
from tests.llm import brute
from tests.llm.conftest import make_docs
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_copies import kept as kept_of_near_copies

tokenizers = pytest.importorskip("public_tokenizers")


def plain_quality(text):
    words, _, symbols, lines, dup, repeated = brute.quality(text)
    return not (words < 10 or 100 * repeated > 20 * words or 10 * symbols > 3 * words or (dup >= 3 and 10 * dup > 3 * lines))


def test_against_a_plain_version(spark, corpus, tmp_path):
    """Stages 1 to 3 row by row; the mix by its targets; the packing token by token."""
    from tokenizers import Tokenizer

    rows = [(d, t if t is None else f"{t} mail a{d}.b@c.org", "sr"[(d or 0) % 2]) for d, t in corpus]
    rows += [(None, rows[2][1] + " of no id at all", "s"), (None, rows[4][1] + " and none here as well", "r"), rows[7], (rows[9][0], rows[9][1] + " another text of the same id follows here", "s")]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = source
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == source.columns
    good = [(d, t) for d, t, _ in rows if plain_quality(t)]
    single = kept_of_near_copies(good)
    quality_kept = source.where("false").unionByName(source)  # the model is fitted on what reaches the stage
    stages = corpus_pipeline.STAGES
    before = cut(stages[1][1](spark, cut(stages[0][1](spark, quality_kept, "")), ""))
    assert sorted(((r.doc_id, r.text) for r in before.collect()), key=str) == single
    model = pii.train(before)
    expected = sorted(((d, pii.redacted(t, pii.spans(t, model)[1])) for d, t in single), key=str)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == expected
    assert all("[EMAIL]" in t and "@" not in t for _, t in expected)
    mixed = cut(stages[3][1](spark, docs, ""))
    sizes, taken, words = Counter(), Counter(), {}
    for r in docs.collect():
        words[r.doc_id, r.text] = len(brute.ascii_words(r.text))
        sizes[r.source] += words[r.doc_id, r.text]
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(copies) <= set(words) and max(copies.values()) <= 3
    for r in mixed.collect():
        taken[r.source] += words[r.doc_id, r.text]
    for s, target in plain_targets(dict(sorted(sizes.items()))).items():
        assert abs(taken[s] - target) <= 0.05 * target + 60
    encode = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    found = defaultdict(int)
    for p in stages[4][1](spark, mixed, "").collect():
        found[p.doc_id] += p.length
    tokens = defaultdict(int)
    for (d, t), n in copies.items():
        tokens[d] += n * (len(encode.encode(t, add_special_tokens=False).ids) + 1)
    assert found == tokens
    run = defaultdict(int)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        run[p.doc_id] += p.length
    assert run == found


def test_empty_and_bare_tables(spark, tmp_path):
    make_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    bare = make_docs(spark, [(1, "mail a.b@c.org now"), (None, None)]).select("doc_id", "text", "source")
    clean = corpus_pipeline.personal_data(spark, bare, "")
    assert clean.columns == bare.columns and {r.text for r in clean.collect()} == {"mail [EMAIL] now", None}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", queries.queries())
def test_queries_return_a_row_for_each_document(spark, name):
    found = queries.queries()[name](spark, DATA)
    n = found.count()
    if name not in ("op1_packing", "op10_toolcalls"):
        assert n == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert n
