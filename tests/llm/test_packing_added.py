import zlib

import numpy as np
import pytest

import corpus_pipeline
from distloom.llm import packing, queries
from tests.llm.conftest import make_docs

tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["<|endoftext|> x", "a  <|endoftext|><|endoftext|>\n b", "x<|endoftext|", "it's <|endoftext|>'s", "<|endoftext|>", "plain  text ", None, ""]


@pytest.fixture(scope="module")
def reference():
    """The tokenizer with its default settings."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(reference, corpus):
    added = packing.added_tokens(tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, added)
    assert encode("<|endoftext|> x") == [50256, 2124]
    for text in [*TEXTS, *[t for _, t in corpus]]:
        assert encode(text or "") == reference(text)


@pytest.mark.parametrize("name", ["query", "stage"])
def test_production_gives_added_tokens_their_ids(spark, reference, tmp_path, name):
    docs = make_docs(spark, list(enumerate(TEXTS)))
    if name == "query":
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        found = queries.op1_packing(spark, str(tmp_path))
    else:
        found = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    # All windows stay open, so a merging task joins the texts end to end and cuts none.
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in found.collect()}
    ids = {d: np.array([*reference(t), packing.END], dtype="<u4") for d, t in enumerate(TEXTS)}
    assert got == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in ids.items()}
