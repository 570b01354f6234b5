import zlib
from collections import defaultdict

import numpy as np
import pytest

from distloom.llm import packing
from tests.llm.conftest import make_docs

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


VOCABULARY = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def test_ids(reference, corpus):
    encode = packing.encoder(*VOCABULARY)
    odd = ["<|endoftext|> x", "   \t\n  a", "it's I'LL \U0001f600 你好 12½", "\x00\x1f\x7f", "  lead", "trail  ", "́é", "\r\n\r\n"]
    for text in [*odd, *[t for _, t in corpus]]:
        assert [*encode(text or ""), 0] == reference(text)


@pytest.mark.parametrize(("size", "most_open"), [(1024, 64), (64, 3)])
def test_pieces(spark, reference, corpus, size, most_open):
    docs = make_docs(spark, corpus).repartition(3)
    pieces = packing.pack(docs, *VOCABULARY, size=size, most_open=most_open).collect()
    expected = defaultdict(list)
    for d, t in corpus:
        expected[d].append(reference(t))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(expected)
    for d, found in by_doc.items():
        ids = expected[d][0]
        at = defaultdict(int)
        for p in found:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
            for i in range(p.start, p.start + p.length):
                at[i] += 1
        assert set(at.values()) == {len(expected[d])} and len(at) == len(ids)
    for found in by_sequence.values():
        end = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= size
    total = sum(p.length for p in pieces)
    assert total > 0.85 * size * (len(by_sequence) - 1)
    assert packing.pack(make_docs(spark, []), *VOCABULARY).count() == 0


def test_best_fit():
    w = packing.OpenWindows(10, 2, 0)
    assert w.place((1,), 6) == [] and w.place((2,), 7) == []
    assert w.place((3,), 3) == [(2, 1, 0), (3, 1, 7)]  # fills the fuller one
    assert w.place((4,), 8) == []
    assert w.place((5,), 5) == [(4, 2, 0)]  # none fits: the fullest goes
