import random

import numpy as np
import pyarrow as pa
import pytest

from distloom.llm import regions, suffixarrays, suffixtrees
from tests.llm import brute
from tests.llm.conftest import make_docs


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    middle = "".join(rng.choice("abcd ") for _ in range(900))
    for cutter, window in ((regions.ByteCutter(60, 8), 60), (regions.WordCutter(7, 2), 7)):
        seen = {}
        texts = ["x y z " * 9 + middle, "short", middle + " tail end", None, "aaaa " * 40]
        for block in cutter.blocks(texts):
            for i, (t, a, first, last) in enumerate(zip(block.text, block.anchor, block.first, block.last, strict=True)):
                text = texts[t].encode()
                units = [text[j : j + 1] for j in range(len(text))] if window == 60 else text.split()
                joint = b"" if window == 60 else b" "
                assert block.units(i) == joint.join(units[first : last + window])
                for k in range(first, last + 1):
                    assert seen.setdefault(joint.join(units[k : k + window]), a) == a
        expected = sum(max(0, len((t or "").encode() if window == 60 else (t or "").split()) - window + 1) for t in texts)
        assert sum(int((b.last - b.first + 1).sum()) for b in cutter.blocks(texts)) == expected


@pytest.mark.parametrize("cutter", [regions.ByteCutter(50, 8), regions.WordCutter(9, 3)])
def test_long_texts_in_segments(monkeypatch, cutter):
    rng = random.Random(5)
    text = "".join(rng.choice("ab ") for _ in range(9000))

    def anchors():
        found = [(f, n, a) for b in cutter.blocks([text]) for f, n, a in zip(b.first, b.last - b.first + 1, b.anchor, strict=True)]
        assert all(f + n == g for (f, n, _), (g, _, _) in zip(found, found[1:], strict=False)) and found[0][0] == 0
        return [a for _, n, a in found for _ in range(n)]

    whole = anchors()
    monkeypatch.setattr(regions, "SEGMENT", 300)
    assert anchors() == whole
    assert [w for _, words in regions.words_in_segments(text) for w in words] == text.encode().split()


def words_expected(rows, n):
    return sorted((d, *brute.word_dedup(list(set(rows)), n)[d]) for d, _ in rows)


def test_words(spark, corpus):
    docs = make_docs(spark, corpus)
    for group in (20_000, 2):  # longer prefixes, and whole windows, where more than two suffixes share one
        got = suffixtrees.dedup(docs, window=6, gram=2, prefixes=(2, 4, 6), group=group).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == words_expected(corpus, 6)
    assert suffixtrees.dedup(make_docs(spark, [])).count() == 0


def test_words_with_production_parameters(spark, corpus):
    got = suffixtrees.dedup(make_docs(spark, corpus), texts=False).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == words_expected(corpus, 13)


def test_words_that_plain_hashes_confuse(spark):
    """The Thue-Morse word and its twin, letters swapped: polynomials modulo 2**64 do not tell them apart."""
    letters = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rest = " " + " ".join(f"w{i}" for i in range(12))
    got = suffixtrees.dedup(make_docs(spark, [(1, letters + rest), (2, letters.translate({97: "b", 98: "a"}) + rest)])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_long_words(spark):
    long = [c * 300 for c in "abcdefghijklmnop"]
    rows = [(1, " ".join(long)), (2, "x " + " ".join(long[1:])), (3, " ".join(long[:12] + ["a" * 299] + long[13:]))]
    got = suffixtrees.dedup(make_docs(spark, rows), texts=False).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == words_expected(rows, 13)


def test_null_ids_come_last(spark):
    text = " ".join(map(str, range(20)))
    got = suffixtrees.dedup(make_docs(spark, [(None, text), (3, text), (None, text)])).collect()
    assert sorted((r.n_removed for r in got)) == [0, 20, 20]


def test_subtrees():
    rng = random.Random(7)
    for alphabet, n in ((["a", "ab"], 60), (["x", "y\x01", "y", "é", "\x00"], 200), (["w"], 9), ([f"v{i}" for i in range(300)], 50)):
        rows = [[rng.choice(alphabet) for _ in range(rng.choice((2, 4, 6)))] for _ in range(n)]
        first = np.array([rng.randrange(5) for _ in range(n)])
        for least in (2, 4):
            got = suffixtrees.repeated_depths([" ".join(r).encode() for r in rows], first, least)
            for i, row in enumerate(rows):
                depths = [k for k in range(len(row), least - 1, -1) if any(first[j] < first[i] and rows[j][:k] == row[:k] for j in range(n))]
                assert got[i] == (depths[0] if depths else 0)


def test_bytes(spark, corpus):
    docs = make_docs(spark, corpus)
    expected = brute.byte_dedup(corpus, 40)
    for shard in (2_000, 3):  # split anchors, merged across shards
        got = suffixarrays.dedup(docs, window=40, gram=8, shard=shard).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == expected
    assert suffixarrays.dedup(make_docs(spark, [])).count() == 0


def test_bytes_with_production_parameters(spark, corpus):
    rows = [*corpus, (None, corpus[0][1]), (None, corpus[1][1]), (200, corpus[2][1] + " and " + corpus[1][1])]
    got = suffixarrays.dedup(make_docs(spark, rows), texts=False).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute.byte_dedup(rows, 200)


def test_suffix_array_and_prefixes():
    rng = random.Random(6)
    for data in (bytes(rng.choice(b"ab") for _ in range(3000)), b"abc" * 500, b"a", bytes(rng.randrange(256) for _ in range(999))):
        n, depth = len(data), 64
        words = suffixarrays.eights(np.frombuffer(data, dtype=np.uint8), depth)
        order = suffixarrays.suffix_array(words, n, depth)
        heads = [data[i : i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order) == list(range(n)) and heads == sorted(heads)
        got = suffixarrays.common_prefixes(words, order, depth)
        for a, b, g in zip(heads, heads[1:], got[1:], strict=False):
            assert g == next((i for i in range(depth) if a[i] != b[i]), depth)


def test_shards_without_a_repeated_window():
    """Regions of one anchor of which no window stands twice, long and short, whole and split."""
    rng = random.Random(8)
    for size, parts in ((300, 1), (300, 2), (90, 1)):
        units = [bytes(rng.randrange(256) for _ in range(size)) for _ in range(2)]
        rows = {"shard": [1, 1], "region": [b"a", b"b"], "n": [1, 1], "parts": pa.array([parts] * 2, pa.int32()), "units": units}
        got = pa.Table.from_batches(suffixarrays._shards(200)(iter([pa.RecordBatch.from_pydict(rows)])))
        windows = 2 * (size - 199) if parts > 1 else 0
        assert (got.num_rows, got.column("spans").null_count, sum(got.column("again").to_pylist())) == (windows, windows, 0)
