import pytest

from distloom.llm import simhash
from tests.llm.conftest import make_docs

A, B, C = ("the quick brown fox jumps over it", "some quite different words stand in here", "and a third text of yet other words")


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(None, A), (None, B), (None, B), (None, C), (3, C)], [(3, C), (None, A), (None, B)]),  # null ids are no document of one id
        ([(1, A), (7, B), (7, A)], [(1, A), (7, B)]),  # one id on two texts: only the copy goes
        ([(7, A), (7, B), (9, C), (9, C)], [(7, A), (7, B), (9, C)]),
        ([(2, A), (2, A.upper()), (None, None), (None, "")], None),  # near copies of one id: one of them
    ],
)
def test_rows_are_decided_by_id_and_text(spark, rows, expected):
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(make_docs(spark, rows)).collect()), key=str)
    if expected is None:
        assert [d for d, _ in got] == [2, None]
    else:
        assert got == sorted(expected, key=str)
