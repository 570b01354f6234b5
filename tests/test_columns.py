"""Golden cases of the column functions."""

import re

import pytest
from pyspark.sql import functions as F

from distloom.functions import columns as C


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_octal(spark):
    assert values(spark, ["0755", "79", "-755", "+644", "7" * 30, "0", "x", "37777777777", "17777777777", "-20000000000"], C.octal) == [493, 0, -493, 420, 0, 0, 0, 0, 2147483647, -2147483648]


@pytest.mark.parametrize(
    ("attrs", "key", "expected"),
    [
        ("size(12", "size", "12"), ("size(1,000)", "size", "1,000"), ("size (4)", "size", None), ("size(5) size(x)", "size", "x"),
        ("size(1)cmpsize(2)", "cmpsize", "2"), ("(foo) size(3)", "size", "3"), ("mach(A) mach( B )", "mach", " B "), ("symval( a )", "symval", " a "),
        ("symval(a:)b)", "symval", "a:)b"), ("symval(a:)", "symval", "a:)"), ("CMPSIZE(3) x", "cmpsize", "3"), ("size(3) size", "size", "3"), ("size()", "size", ""),
    ],
)
def test_attributes(spark, attrs, key, expected):
    assert values(spark, [attrs], lambda x: C.attribute(C.attributes(x), key)) == [expected]


def test_whole_number(spark):
    assert values(spark, ["12", " 7 ", "x", "", None, "-3", "9" * 30], C.whole_number) == [12, 7, 0, 0, 0, -3, 0]


def test_paths(spark):
    inputs = ["/usr//bin/./x", "a/../b", "../../x", "a\\b", "/", "a/b/../../c"]
    assert values(spark, inputs, C.normalized_path) == ["usr/bin/x", "b", "x", "a/b", "", "c"]
    assert values(spark, inputs, C.safe_out_path) == ["usr/bin/x", "a/b", "x", "a\\b", "", "a/b/c"]
    assert values(spark, ["a/b/c", "a", ""], C.parent_path) == ["a/b", "", ""]
    assert values(spark, ["a/b/c", "a", ""], C.base_name) == ["c", "a", ""]
    assert values(spark, ["a/b/c", "a", ""], C.ancestors) == [["a", "a/b"], [], []]
    assert values(spark, ["bin", "/x/../y", "", "..\\z"], lambda t: C.link_path(F.lit("usr"), t)) == ["usr/bin", "y", "", "z"]


def test_under(spark):
    inputs = ["usr", "usr/a", "usrx", ""]
    assert values(spark, inputs, lambda p: C.is_under(p, F.lit("usr"))) == [False, True, False, False]
    assert values(spark, inputs, lambda p: C.is_under_or_equal(p, F.lit("usr"))) == [True, True, False, False]
    assert values(spark, inputs, lambda p: C.is_under_or_equal(p, F.lit(""))) == [True, True, True, False]


def test_subgroup_tokens(spark):
    tokens = ["toy.sw.base", "a.b", "a..b.c", "x(1).y.z", "usr/a.b.c", "a=b.c.d", "....."]
    assert values(spark, tokens, C.looks_like_subgroup) == [True, False, True, False, False, False, True]
    assert values(spark, tokens, C.subproduct) == ["toy.sw", "a.b", "a.b", "x(1).y", "usr/a.b", "a=b.c", None]


@pytest.mark.parametrize(
    ("mask", "expected"),
    [("", True), ("*", True), ("toy.*", True), ("toy.??.base", True), ("toy.[sm]*", True), ("[", True), ("toy.sw", False), ("toy.[!s]*", False), ("TOY.*", False), ("toy.[a-z]w.base", True), ("toy.[&^]*", False), ("a/b", False)],
)
def test_masks(spark, mask, expected):
    pattern = C.wildcard(mask)
    assert (values(spark, ["toy.sw.base"], lambda s: s.rlike(pattern)) == [True] if pattern else True) is expected


def test_stars_stay_within_a_part(spark):
    assert values(spark, ["a/b"], lambda s: s.rlike(C.wildcard("*"))) == [False]


def test_permissions(spark):
    assert spark.range(1).select(C.permissions(F.lit(0o104755))).first()[0] == 0o755


def test_plain_and_odd_tokens_agree(spark):
    lines = ["a b", " a  b ", "a\tb", "a\x0bb\r", "", " ", "a", "a\xa0b c"]
    assert values(spark, lines, C.tokens) == [[t for t in re.split(r"[ \t\n\x0b\x0c\r]+", x) if t] for x in lines]
    groups = ["a.b.c", "a.b", "a..b.c", ".a.b", "a.", "a.b.", "..", "ab", ""]
    assert values(spark, groups, C.subproduct) == ["a.b", "a.b", "a.b", "a.b", None, "a.b", None, None, None]


def test_large_index_reads_only_what_it_shows(spark):
    """Wanted columns alone are written, and come out as in the whole index."""
    from distloom.plans.index import build_index
    from tests.test_index import TOY, files, lines

    wanted = ["product", "line_no", "offset", "base_name"]
    some, every = build_index(lines(spark, TOY), files(spark), wanted=wanted), build_index(lines(spark, TOY), files(spark))
    assert some.entries.columns == wanted and sorted(some.entries.collect()) == sorted(every.entries.select(wanted).collect())
    assert sorted(some.warnings.collect()) == sorted(every.warnings.collect())
