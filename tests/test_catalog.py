from distloom.operators import catalog
from distloom.plans.index import build_index
from tests.test_index import TOY, files, lines


def entries(spark):
    return build_index(lines(spark, TOY), files(spark)).entries


def rows(spark, **kw):
    found = catalog.listing(entries(spark), **kw).orderBy("dir", "seq").collect()
    out = {}
    for r in found:
        out.setdefault(r.dir, []).append((r.display_name, r.type))
    return out, found


def test_listing(spark):
    got, found = rows(spark)
    assert got == {
        "": [("usr", "DIR")],
        "usr": [("..", "UP"), ("bin", "DIR"), ("man", "DIR"), ("sbin -> bin", "LNKD")],
        "usr/bin": [("..", "UP"), ("a", "f"), ("b", "f"), ("f", "f")],
        "usr/man": [("..", "UP"), ("c", "f")],
    }
    link = next(r for r in found if r.kind == "dirlink")
    assert (link.navigate_path, link.size, link.subgroup, link.line_no) == ("usr/bin", None, None, 7)


def test_listing_with_a_name(spark):
    assert rows(spark, query=" C ")[0] == {"": [("usr", "DIR")], "usr": [("..", "UP"), ("man", "DIR")], "usr/bin": [("..", "UP")], "usr/man": [("..", "UP"), ("c", "f")]}
    assert {name for shown in rows(spark, query="%")[0].values() for name, _ in shown} == {".."}  # no pattern, a text


def test_selection(spark):
    e = entries(spark)
    pick = lambda *r: [x.line_no for x in catalog.select_rows(e, spark.createDataFrame([("t", "toy", *x) for x in r], "dist string, product string, kind string, path string, line_no int")).orderBy("line_no").collect()]
    assert pick(("directory", "usr/bin", None)) == [2, 4, 10]
    assert pick(("dirlink", "usr/sbin", 7)) == [7]
    assert pick(("parent", "", None)) == []
    assert pick(("directory", "usr", None), ("entry", "usr/bin/a", 2)) == [1, 2, 4, 5, 7, 10]
    tree = lambda p: [x.line_no for x in catalog.select_trees(e, spark.createDataFrame([("t", "toy", p)], "dist string, product string, path string")).orderBy("line_no").collect()]
    assert tree("") == [1, 2, 4, 5, 7, 10]
    assert tree("usr/man") == [5]
    assert [tuple(r) for r in catalog.filtered_counts(e, "toy.man*").collect()] == [("t", "toy", 1)]


def test_path_export(spark, tmp_path):
    chosen = spark.createDataFrame([(1, "b"), (2, ""), (3, "a"), (4, "b")], "position int, rel_path string")
    out = catalog.path_export(chosen)
    assert sorted(map(tuple, out.collect())) == [(1, "/b"), (3, "/a")]
    catalog.write_paths(out, str(tmp_path / "x"))
    assert [r.value for r in spark.read.text(str(tmp_path / "x")).collect()] == ["/b", "/a"]
