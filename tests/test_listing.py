from distloom.plans.index import build_index, index_errors
from distloom.sources import dists
from tests.test_index import files, lines


def test_index_errors_alone(spark):
    text = ["f 0644 root sys a src/a toy.sw.base size(1)", "f 0644 root sys b src/b toy.gone.base size(1)", "short"]
    wanted = spark.createDataFrame([("t", "other", "t/other.idb")], "dist string, product string, uri string")
    given = lines(spark, text), files(spark), wanted
    own = sorted(index_errors(*given).collect(), key=str)
    assert own == sorted(build_index(*given).errors.collect(), key=str) and len(own) == 2


def test_directories_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Each directory is one task's; names that begin with `_` or `.` are there, folders and checksum files are not; index files need no list of paths in the driver."""
    for dist in ("b0", "b1", "b2"):
        (tmp_path / dist / "inner").mkdir(parents=True)
        for name in ("p.idb", "_q.IDB", ".hidden.idb", ".p.idb.crc", "p.sw"):
            (tmp_path / dist / name).write_bytes(b"one\r\ntwo")
    (tmp_path / "empty").mkdir()
    listed = dists.dist_files(spark, f"file://{tmp_path}/*")
    assert listed.rdd.getNumPartitions() == 4
    got = {(r.dist, r.rel_path, r.uri, r.length) for r in listed.collect()}
    assert got == {(d, n, f"file:{tmp_path}/{d}/{n}", 8) for d in ("b0", "b1", "b2") for n in ("p.idb", "_q.IDB", ".hidden.idb", "p.sw")}
    monkeypatch.setattr(type(listed), "collect", None)
    rows = dists.index_lines(spark, f"file://{tmp_path}/*")
    assert {tuple(r) for r in rows.toLocalIterator()} == {(d, p, n, x) for d in ("b0", "b1", "b2") for p in ("p", "_q") for n, x in ((1, "one"), (2, "two"))}
