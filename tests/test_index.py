"""The index job over hand-written dists, from rows and from files."""

from pyspark.sql import functions as F

from distloom.plans.index import build_index, scan_summary, with_offsets
from distloom.sources import dists

TOY = [
    "d 0755 root sys usr usr toy.sw.base",
    "f 0755 root sys usr/bin/a src/a toy.sw.base size(100) cmpsize(40)",
    "",
    "f 0644 root sys usr/bin/b src/b toy.sw.base size(7)",
    "f 0644 root sys usr/man/c src/c toy.man.pages size(5)",
    "f 0644 root",
    "l 0777 root sys usr/sbin src/sbin toy.sw.base symval(bin)",
    "f 0644 root sys usr/bin/d src/d noupdate config(x)",
    "f 0644 root sys usr/bin/e src/e ..... size(9)",
    "f 0644 root sys usr/bin/f src/f toy.sw.base CMPSIZE(3) size(9)",
]
FILES = [("t", "toy.idb"), ("t", "toy.sw"), ("t", "toy.man")]


def lines(spark, texts, product="toy"):
    return spark.createDataFrame([("t", product, i + 1, x) for i, x in enumerate(texts)], "dist string, product string, line_no int, line string")


def files(spark, rows=FILES):
    return spark.createDataFrame(rows, "dist string, rel_path string")


def test_toy(spark):
    index = build_index(lines(spark, TOY), files(spark))
    got = {r.line_no: r for r in index.entries.collect()}
    assert sorted(got) == [1, 2, 4, 5, 7, 10]
    assert (got[1].mode, got[1].payload_size, got[1].offset) == (493, 0, -1)
    assert [(got[n].payload_size, got[n].offset) for n in (2, 4, 5, 10)] == [(40, 13), (7, 64), (5, 13), (3, 82)]
    assert (got[7].offset, got[7].symval, got[7].full_path, got[7].parent_path, got[7].base_name) == (-1, "bin", "usr/sbin", "usr", "sbin")
    assert {r.line_no: r.message for r in index.warnings.collect()} == {6: "Line 6 ignored: not enough fields", 8: "Line 8 ignored: cannot locate subgroup token", 9: "Line 9 ignored: bad subgroup '.....'"}
    assert index.errors.count() == 0


def test_fatal_line_empties_its_product_only(spark):
    both = lines(spark, [*TOY, "x 0644 root sys x x ghost.sw.base size(1)"]).unionByName(lines(spark, TOY[:2], "other"))
    index = build_index(both, files(spark))
    assert [(r.product, r.line_no, r.message) for r in index.errors.collect()] == [("toy", 11, "Missing subproduct file 'ghost.sw' referenced by toy.idb:11")]
    assert {r["product"] for r in index.entries.select("product").collect()} == {"other"}
    assert index.warnings.count() == 0
    products = spark.createDataFrame([("t", "toy"), ("t", "other"), ("t", "none")], "dist string, product string")
    assert {tuple(r) for r in scan_summary(products, index).collect()} == {("t", "toy", 0, 0, "Missing subproduct file 'ghost.sw' referenced by toy.idb:11"), ("t", "other", 2, 0, None), ("t", "none", 0, 0, None)}


def test_token_order(spark):
    texts = [
        "file 0644 root sys a a size(3) x.y.z toy.sw.base",  # the second dotted token has an image
        "f 0644 root sys caf\xe9 a toy.sw.base size(1)",  # one byte for e acute
        "f 0644 root sys b b   toy.sw.base   size(2)   nostrip  toy.sw.base",  # only the first is taken out
        "f 0644 root sys c c toy.sw.base size(4)",
    ]
    got = build_index(lines(spark, texts), files(spark)).entries.orderBy("line_no").collect()
    assert [(r.ftype, r.subgroup, r.offset) for r in got] == [("f", "toy.sw.base", 13), ("f", "toy.sw.base", 19), ("f", "toy.sw.base", 26), ("f", "toy.sw.base", 31)]
    assert got[2].attrs_raw == "size(2) nostrip toy.sw.base"
    assert got[0].attrs_raw == "size(3) x.y.z"


def test_offsets_do_not_depend_on_stretches(spark):
    rows = spark.range(1, 500).select(F.lit("d").alias("dist"), F.lit("p").alias("product"), F.lit("p.sw").alias("subproduct"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 5 == 0, "d").otherwise("f").alias("ftype"), (F.col("id") % 13).alias("payload_size"), F.repeat(F.lit("n"), F.pmod("id", F.lit(7)).cast("int")).alias("fname"))
    a, b = (with_offsets(rows, n).select("line_no", "offset").orderBy("line_no").collect() for n in (10, 1 << 16))
    expected, at = [], 13
    for i in range(1, 500):
        expected.append(-1 if i % 5 == 0 else at)
        at += 0 if i % 5 == 0 else i % 13 + i % 7 + 2
    assert [r.offset for r in a] == expected == [r.offset for r in b]


def test_reading_dists(spark, tmp_path):
    toy = tmp_path / "toydist"
    toy.mkdir()
    (toy / "toy.idb").write_bytes("\r\n".join(TOY).encode("latin-1") + b"\r\n")
    (toy / "odd.name.IDB").write_bytes(b"f 0644 root sys caf\xe9 a toy.sw.base size(1)\n\nf 0644 root sys a\rb c toy.sw.base size(2)")
    (toy / ".hidden.idb").write_bytes(b"x")
    (toy / "_q.idb").write_bytes(b"f 0644 root sys a b _q.sw.base size(3)\n")
    for name in ("_q.sw", ".c.sw"):
        (toy / name).write_bytes(b"im")
    for name in ("toy.sw", "toy.man"):
        (toy / name).write_bytes(b"im")
    root = f"file://{tmp_path}/*dist"
    assert [(r.dist, r["product"]) for r in dists.discover_products(spark, root).orderBy("dist", "place").collect()] == [("toydist", "_q"), ("toydist", "odd.name"), ("toydist", "toy")]
    read = dists.index_lines(spark, root)
    assert {(r.line_no, r.line) for r in read.where("product = 'toy'").collect()} == set(enumerate(TOY, 1))
    assert {r.line_no for r in read.where("product = 'odd.name'").collect()} == {1, 2, 3}
    one = dists.index_lines(spark, f"file://{toy}/toy.idb")
    assert one.select("dist", "product").distinct().collect()[0] == ("toydist", "toy")
    listed = dists.dist_files(spark, root)
    assert {r.rel_path for r in listed.collect()} == {"toy.sw", "toy.man", "toy.idb", "odd.name.IDB", ".hidden.idb", "_q.idb", "_q.sw", ".c.sw"}
    asked = spark.createDataFrame([("toydist", "toy", "u"), ("toydist", "gone", "file:/gone.idb")], "dist string, product string, uri string")
    index = build_index(read, listed, asked)
    assert [r.message for r in index.errors.collect()] == ["Cannot open idb: file:/gone.idb"]
    assert index.entries.where("product = '_q'").first().offset == 13
    assert index.entries.where("product = 'odd.name'").orderBy("line_no").first().fname == "caf\xe9"
