import glob
import time

import pytest
from pyspark.sql import functions as F

from distloom import archives
from distloom.operators import unpack
from distloom.plans.stored import buckets, stored, stored_by
from tests.test_unpack import CONTENT, asked, image, images, record  # noqa: F401

BROKEN = image(record("usr/bin/a", b"x" * 40), record("usr/bin/f", bytes.fromhex("1F9D906104FE")), record("usr/bin/b", b"12"))


@pytest.mark.parametrize(
    ("content", "options", "in_table"),
    [(CONTENT, unpack.Options(keep_z=True, link_fallback=True), True), (CONTENT[:-1], unpack.Options(no_decompress=True), False), (BROKEN, unpack.Options(keep_z=True), False), (BROKEN, unpack.Options(), True)],
)
def test_sink_of_requests_holds_what_the_sink_of_contents_holds(spark, asked, tmp_path, content, options, in_table):  # noqa: F811
    unpack.write_unpacked(unpack.with_clashes(unpack.unpack(asked, images(spark, content), options)), f"{tmp_path}/whole")
    whole = sorted(spark.read.parquet(f"{tmp_path}/whole").collect(), key=str)
    (tmp_path / "toy.sw").write_bytes(content)
    named = spark.createDataFrame([("t", "toy.sw", f"file://{tmp_path}/toy.sw")], "dist string, rel_path string, uri string")
    unpack.unpack_to(asked, images(spark, content) if in_table else named, f"{tmp_path}/sink", options)
    assert any(r.content for r in whole)
    assert sorted(spark.read.parquet(f"{tmp_path}/sink").collect(), key=str) == whole


def test_contents_lie_in_the_archive_and_the_sink_alone(spark, tmp_path, monkeypatch):
    texts = [None, "", *(f"text {n} " * 50 for n in range(198))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for module in (archives, unpack):
        monkeypatch.setattr(module, "stored", lambda df, plain=module.stored: seen.append(plain(df)) or seen[-1])
    found = archives.unpacked_table(spark, str(tmp_path))
    assert found.agg(F.sum("n_bytes")).first()[0] > 80_000
    kept = [(df, c) for df in seen for c in ("content", "z_content") if c in df.columns and "lines" not in df.columns]
    assert kept and all((df.agg(F.sum(F.length(c))).first()[0] or 0) < 100 for df, c in kept)


def test_shuffle_files_go_with_their_action(spark):
    pattern = f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data"
    before = set(glob.glob(pattern, recursive=True))
    assert len(stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    until = time.time() + 20
    while (left := set(glob.glob(pattern, recursive=True)) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_buckets_stay_where_they_are(spark):
    rows = spark.range(100).select((F.col("id") % 9).alias("k"), F.col("id").alias("v")).repartition(buckets(spark), "k")
    tables = {t.name for t in spark.catalog.listTables()}
    kept = stored_by(rows, "k")
    assert {t.name for t in spark.catalog.listTables()} == tables
    joined = kept.join(spark.range(9).select(F.col("id").alias("k")).hint("merge"), "k")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(joined.collect()) == sorted(rows.select("k", "v").collect())
