"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from distloom.plans.stored import shared_folder, small_batches

ASCII_SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: short lineage, and nothing is computed twice."""
    return cut_observed(df)[0]


def cut_observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """What cut returns, and aggregates of df that are taken while it is written."""
    spark = df.sparkSession
    path = shared_folder(spark)
    seen = Observation() if measures else None
    with small_batches(spark):
        (df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if seen else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if seen else {}


def discard(df: DataFrame) -> None:
    """Deletes the table that cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_between(text: Column, separators: str) -> Column:
    """The array of words of a text, split at runs of the class `separators`; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def text_key(text: Column) -> Column:
    """16 bytes that tell a text from others, null from empty too."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit(""))))


#: Cells of a sieve: the most rows that it broadcasts.
CELLS = 1 << 20


def sieve(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Splits rows into those whose key may be among wanted, and those whose key is not.

    Keys fall into CELLS cells by hash; only the cells in use are broadcast, however many keys there are. Rows that
    pass still need a join; the others never move.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("__cell")
    cells = F.broadcast(wanted.select(cell).distinct())
    placed = rows.withColumn("__cell", cell)
    return placed.join(cells, "__cell", "left_semi").drop("__cell"), placed.join(cells, "__cell", "left_anti").drop("__cell")


def stay(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their group, once; grouped holds doc_id, text_key and root of every row.

    A row is told by doc_id and text, so rows of one id, or without one, are decided each for itself. Null ids
    come last; rows that repeat both are one document. Only rows of groups with several may be moved.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    several = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("doc_id", "text_key"), order).alias("least")).where("n > 1")
    several = cut(several.select("root", F.col("least.doc_id").alias("kept_id"), F.col("least.text_key").alias("kept_key")))
    least = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    rows = grouped.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    touched, seen = cut_observed(rows.join(several, "root").select("doc_id", "text_key", "times", least.alias("least")), most=F.max(F.when(F.col("least"), F.col("times"))))
    gone = touched.where("NOT least").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    repeated = (seen["most"] or 0) > 1
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    maybe, others = sieve(keyed, touched.select(F.col("text_key").alias("__key")), "__key")
    found = maybe.join(gone, maybe.doc_id.eqNullSafe(gone.gone_id) & (maybe["__key"] == gone.gone_key), "left_anti")
    found = found.dropDuplicates(["doc_id", "__key"]) if repeated else found
    return found.unionByName(others).drop("__key")
