from pyspark.sql import functions as F

from distloom.plans.stored import BATCH, stored


def test_batches_to_python_are_small(spark):
    """Rows with contents cross in batches of BATCH bytes, and the session keeps its own setting."""
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", BATCH // 4
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield batch[["id"]].assign(id=len(batch))

    rows = spark.range(0, 16, 1, 1).withColumn("content", F.expr(f"cast(repeat('x', {size}) AS binary)"))
    assert {r.id for r in stored(rows.mapInPandas(sizes, "id long")).collect()} <= {1, 2, 3, 4}
    assert spark.conf.get(key) == before
