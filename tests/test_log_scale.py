"""Log tails of large tables."""

from pyspark.sql import functions as F


def test_sparse_positions_fit(spark):
    """Positions of a large table are still in order and no number overflows."""
    from clusterlens.checks import core

    class Some:
        documents = spark.range(1_000_000, 1_000_300).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.format_string("%d\n", "id").alias("text"))

    Some.spark = spark
    assert [r.logs for r in core.log_tail_sparse(Some).collect()] == ["".join(f"{n}\n" for n in range(1_000_000, 1_000_300))]


def test_chunks_of_few_containers_are_not_shuffled(spark):
    """A join by container would bring all text of one container to one task, whatever the size of the look-up is estimated at."""
    from clusterlens.operators import logs

    chunks = spark.range(100).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("container_uuid"), F.col("id").alias("seq"))
    containers = spark.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("uuid"), (F.col("id") != 1).alias("started"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = logs.wanted_chunks(chunks, containers)
        assert "SortMergeJoin" not in wanted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.container_uuid for r in wanted.collect()} == {"c0", "c2"} and wanted.count() == 67
