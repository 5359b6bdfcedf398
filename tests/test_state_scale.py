"""What streams with state send to the driver: their metrics, one of every partition of the state with every task over it."""

import json

import pytest
from pyspark.sql import functions as F

from clusterlens.plans.sync import Store
from clusterlens.sources.readers import read_changes
from clusterlens.streaming import jobs, state

_SHUFFLE = "spark.sql.shuffle.partitions"


@pytest.fixture
def deliveries(spark, tmp_path):
    """Ten records, each delivered twice."""
    document = json.dumps({"metadata": {"uid": "%1$s", "name": "%1$s", "resourceVersion": "7"}})
    uid = F.concat(F.lit("n"), (F.col("id") % 10).cast("string"))
    fields = {"op": F.lit("ADDED"), "seq": F.col("id") % 10, "kind": F.lit("namespace"), "uid": uid, "key": uid}
    fields |= {"object": F.format_string(document, uid), "cluster_uuid": F.lit("c1")}
    spark.range(20).select(*[c.alias(n) for n, c in fields.items()]).write.json(f"{tmp_path}/in/0")
    changes = read_changes(spark, f"{tmp_path}/in/*").withColumn("received", F.col("_metadata.file_modification_time"))
    return state.first_deliveries(changes)


def test_a_batch_of_a_stateful_stream_is_read_from_its_staging_folder(spark, tmp_path, monkeypatch, deliveries):
    """No plan but the first one of a batch starts at the state."""
    store, plans, seen = Store(spark, f"{tmp_path}/tables", ["namespace"]), [], []
    delete = Store.delete

    def recorded(self, kind, gone, *rest, **named):
        plans.append(gone._jdf.queryExecution().executedPlan().toString())
        delete(self, kind, gone, *rest, **named)

    monkeypatch.setattr(Store, "delete", recorded)
    writer = jobs.object_changes(
        deliveries,
        store,
        "namespace",
        clock=lambda: F.lit("2024-02-01").cast("timestamp"),
        stateful=True,
        on_upsert=[lambda rows, number: seen.extend(r.name for r in rows.select("name").collect())],
    )
    state.started(writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True), spark).awaitTermination()
    assert plans
    for plan in plans:
        assert "ExistingRDD" not in plan and "StreamingDeduplicate" not in plan
        assert "FileScan" in plan
    assert sorted(seen) == sorted(r.name for r in store.read("namespace").collect()) == [f"n{n}" for n in range(10)]
    # Nothing stays in the staging folder.
    assert not list((tmp_path / "tables" / "_staged").rglob("*.parquet"))


def test_partitions_of_a_state_grow_less_than_those_of_shuffles(spark, tmp_path, monkeypatch, deliveries):
    """Their square is what grows with the shuffle partitions; the settings of the session stay."""
    monkeypatch.setattr(state, "SPREAD", 1)
    before = spark.conf.get(_SHUFFLE)
    spark.conf.set(_SHUFFLE, "16")
    try:
        writer = deliveries.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        query = state.started(writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True), spark)
        assert spark.conf.get(_SHUFFLE) == "16"
        query.awaitTermination()
        assert {p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress if p["stateOperators"]} == {4}
    finally:
        spark.conf.set(_SHUFFLE, before)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
