"""The selector index against the batch join, and its behaviour at retries and folds."""

import random

from pyspark.sql import functions as F

from clusterlens.operators.relate import select_pods
from clusterlens.streaming.selectors import SelectorIndex

POD = "cluster_uuid STRING, uuid STRING, namespace STRING, labels MAP<STRING, STRING>, seq BIGINT, gone BOOLEAN"
SERVICE = POD.replace("labels", "selector")


def pairs(frame):
    return sorted(tuple(r) for r in frame.select("service_uuid", "pod_uuid").collect())


def test_any_order_of_batches_equals_the_join(spark, tmp_path):
    pick = random.Random(7)

    def entries(most):
        return {k: pick.choice("xy") for k in pick.sample("abcd", pick.randrange(most + 1))}

    def versions(prefix, most):
        out, seq = [], iter(pick.sample(range(1000), 120))
        for n in range(40):
            for _ in range(3):
                out.append((f"c{n % 2}", f"{prefix}{n}", f"ns{n % 3 % 2}", entries(most), next(seq), pick.random() < 0.2))
        pick.shuffle(out)
        return out

    def last(rows):
        found = {}
        for row in rows:
            if row[1] not in found or found[row[1]][4] < row[4]:
                found[row[1]] = row
        return [row for row in found.values() if not row[5]]

    pods, services = versions("p", 4), versions("s", 2)
    index = SelectorIndex(spark, str(tmp_path / "index"), buckets=4)
    assert pairs(index.read()) == []
    for number in range(4):
        index.services_changed(spark.createDataFrame(services[number::4], SERVICE), number)
        for _ in range(2 if number == 1 else 1):  # a batch written again changes nothing
            index.pods_changed(spark.createDataFrame(pods[number::4], POD), number)
    now = [spark.createDataFrame(last(rows), schema) for rows, schema in ((services, SERVICE), (pods, POD))]
    wanted = pairs(
        select_pods(now[0].withColumnRenamed("uuid", "service_uuid"), now[1].withColumnRenamed("uuid", "pod_uuid"), within=["cluster_uuid"])
    )
    assert wanted and pairs(index.read()) == wanted
    folded = index.folded(str(tmp_path / "folded"))
    assert pairs(folded.read()) == wanted
    # An older version that arrives after the fold still loses.
    folded.pods_changed(spark.createDataFrame([("c0", "p0", "ns0", {"a": "x", "b": "x", "c": "x", "d": "x"}, -1, False)], POD), 9)
    assert pairs(folded.read()) == wanted


def test_nulls_and_empty_batches(spark, tmp_path):
    index = SelectorIndex(spark, str(tmp_path / "index"), buckets=2)
    index.services_changed(spark.createDataFrame([], SERVICE), 0)
    index.pods_changed(spark.createDataFrame([(None, "p", None, {"a": "x"}, 1, False), (None, "q", None, None, 1, False)], POD), 0)
    index.services_changed(spark.createDataFrame([(None, "s", None, {"a": "x"}, 1, False), (None, "t", None, {}, 1, False), (None, "u", None, None, 1, False)], SERVICE), 1)
    assert pairs(index.read()) == [("s", "p")]
    index.pods_changed(spark.createDataFrame([(None, "p", None, None, 2, True)], POD), 1)
    assert pairs(index.read()) == []


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    index = SelectorIndex(spark, str(tmp_path / "index"), buckets=16)
    index.services_changed(spark.createDataFrame([("c", f"s{n}", "n", {"app": f"a{n}"}, 1, False) for n in range(200)], SERVICE), 0)
    one = spark.range(1).select(index._bucket("id").alias("bucket"))
    probed = index._read("anchors", one)
    assert 0 < len(probed.inputFiles()) and probed.select(F.col("bucket")).distinct().count() == 1
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_equal_selectors_are_matched_and_stored_once(spark, tmp_path):
    index = SelectorIndex(spark, str(tmp_path / "index"), buckets=2)
    pods = [("c", f"p{n}", "n", {"tier": "shop", "app": f"a{n % 2}"}, 1, False) for n in range(20)]
    index.pods_changed(spark.createDataFrame(pods[:10], POD), 0)
    for number in range(3):  # the same selector by many services, and again by newer versions of them
        index.services_changed(spark.createDataFrame([("c", f"s{n}", "n", {"tier": "shop"}, number, False) for n in range(30)], SERVICE), number)
    index.pods_changed(spark.createDataFrame(pods[10:], POD), 3)
    assert index._read("anchors").count() == 1 and index._read("pairs").count() == 20
    assert pairs(index.read()) == sorted((f"s{n}", f"p{k}") for n in range(30) for k in range(20))
    index.services_changed(spark.createDataFrame([("c", "s0", "n", {"app": "a1"}, 9, False), ("c", "s1", "n", {}, 9, False)], SERVICE), 4)
    found = pairs(index.read())
    assert [p for s, p in found if s == "s0"] == sorted(f"p{k}" for k in range(1, 20, 2))
    assert "s1" not in {s for s, _ in found} and len(found) == 28 * 20 + 10
