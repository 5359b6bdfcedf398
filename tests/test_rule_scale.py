"""What the routing of events does not do as rules, events and tables grow."""

from pyspark.sql import functions as F

from clusterlens.operators import notify


def test_rules_of_a_cluster_are_matched_per_cluster(spark):
    """A query bound to the cluster alone meets each row of its table once per cluster, not once per event and row."""
    events = spark.range(20_000).select(
        F.col("id").cast("string").alias("uuid"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("cluster_uuid"), F.lit("pod").alias("kind")
    )
    # 400 million pairs of an event and a row.
    rows = spark.range(40_000).select(F.lit("c1").alias("cluster"), F.col("id").cast("int").alias("n"))
    rules = [
        notify.Rule("bound", "pod", "SELECT 1 FROM cluster_row WHERE cluster = ? AND n >= ?", (":cluster_uuid", 0)),
        notify.Rule("twin", "pod", "SELECT 1 FROM cluster_row WHERE cluster = ? AND n >= ?", (":cluster_uuid", 0)),
        notify.Rule("beyond", "pod", "SELECT 1 FROM cluster_row WHERE cluster = ? AND n >= ?", (":cluster_uuid", 40_000)),
        notify.Rule("unset", "pod", "SELECT 1 FROM cluster_row WHERE n = 0 AND ? IS NULL", (":cluster_uuid",)),
        notify.Rule("free", "pod", "SELECT 1 FROM cluster_row WHERE n < ?", (5,)),
        notify.Rule("own", "pod", "SELECT 1 FROM cluster_row WHERE n = ?", (":uuid",)),
        notify.Rule("zero", "pod", "SELECT 1 FROM cluster_row WHERE cluster = ? AND 1 / ? > 0", (":cluster_uuid", 0)),
    ]
    routed, rejected = notify.match_rules(spark, events, rules, {"cluster_row": rows})
    assert list(rejected) == ["zero"]
    found = {(r.cluster_uuid, tuple(r.rule_ids), r["count"]) for r in routed.groupBy("cluster_uuid", "rule_ids").count().collect()}
    assert found == {
        ("c1", ("bound", "free", "own", "twin"), 6667),
        ("c2", ("free", "own"), 6666),
        (None, ("free", "own", "unset"), 6667),
    }
    assert notify.Template(0, "pod", "SELECT ?", (":cluster_uuid", "bigint")).bound() == ("cluster_uuid",)


def _brute(limits, rows, uuid):
    """The ids of (id, above, line) that rows of the object match."""
    return sorted({id_ for id_, above, line in limits for u, n, m in rows if u == uuid and n > above and m == line})


def test_many_cases_are_bits_of_words(spark, monkeypatch):
    """More cases than a row of matches holds, ids of several cases, and parts of a few ids; nothing is collected into sets."""
    monkeypatch.setattr(notify, "IDS_AT_ONCE", 50, raising=False)
    monkeypatch.setattr(notify, "WORDS_AT_ONCE", 40, raising=False)
    limits = [(f"r{k % 900}", k % 250, k % 4) for k in range(1000)]
    items = [(None if u == 9 else f"u{u}", (u * 37 + i * 11) % 300, i % 5) for u in range(40) for i in range(u % 7)]
    events = [(None if u == 9 else f"u{u % 60}", f"c{u % 2}", "node" if u == 8 else "pod") for u in range(70)]
    rules = [notify.Rule(i, "pod", "SELECT 1 FROM item WHERE owner = ? AND n > ? AND m = ?", (":uuid", above, line)) for i, above, line in limits]
    rules += [notify.Rule("r5"), notify.Rule("always"), notify.Rule("here", "pod", "SELECT 1 FROM item WHERE ? = 'c1'", (":cluster_uuid",))]
    plans = []
    found = notify.Template.matches
    monkeypatch.setattr(notify.Template, "matches", lambda *args: plans.append(found(*args)) or plans[-1])
    table = spark.createDataFrame(items, "owner string, n int, m int")
    routed, rejected = notify.match_rules(spark, spark.createDataFrame(events, "uuid string, cluster_uuid string, kind string"), rules, {"item": table})
    assert not rejected
    places = {(u, k): {c for v, c, l in events if (v, l) == (u, k)} for u, _, k in events}
    expected = []
    for uuid, cluster, kind in events:
        named = {"r5", "always"}
        if kind == "pod" and uuid:
            named |= set(_brute(limits, items, uuid)) | ({"here"} if "c1" in places[uuid, kind] else set())
        expected.append((uuid or "", cluster, kind, tuple(sorted(named))))
    assert sorted((r.uuid or "", r.cluster_uuid, r.kind, tuple(r.rule_ids)) for r in routed.collect()) == sorted(expected)
    assert max(len(e[-1]) for e in expected) > 512
    assert plans and not any("collect_set" in p._jdf.queryExecution().toString() for p in plans)


def test_what_is_made_of_the_ids_is_made_in_the_same_step(spark):
    def joined(ids):
        import pyarrow as pa

        return pa.array([",".join(x) for x in ids.to_pylist()])

    events = spark.range(3).select(F.col("id").cast("string").alias("uuid"), F.lit("c").alias("cluster_uuid"), F.lit("pod").alias("kind"))
    rules = spark.createDataFrame(
        [(f"r{k}", '{"version": 1, "kind": "pod", "query": "SELECT 1 FROM one WHERE ? >= ?", "args": [":uuid", %d]}' % k) for k in range(3)] + [("all", "")], "id string, filter string"
    )
    routed, rejected = notify.match_rule_table(events, notify.judged_rules(rules), {"one": spark.range(1)}, (joined, "string"))
    assert not rejected
    assert sorted((r.uuid, r.rule_ids) for r in routed.collect()) == [("0", "all,r0"), ("1", "all,r0,r1"), ("2", "all,r0,r1,r2")]


def test_rules_at_fault_are_found_by_few_events(spark, monkeypatch):
    """All events are joined once per template, although rules of one fail; a rule that fails for a single object is found, too."""
    monkeypatch.setattr(notify, "TRIED", 5, raising=False)
    events = spark.range(2_000).select(F.col("id").cast("string").alias("uuid"), F.lit("c").alias("cluster_uuid"), F.lit("pod").alias("kind"))
    table = spark.range(2_000).select(F.col("id").cast("string").alias("owner"), F.col("id").cast("int").alias("n"))
    rules = [notify.Rule(f"part-{k}", "pod", "SELECT 1 FROM item WHERE owner = ? AND 1 / ? > 0", (":uuid", k)) for k in range(4)]
    rules += [notify.Rule(f"over-{k}", "pod", "SELECT 1 FROM item WHERE owner = ? AND n >= ?", (":uuid", k)) for k in (0, 1_000)]
    joined = []
    found = notify.Template.matches
    monkeypatch.setattr(notify.Template, "matches", lambda self, source, *args: joined.append(source) or found(self, source, *args))
    routed, rejected = notify.match_rules(spark, events, rules, {"item": table})
    assert list(rejected) == ["part-0"]
    others = ("over-0", "part-1", "part-2", "part-3")
    assert {(tuple(r.rule_ids), r["count"]) for r in routed.groupBy("rule_ids").count().collect()} == {(others, 1_000), (("over-0", "over-1000", *others[1:]), 1_000)}
    assert sum(source.startswith("_events_") for source in joined) == 2
    # Its object is hardly one of the first five.
    late = notify.Rule("late", "pod", "SELECT 1 FROM item WHERE owner = ? AND 1 / (n - ?) < 2", (":uuid", 1_777))
    routed, rejected = notify.match_rules(spark, events, [*rules, late], {"item": table})
    assert sorted(rejected) == ["late", "part-0"]
    assert {(tuple(r.rule_ids), r["count"]) for r in routed.groupBy("rule_ids").count().collect()} == {(others, 1_000), (("over-0", "over-1000", *others[1:]), 1_000)}
