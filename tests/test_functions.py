import uuid

import pytest
from pyspark.sql import functions as F

from clusterlens.functions import ids, quantity, text
from clusterlens.functions.state import STATE_NAMES, state_name, state_rank


def one(spark, column, *values):
    """The column over one row of literals v0, v1, ..."""
    row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
    return row.select(column.alias("x")).first()["x"]


V = lambda i=0: F.col(f"v{i}")


@pytest.mark.parametrize("data", ["", "abc", "Grüße", "日本語", "a" * 500])
def test_uuid5_is_the_standard_one(spark, data):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, ids.uuid5(V(0), V(1)), space, data) == str(uuid.uuid5(uuid.UUID(space), data))


@pytest.mark.parametrize(
    "uid",
    ["6BA7B810-9dad-11d1-80b4-00c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8", "urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8", "{6ba7b810-9dad-11d1-80b4-00c04fd430c8}"],
)
def test_uuids_are_kept(spark, uid):
    assert one(spark, ids.ensure_uuid(V()), uid) == "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def test_other_uids_are_derived(spark):
    expected = str(uuid.uuid5(uuid.UUID(ids.OBJECT_NAMESPACE), "not-a-uuid"))
    assert one(spark, ids.ensure_uuid(V()), "not-a-uuid") == expected


@pytest.mark.parametrize(
    ("written", "milli"),
    [("100m", 100), ("1", 1000), ("1.5", 1500), (".5", 500), ("128Mi", 134217728000), ("1G", 10**12), ("1e3", 10**6), ("250u", 1), ("1n", 1), ("0", 0), ("abc", None), ("2Ki", 2048000), ("-1", -1000)],
)
def test_quantities(spark, written, milli):
    assert one(spark, quantity.milli(V()), written) == milli


@pytest.mark.parametrize(("written", "units"), [("110", 110), ("1500m", 2), ("1Ki", 1024), ("3Ei", 3 * 2**60), ("9Ei", None)])
def test_whole_quantities(spark, written, units):
    assert one(spark, quantity.whole(V()), written) == units


@pytest.mark.parametrize(
    ("cidr", "count"),
    [("10.0.0.0/24", 254), ("10.0.0.0/31", 0), ("10.0.0.0/32", -1), ("10.0.0.0/1", -2), ("fd00::/112", 65534), ("fd00::/64", 2**63 - 3), ("", 0)],
)
def test_address_ranges(spark, cidr, count):
    assert one(spark, quantity.usable_addresses(V()), cidr) == count


def model_tail(value: str, size: int) -> str:
    data = value.encode()
    if len(data) <= size:
        return value
    cut = data[len(data) - size :]
    while cut and (cut[0] & 0xC0) == 0x80:
        cut = cut[1:]
    kept = cut.decode()
    return kept.split("\n", 1)[1] if "\n" in kept else kept


@pytest.mark.parametrize("size", range(1, 24))
@pytest.mark.parametrize("value", ["aé日😀\nxé日😀", "no line break at all", "\n\n\n", "😀" * 6])
def test_tail_never_splits_a_character(spark, value, size):
    assert one(spark, text.utf8_tail(V(), size), value) == model_tail(value, size)


@pytest.mark.parametrize(
    ("value", "stripped"), [(" a. ", "a"), ("a..", "a."), ("\t\n", ""), (" x .", "x "), (None, "")]
)
def test_strip_stop(spark, value, stripped):
    assert one(spark, text.strip_stop(V()), value) == stripped


@pytest.mark.parametrize(
    ("instance", "host"), [("h:9100", "h"), ("h", "h"), ("[::1]:9100", "::1"), ("::1", None), ("a:b:c", None), ("", "")]
)
def test_host_of(spark, instance, host):
    assert one(spark, text.host_of(V()), instance) == host


@pytest.mark.parametrize(("name", "snake"), [("ReplicaSet", "replica_set"), ("Pod", "pod"), ("True", "true"), ("StatefulSet", "stateful_set")])
def test_snake_case(spark, name, snake):
    assert one(spark, text.snake_case(V()), name) == snake


def test_states_round_trip(spark):
    for rank, name in enumerate(STATE_NAMES):
        assert one(spark, state_name(V()), rank) == name
        assert one(spark, state_rank(V()), name) == rank
    assert one(spark, state_rank(V()), "other") is None
