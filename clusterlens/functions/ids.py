"""Deterministic identifiers, built from JVM-side hash functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: name space of all identifiers derived from non-UUID object uids.
OBJECT_NAMESPACE = "3f249403-2bb0-428f-8e91-504d1fd7ddb6"

_DASHED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_UUID = rf"(?i)^(?:(?:urn:uuid:)?{_DASHED}|\{{{_DASHED}\}}|[0-9a-f]{{32}})$"


def _dashed(digits: Column) -> Column:
    """32 hex digits -> 8-4-4-4-12.

    One expression over ``digits``, so that it is evaluated once: expressions inside the
    branches of a condition are not shared.
    """
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid5(space: Column, data: Column) -> Column:
    """RFC 4122 version 5 identifier of ``data`` inside the name space ``space``."""
    digest = F.sha1(F.concat(F.unhex(F.translate(space, "-", "")), F.encode(data, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return _dashed(
        F.concat(
            F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)
        )
    )


def ensure_uuid(uid: Column) -> Column:
    """The uid itself if it is a UUID (lower case, dashed), else a UUID derived from it."""
    uid = F.coalesce(uid, F.lit(""))
    digits = F.translate(F.regexp_replace(F.lower(uid), "^urn:uuid:", ""), "{}-", "")
    return F.when(uid.rlike(_UUID), _dashed(digits)).otherwise(uuid5(F.lit(OBJECT_NAMESPACE), uid))


def pair_uuid(owner: Column, name: Column, value: Column) -> Column:
    """Identifier of a label, annotation or selector entry of one object.

    Built from the lower-cased text, so entries that differ only by case collide on purpose.
    """
    return uuid5(owner, F.lower(F.concat(name, F.lit(":"), value)))
