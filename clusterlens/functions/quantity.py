"""Resource quantities, address ranges, bit masks and IEEE-style arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Quantity suffixes of the Kubernetes API and their factors.
SUFFIXES = {
    "n": Decimal("0.000000001"),
    "u": Decimal("0.000001"),
    "m": Decimal("0.001"),
    "": Decimal(1),
    "k": Decimal(10**3),
    "M": Decimal(10**6),
    "G": Decimal(10**9),
    "T": Decimal(10**12),
    "P": Decimal(10**15),
    "E": Decimal(10**18),
    "Ki": Decimal(2**10),
    "Mi": Decimal(2**20),
    "Gi": Decimal(2**30),
    "Ti": Decimal(2**40),
    "Pi": Decimal(2**50),
    "Ei": Decimal(2**60),
}

# Bits of the volume access modes.
ACCESS_MODES = {
    "ReadWriteOnce": 1,
    "ReadOnlyMany": 2,
    "ReadWriteMany": 4,
    "ReadWriteOncePod": 8,
}

_QUANTITY = r"^([+-]?[0-9]*\.?[0-9]*)(n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei|)$"
_WIDE = "decimal(38,9)"


def _thousandths(quantity: Column) -> Column:
    """Exact decimal value in thousandths; NULL if the text is no quantity."""
    number = F.regexp_extract(quantity, _QUANTITY, 1).try_cast(_WIDE)
    suffix = F.regexp_extract(quantity, _QUANTITY, 2)
    factors = F.expr(
        "map(" + ", ".join(f"'{n}', CAST({f * 1000:f} AS {_WIDE})" for n, f in SUFFIXES.items() if f * 1000 >= 1) + ")"
    )
    # Small suffixes divide: a product would lose its last digits to the precision limit.
    scaled = (
        F.when(suffix == "n", number / F.lit(Decimal(10**6)))
        .when(suffix == "u", number / F.lit(Decimal(10**3)))
        .otherwise(number * F.element_at(factors, suffix))
    )
    # 1e3 / 1E3: the decimal parser understands exponents.
    return F.when(quantity.rlike(_QUANTITY), scaled).otherwise(quantity.try_cast(_WIDE) * F.lit(1000))


def milli(quantity: Column) -> Column:
    """Quantity text in thousandths, rounded up."""
    return F.ceil(_thousandths(quantity)).try_cast("bigint")


def whole(quantity: Column) -> Column:
    """Quantity text in whole units, rounded up."""
    return F.ceil(_thousandths(quantity) / F.lit(1000)).try_cast("bigint")


def milli_or_null(quantity: Column) -> Column:
    """Thousandths; absent and zero quantities are NULL."""
    return F.nullif(milli(quantity), F.lit(0).cast("bigint"))


def usable_addresses(cidr: Column) -> Column:
    """Number of addresses of a range without its first and last one; 0 for no range.

    Ranges of 2^31 or more IPv4 addresses count as empty before the two are taken off,
    IPv6 ranges saturate, both as in the public range-size helper of Kubernetes.
    """
    bits = F.when(F.contains(cidr, F.lit(":")), 128).otherwise(32)
    host_bits = bits - F.regexp_extract(cidr, r"/([0-9]+)$", 1).try_cast("int")
    too_large = ((bits == 32) & (host_bits >= 31)) | (host_bits >= 127)
    power = F.call_function("shiftleft", F.lit(1).cast("bigint"), host_bits)
    size = F.when(too_large, F.lit(0).cast("bigint")).when(host_bits >= 63, F.lit(2**63 - 1)).otherwise(power)
    return F.when(F.coalesce(cidr, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(size - F.lit(2))


def mode_bit(mode: Column) -> Column:
    """Bit of one access mode; unknown modes have none."""
    bit = F.lit(0)
    for name, value in ACCESS_MODES.items():
        bit = F.when(mode == name, F.lit(value)).otherwise(bit)
    return bit


def mode_mask(modes: Column) -> Column:
    """Bit mask of a list of access modes; an empty mask is NULL."""
    mask = F.aggregate(modes, F.lit(0), lambda acc, mode: acc.bitwiseOR(mode_bit(mode)))
    return F.nullif(mask, F.lit(0)).cast("smallint")


def bit_has(mask: Column, flag: int) -> Column:
    return F.coalesce(mask, F.lit(0)).cast("int").bitwiseAND(F.lit(flag)) != 0


def bit_set(mask: Column, flag: int) -> Column:
    return _stored(F.coalesce(mask, F.lit(0)).cast("int").bitwiseOR(F.lit(flag)))


def bit_clear(mask: Column, flag: int) -> Column:
    return _stored(F.coalesce(mask, F.lit(0)).cast("int").bitwiseAND(F.lit(~flag)))


def bit_toggle(mask: Column, flag: int) -> Column:
    return _stored(F.coalesce(mask, F.lit(0)).cast("int").bitwiseXOR(F.lit(flag)))


def _stored(mask: Column) -> Column:
    return F.nullif(mask, F.lit(0)).cast("smallint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division whose undefined or infinite results are NULL instead of an error."""
    return F.try_divide(numerator, denominator)
