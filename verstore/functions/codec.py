"""Key, hash and filter functions as Spark expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest sequence number, kinds of entries, states of a lookup, FNV-1a's offset and prime.
MAX_SEQ = 72057594037927935
PUT, DELETE = 0, 1
FOUND, DELETED, MISSING = 0, 1, 2
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def checked(key: Column, seq: Column, kind: Column, on: bool = True) -> Column:
    """key, or an error where key, seq or kind is not allowed; off, key as it is."""
    if not on:
        return key
    bad = F.when(key.isNull() | (F.octet_length(key) == 0), "empty key").when((seq < 0) | (seq > MAX_SEQ), "sequence number out of range").when(~kind.isin(PUT, DELETE), "unknown kind")
    return F.when(bad.isNull(), key).otherwise(F.raise_error(F.coalesce(bad, F.lit("null sequence number or kind"))).cast("string"))


def swapped(hexes: Column) -> Column:
    """16 hex digits with the order of their bytes reversed."""
    return F.concat(*[F.substring(hexes, 15 - 2 * i, 2) for i in range(8)])


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """Hex of the key followed by seq * 256 + kind in eight little-endian bytes."""
    return F.concat(F.hex(key), swapped(F.lpad(F.hex(F.shiftleft(seq, 8) + kind), 16, "0")))


def user_key(internal: Column) -> Column:
    """The key of an internal key in hex; an error where that is shorter than its trailer."""
    own = F.unhex(F.left(internal, F.length(internal) - 16)).cast("string")
    return F.when(F.length(internal) >= 16, own).otherwise(F.raise_error(F.lit("internal key too short")).cast("string"))


def trailer(internal: Column) -> tuple[Column, Column]:
    """seq and kind of an internal key in hex."""
    digits = swapped(F.right(internal, F.lit(16)))
    return F.conv(F.left(digits, F.lit(14)), 16, 10).cast("long"), F.conv(F.right(digits, F.lit(2)), 16, 10).cast("int")


def kind_name(kind: Column) -> Column:
    return F.when(kind == PUT, "put").when(kind == DELETE, "delete").otherwise("unknown")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a string's bytes, as a long."""
    digits = F.hex(text)
    steps = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(steps, F.lit(FNV_OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32).cast("long")))


def uvarint_size(value: Column) -> Column:
    """Bytes of value in base-128 groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7).cast("int"))


def entry_size(key: Column, value: Column) -> Column:
    """Bytes that an entry counts for: key, trailer and value."""
    return (F.octet_length(key) + 8 + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def file_name(number: Column, suffix: str) -> Column:
    return F.concat(F.format_string("%09d", number), F.lit(f".{suffix}"))


def file_number(name: Column) -> Column:
    """The number of a file name of nine digits, a dot and three more characters; an error for others."""
    own = F.regexp_extract(name, r"^([0-9]{9})\..{3}$", 1)
    return F.when(own != "", own.cast("long")).otherwise(F.raise_error(F.concat(F.lit("unknown file name "), F.coalesce(name, F.lit("null")))).cast("long"))
