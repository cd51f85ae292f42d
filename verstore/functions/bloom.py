"""Bloom filters as rows: a filter of any size is spread over tasks, and probing is a join."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verstore.functions.codec import fnv1a

#: Bits for each key, least bits of a filter, positions of a key at ten bits, and the most that a filter may ask for.
BITS_PER_KEY, LEAST_BITS, MOST_PROBES = 10, 64, 30


def probes_of(bits_per_key: int = BITS_PER_KEY) -> int:
    """Positions of a key: 0.69 of the bits for each key, 1 to 30."""
    return min(max(int(bits_per_key * 0.69), 1), MOST_PROBES)


def bits_of(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Bits of a filter of so many keys, in whole bytes."""
    return -(-max(keys * bits_per_key, LEAST_BITS) // 8) * 8


def positions(hashed: Column, bits: int, probes: int = probes_of()) -> Column:
    """The bit positions of a key by double hashing with the hash rotated by 17 as step, modulo 2^32."""
    step = F.shiftright(hashed, 17) + F.shiftleft(hashed.bitwiseAND(F.lit(2**17 - 1)), 15)
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: ((hashed + i * step) % F.lit(2**32)) % bits)


@dataclass
class Filter:
    """bits, positions of a key, and the positions that are set, as rows (position); None: the filter is lost."""

    bits: int
    probes: int
    set: DataFrame | None

    @property
    def usable(self) -> bool:
        return self.set is not None and self.bits > 0 and 1 <= self.probes <= MOST_PROBES


def build(keys: DataFrame, bits_per_key: int = BITS_PER_KEY) -> Filter:
    """The filter of the distinct values of `key`, ten bits each."""
    own = keys.select("key").distinct()
    bits, probes = bits_of(own.count(), bits_per_key), probes_of(bits_per_key)
    return Filter(bits, probes, own.select(F.explode(positions(fnv1a(F.col("key")), bits, probes)).alias("position")).distinct())


def may_contain(filter: Filter, asked: DataFrame) -> DataFrame:
    """key, maybe for each distinct key: false only if it was never added; a filter that is of no use says true."""
    keys = asked.select("key").distinct()
    if not filter.usable:
        return keys.withColumn("maybe", F.lit(True))
    spots = keys.select("key", F.explode(positions(fnv1a(F.col("key")), filter.bits, filter.probes)).alias("position"))
    hit = spots.join(filter.set.withColumn("on", F.lit(True)), "position", "left")
    return hit.groupBy("key").agg(F.min(F.coalesce("on", F.lit(False))).alias("maybe"))
