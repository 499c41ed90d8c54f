"""Bloom filters as relations of set bits, and packed into words where they are small enough to send to every task."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.expressions import fnv32
from lamina.schema import BLOOM_BITS_PER_KEY


#: Bits of a filter that is packed at most: 8 MB.
MOST_PACKED = 1 << 26


def parameters(keys: int, bits_per_key: int = BLOOM_BITS_PER_KEY) -> tuple[int, int]:
    """Bits (a power of two, 64 at least) and hashes of a filter for ``keys`` keys."""
    keys = max(keys, 1)
    bits = max(64, 1 << (max(1, keys * bits_per_key) - 1).bit_length())
    if bits > 1 << 32:
        raise ValueError("a filter has 2^32 bits at most; cut the run")
    return bits, max(1, ceil(log(2) * bits / keys))


def _bits(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key`` and ``bit``, a row for each hash of each different key: h1 + i h2, from two hashes of which the low 32 bits are enough."""
    hashed = keys.select("key").distinct().select("key", fnv32("key").alias("h1"), fnv32("key", "LSM").alias("h2"))  # once a key, below the explode
    places = hashed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long"))).alias("i"))
    return places.select("key", (F.col("h1") + F.col("i") * F.col("h2")).bitwiseAND(F.lit(bits - 1)).alias("bit"))


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The set bits of a filter over a ``key`` column, each once. A null key sets none."""
    return _bits(keys.where("key IS NOT NULL"), bits, hashes).select("bit").distinct()


def words(filter_bits: DataFrame) -> DataFrame:
    """``at`` and ``word``: bit i of a filter is bit i % 64 of word i // 64. Words without any bit have no row."""
    return filter_bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("word"))


def _answers(words: DataFrame, probes: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Hold the bits of each different probe against words that every task has: a sixty-fourth of ``MOST_PACKED`` rows at most.

    The words are found by place, so a probe costs its hashes whatever the filter's size; keys are shuffled once, to be told apart.
    """
    held = words.select(F.col("at").alias("__at"), F.col("word").alias("__word"))
    found = _bits(probes, bits, hashes).join(F.broadcast(held), F.shiftright("bit", 6) == F.col("__at"), "left")
    has = F.call_function("shiftrightunsigned", F.col("__word"), F.pmod("bit", F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.groupBy("key").agg(F.bool_and(F.coalesce(has, F.lit(False))).alias("maybe"))


@dataclass(frozen=True)
class Packed:
    """A filter in one piece: bit i is bit i % 64 of word i // 64."""

    words: tuple[int, ...]
    hashes: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)

    @classmethod
    def of(cls, filter_bits: DataFrame, bits: int, hashes: int) -> Packed:
        """Pack a relation of set bits; a row for each word that has any reaches the driver, 8 MB in all at most."""
        if bits > MOST_PACKED:
            raise ValueError("the filter is too large to be packed")
        out = [0] * (bits // 64)
        for r in words(filter_bits).collect():
            out[r["at"]] = r["word"]
        return cls(tuple(out), hashes)

    @classmethod
    def wrap(cls, raw: bytes, hashes: int) -> Packed:
        """The filter of stored bits, eight a byte, lowest first; the number of bits is a power of two and 64 at least."""
        if len(raw) < 8 or len(raw) & (len(raw) - 1):
            raise ValueError("a filter has a power of two of bits, 64 at least")
        return cls(struct.unpack(f"<{len(raw) // 8}q", raw), hashes)

    def raw(self) -> bytes:
        return struct.pack(f"<{len(self.words)}q", *self.words)

    def probe(self, spark: SparkSession, probes: DataFrame) -> DataFrame:
        """As :func:`probe`, in one pass over the different probes."""
        held = spark.createDataFrame([(i, w) for i, w in enumerate(self.words) if w], "at long, word long")
        return _answers(held, probes, self.bits, self.hashes)


def may_contain(filter_bits: DataFrame, probes: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key`` and ``maybe`` for each different probe: a filter of up to ``MOST_PACKED`` bits is packed and sent to the tasks, a larger one joined."""
    if bits <= MOST_PACKED:
        return _answers(words(filter_bits), probes, bits, hashes)
    return probe(filter_bits, probes, bits, hashes)


def probe(filter_bits: DataFrame, probes: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key`` and ``maybe`` for each different probe: false means that the key was never added. A null key never is."""
    wanted = _bits(probes, bits, hashes)
    return wanted.join(filter_bits.withColumn("__set", F.lit(1)), "bit", "left").groupBy("key").agg((F.count("__set") == F.count("*")).alias("maybe"))
