"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import cut, table

#: Multiplier of the paper's generator.
LCG = 2862933555777941757
#: Parts of a shard that are numbered apart, so that no task sorts a whole shard.
SLOT_BUCKETS = 64


def _state(key: str, shards: int) -> str:
    """SQL for the struct (h, l, b, j) after the last jump of the long ``key``: b is its shard, j the next one it would reach.

    The generator's 64-bit state is two 32-bit halves, as a 64-bit product would overflow in ANSI mode. b rises
    with every jump, so ``shards`` steps are enough; steps after the last jump return the state as it is.
    """
    a1, a0, mask = LCG >> 32, LCG & 0xFFFFFFFF, 0xFFFFFFFF
    low_product = f"((s.l & 65535L) * {a0}L)"
    middle = f"(shiftright(s.l, 16) * {a0}L + shiftright({low_product}, 16))"
    low = f"((shiftleft({middle} & 65535L, 16) | ({low_product} & 65535L)) + 1L)"
    high = (  # h * a0 + l * a1 + carries, where all that counts is the remainder by 2^32
        f"((shiftleft((shiftright(s.h, 16) * {a0}L) & 65535L, 16) + (s.h & 65535L) * {a0}L"
        f" + shiftleft((shiftright(s.l, 16) * {a1}L) & 65535L, 16) + (s.l & 65535L) * {a1}L"
        f" + shiftright({middle}, 16) + shiftright({low}, 32)) & {mask}L)"
    )
    turned = f"named_struct('h', {high}, 'l', {low} & {mask}L, 'b', s.j, 'j', 0L)"
    jump = "cast(floor((t.b + 1) * (2147483648D / (shiftright(t.h, 1) + 1))) as bigint)"
    step = f"transform(array({turned}), t -> named_struct('h', t.h, 'l', t.l, 'b', t.b, 'j', {jump}))[0]"
    start = f"named_struct('h', shiftrightunsigned({key}, 32), 'l', {key} & {mask}L, 'b', -1L, 'j', 0L)"
    return f"aggregate(sequence(1, {shards}), {start}, (s, i) -> if(s.j >= {shards}L, s, {step}))"


def jump_hash(key: str, shards: int) -> Column:
    """Struct of ``shard``, 0 to ``shards`` - 1, and ``grown``, the shard when one more is appended.

    ``key`` is SQL for a long. Appending a shard moves a key only into the new one: its next jump lands there or
    beyond it.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    return F.expr(
        f"transform(array({_state(key, shards)}), s -> named_struct('shard', cast(s.b as int),"
        f" 'grown', cast(if(s.j = {shards}L, {shards}L, s.b) as int)))[0]"
    )


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``grown_shard`` to each row; the key and the shard count alone decide.

    A long key is the generator's seed itself; other types go through xxhash64. A null key counts as 0. Empty
    input gives no rows; repeated rows share a shard.
    """
    plain = isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    seed = f"coalesce(cast(`{key}` as bigint), 0L)" if plain else f"if(`{key}` is null, 0L, xxhash64(`{key}`))"
    return docs.withColumns({"shard": (at := jump_hash(seed, shards))["shard"], "grown_shard": at["grown"]})


def slots(rows: DataFrame, order: list[str], part: Column | None = None) -> DataFrame:
    """Add ``slot``, which numbers the rows of each ``shard`` from 0 without gaps, by ``order`` within each part of it.

    A shard is numbered in ``SLOT_BUCKETS`` parts by a hash of the ``order`` columns (or by ``part``, of at most as
    many values); the parts' offsets come from a table of shards x parts counts. What is ordered are counts of equal rows, one
    for each partition of the input that has some, and each is then written as often as it counts: so neither a large
    shard nor one row that is repeated very often is a task. Equal rows take their slots in any order, which no reader can
    tell apart. Columns of types that can't be grouped by aren't supported.
    """
    rows = rows.withColumns({"__part": F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)) if part is None else part, "__from": F.spark_partition_id()})
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    parts = rows.groupBy("shard", "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    rest = [c for c in rows.columns if c not in {"shard", "__part", *order}]
    within = Window.partitionBy("shard", "__part").orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, 0)
    ended = counts.withColumn("__end", F.sum("__n").over(within)).join(F.broadcast(offsets), ["shard", "__part"])  # at most shards x SLOT_BUCKETS rows
    first = F.col("__before") + F.col("__end") - F.col("__n")
    return ended.withColumn("slot", F.explode(F.sequence(first, first + F.col("__n") - 1))).drop("__part", "__from", "__n", "__end", "__before")


def op1_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in ``shards`` shards under law ``key``. The text is read once; what is shuffled has no text.

    A null text has no bytes and the CRC of an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    # a multiplicative hash, which other SQL engines can repeat
    low = F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)) * 1640531527
    part = F.shiftright((low + F.col("size") * 40503 + F.col("text_crc32")).bitwiseAND(F.lit(0xFFFFFFFF)), 33 - SLOT_BUCKETS.bit_length())
    rows = slots(cut(assign(slim, shards)), ["doc_id", "size", "text_crc32"], part)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 by its table of 256 remainders, and jump hashing by recursion on the unsigned state.
ORACLE_SQL = """
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS bytes FROM documents),
k AS (SELECT r, doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tbl),
j(r, key, b, j) AS (
  SELECT r, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT FROM k
  UNION ALL
  SELECT r, key, j, CAST(floor((j + 1) * (2147483648::DOUBLE / ((key // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT r, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key FROM j WHERE j < 40)),
s AS (SELECT r, CAST(b AS INTEGER) AS shard, CAST(CASE WHEN j = 40 THEN 40 ELSE b END AS INTEGER) AS grown_shard FROM j WHERE j >= 40)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (((coalesce(doc_id, 0) & 4294967295) * 1640531527 + size * 40503 + text_crc32) & 4294967295) >> 26, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM k JOIN s ON k.r = s.r
"""
