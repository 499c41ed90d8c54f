"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import cut, known, table, words

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = 42
#: Expected copies are counted in units of 2^-32.
UNIT = 1 << 32
#: Parts that a source's size classes are numbered in; a power of two.
PARTS = 512


def part_of(id_col: str, kind: T.DataType) -> Column:
    """A part from a hash of the id: a multiplicative one for integers, which other SQL engines can repeat."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        low = F.col(id_col).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        part = F.shiftright((low * 1640531527).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - PARTS.bit_length() + 1)
    else:
        part = F.pmod(F.xxhash64(id_col), F.lit(PARTS))
    return F.coalesce(part, F.lit(0)).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, weigh ``weights``, repeating. They share the sum of all sizes by weight; a
    target stops at ``limit`` times its source's size and the excess is reshared by weight. That fixed point is
    found at once: in order of limit over weight, the sources before some place are at their limit, and the rest
    share what is left. The windows hold one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("__rank", rank).withColumn(
        "__weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    order = Window.orderBy(F.col("source_size") / F.col("__weight"), "__rank")
    left = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - limit * F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = left / F.sum("__weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("__share", share).withColumn("__open", F.col("__share") * F.col("__weight") <= limit * F.col("source_size"))
    # the first source that is under its limit sets the level for all after it
    first = F.min(F.when(F.col("__open"), F.struct(F.col("source_size") / F.col("__weight"), "__rank", "__share"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = level.withColumn("__level", first["__share"])
    return level.withColumn(
        "target", F.least(F.coalesce(F.col("__level") * F.col("__weight"), F.lit(float("inf"))), (limit * F.col("source_size")).cast("double"))
    ).drop("__weight", "__share", "__open", "__level")


def _start(seed: int):
    """One random offset in units for each source, from a hash of its name."""
    name = F.concat(F.lit(f"{seed}:"), known("source"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def _product(a: Column, b: Column) -> Column:
    """a * b modulo 2^32, by halves, as the whole product of two longs can overflow."""
    low = a.bitwiseAND(F.lit(UNIT - 1))
    high = F.shiftright(b, 16).bitwiseAND(F.lit(0xFFFF)) * low
    return F.pmod(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + b.bitwiseAND(F.lit(0xFFFF)) * low, F.lit(UNIT))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows of ``doc_id``, ``source``, ``size`` and any other columns.

    A document's expected copies are its source's target over its size. Within each source, documents stand in
    order of size; their expected copies are prefix-summed, one random offset is added, and a document is
    emitted once per integer boundary its interval crosses. In order of size, a source's taken words miss its
    target by no more than about its longest document, and no document has more than ``limit`` copies. Reruns agree.

    The prefix sums are exact integers and they are split: a source's classes are a sixteenth of an octave of
    size, each in ``PARTS`` parts by a hash of doc_id, so no task orders a hot source or a group of copies; a
    table of their counts gives each part's offset. Rows are shuffled once. A null source is a source of its own,
    a null size counts as 0, a source without words keeps each document once. Rows with equal size and doc_id are
    alike to the sampling. Columns named ``source_size``, ``target`` or ``copies`` are replaced.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    place = ["__source", "__class", "__part"]
    rows = docs.drop("source_size", "target", "copies").withColumns(
        {"__source": known("source"), "__class": F.floor(F.log2(size + 1) * 16).cast("int"), "__part": part_of("doc_id", docs.schema["doc_id"].dataType), "__size": size}
    )
    counts = rows.groupBy(*place, "source").agg(F.count("*").alias("__n"), F.sum("__size").alias("__words"))
    by_source = counts.groupBy("source").agg(F.sum("__words").alias("source_size"))
    goals = targets(by_source, weights, limit).withColumn("__start", _start(seed)).withColumn(
        "__each", F.when(F.col("source_size") == 0, F.lit(UNIT)).otherwise(F.floor(F.col("target") * UNIT / F.col("source_size")))
    ).select(known("source").alias("__source"), "source_size", "target", "__start", F.col("__each").cast("long"))
    # rows ahead: first over a source's classes, of which there are a few hundred, then over a class's parts
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy("__source", "__class").agg(F.sum("__n").alias("__n")).withColumn("__ahead", ahead).drop("__n").join(goals, "__source")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__source", "__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = counts.withColumn("__before", before).join(classes, ["__source", "__class"]).select(
        *place, "source_size", "target", "__each", F.pmod(_product(F.col("__each"), F.col("__before") + F.col("__ahead")) + F.col("__start"), F.lit(UNIT)).alias("__offset")
    )
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*place).orderBy("__size", "doc_id")))
    end = F.col("__offset") + F.col("__each") * F.col("__rank")
    return (
        ranked.join(plan, place)
        .withColumn("copies", (F.shiftright(end, 32) - F.shiftright(end - F.col("__each"), 32)).cast("int"))
        .drop(*place, "__size", "__rank", "__offset", "__each")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id``, ``source`` and ``text``), each as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "source", words("text").alias("size"))
    return mix(rows).select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("__row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes from each. The text is read once; what is shuffled has no text."""
    slim = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("size")))
    return mix(slim).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - 3 * coalesce(CAST(sum(source_size) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS share FROM w),
t AS (
  SELECT *, least((SELECT share FROM l WHERE share * weight <= 3 * source_size ORDER BY source_size / weight, rk LIMIT 1) * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size = 0 THEN {UNIT} ELSE CAST(floor(target * {UNIT} / source_size) AS BIGINT) END AS each,
    CAST('0x' || substr(md5('{SEED}:' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END), 1, 8) AS BIGINT) AS start FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.each, e.start
    + e.each * row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(d.size + 1) * 16), coalesce((((doc_id & 4294967295) * 1640531527) & 4294967295) >> {33 - PARTS.bit_length()}, 0), d.size, d.doc_id NULLS FIRST) AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * ((place >> 32) - ((place - each) >> 32)) AS BIGINT) AS taken FROM p
"""
