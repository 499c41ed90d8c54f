import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing, queries, sharding
from lamina.llm.common import words


def jump(key, shards):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < shards:
        b, key = j, key * sharding.LCG + 1 & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


KEYS = [0, 1, -1, 123456789, 2**63 - 1, -(2**63), *range(5000, 5200)]


@pytest.mark.parametrize("shards", [1, 2, 40, 97])
def test_jump_hash_equals_the_plain_algorithm(spark, shards):
    df = spark.createDataFrame([(k,) for k in KEYS], "doc_id long")
    for r in sharding.assign(df, shards).collect():
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, shards), jump(r.doc_id, shards + 1))
        assert r.grown_shard in (r.shard, shards)


def test_sharding_query(spark):
    rows = queries.QUERIES["op1_sharding"](spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(text)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_equals_sql(same):
    assert same(queries.QUERIES["op1_sharding"], queries.ORACLE_SQL["op1_sharding"]) == 1000


def test_sharding_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (7, None), (7, "a"), (7, "a")], "doc_id long, shard string")
    out = sharding.slots(sharding.assign(df, 3), ["doc_id", "shard"]).collect()
    assert len(out) == 5 and {type(r.shard) for r in out} == {int}  # a column of that name is replaced
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(3))
    assert sharding.slots(sharding.assign(df.limit(0), 3), ["doc_id"]).count() == 0
    assert sharding.assign(spark.createDataFrame([("a",), (None,)], "doc_id string"), 5).where("shard between 0 and 4").count() == 2
    with pytest.raises(ValueError):
        sharding.jump_hash("doc_id", 0)


def test_slots_of_a_row_that_is_repeated_often(spark):
    df = spark.createDataFrame([(None, "x")] * 3000 + [(i, "y") for i in range(3000)], "doc_id long, text string").repartition(7)
    rows = sharding.slots(sharding.assign(df, 4), ["doc_id"]).collect()
    taken = Counter((r.shard, r.slot) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 6000 and set(taken) == {(s, i) for s, n in sizes.items() for i in range(n)}
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(map(tuple, df.collect()))


def test_mixing_equals_sql(same):
    assert same(queries.QUERIES["op4_mixing"], queries.ORACLE_SQL["op4_mixing"]) == 1000


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        share = left / max(sum(weight[s] for s in order if s not in full), 1)
        over = {s for s in order if s not in full and weight[s] * share > limit * sizes[s] + 1e-9}
        if not over:
            return {s: limit * sizes[s] if s in full else weight[s] * share for s in order}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 500, None: 3}, {"x": 7}, {"a": 0, "b": 0}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_takes_what_it_aims_at(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "z").alias("source"), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("size"), F.lit(1).alias("copies")
    )
    once, again = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in once) == sorted((r.doc_id, r.copies) for r in again)
    taken, goal = Counter(), {}
    for r in once:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) < 300 for s in goal)


def test_mixing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "s", "a b", 2), (2, "s", "", 3), (3, "t", " \t ", 4)], "doc_id long, source string, text string, target int")
    sized = mixing.mix(df.withColumn("size", words("text")))
    assert {r.source: r.source_size for r in sized.collect()} == {None: 0, "s": 2, "t": 0}
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mixed(df).where("source is null").count() == 2
