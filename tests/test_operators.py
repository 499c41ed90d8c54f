import pytest
from pyspark.sql import functions as F

from lamina.functions.expressions import fnv32
from lamina.functions.ordinals import with_ordinals
from lamina.operators import bloom, merge, read, resolve, sparse_index, statistics
from lamina.schema import MUTATION, RUN, Options


def rows(spark, *data):
    return spark.createDataFrame(list(data), MUTATION)


def pairs(df):
    return sorted(tuple(r) for r in df.select("key", "value").collect())


def test_newest_wins_by_time_then_arrival(spark):
    m = rows(spark, ("x", "old", 100, 1, False), ("x", "new", 200, 0, False), ("t", "a", 5, 1, False), ("t", "b", 5, 2, False), ("", "empty", 1, 1, False), ("e", "", 1, 1, False))
    assert pairs(resolve.live(m)) == [("", "empty"), ("e", ""), ("t", "b"), ("x", "new")]
    assert resolve.live(m.limit(0)).count() == 0


def test_delete_and_put_again(spark):
    m = rows(spark, ("k", "v", 100, 1, False), ("k", "", 200, 2, True))
    assert pairs(resolve.live(m)) == [] and pairs(resolve.newest(m)) == [("k", "")]
    assert pairs(resolve.live(m.unionByName(rows(spark, ("k", "restored", 300, 3, False))))) == [("k", "restored")]
    unknown = resolve.tombstones(spark.createDataFrame([("never",)], "key string"), 9, 9)
    assert pairs(resolve.upsert(m, unknown)) == []


def test_lookups(spark):
    m = rows(spark, ("a", "1", 1, 1, False), ("a", "2", 2, 2, False), ("é", "x", 1, 1, False), ("z", "", 1, 1, True))
    keys = spark.createDataFrame([("a",), ("z",), ("q",), ("a",), (None,)], "key string")
    assert pairs(read.get(m, "a")) == [("a", "2")] and read.get(m, "z").count() == 0
    got = sorted(((r.key, r.value, r.found) for r in read.multi_get(m, keys).collect()), key=str)
    assert got == sorted([("a", "2", True), ("a", "2", True), ("z", None, False), ("q", None, False), (None, None, False)], key=str)
    assert sorted(str(r.key) for r in read.missing(m, keys).collect()) == ["None", "q", "z"]
    assert [r.key for r in read.scan(m, "a", "é").collect()] == ["a", "é"]


@pytest.mark.parametrize("shuffled", [False, True])
def test_merge_of_many_runs(spark, shuffled):
    """Several versions in one level: position never decides."""
    runs = [rows(spark, ("k", f"v{i}", i, i, False), (f"only{i}", "x", i, i, i == 3)) for i in range(5)]
    out = merge.merge(runs[::-1] if shuffled else runs)
    assert ("k", "v4") in pairs(out) and out.count() == 6
    assert merge.merge(runs, bottom=True).count() == 5


def test_tombstones_go_only_at_the_bottom(spark):
    runs = [rows(spark, ("k", "v", 1, 1, False)), rows(spark, ("k", "", 2, 2, True))]
    assert merge.merge(runs, bottom=True).count() == 0
    assert [r.tombstone for r in merge.merge(runs).collect()] == [True]


def test_sparse_index(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("key"))
    index = sparse_index.build(keys)
    assert index.count() == 79
    probes = keys.sample(0.05, seed=1)
    for r in sparse_index.floor_lookup(index, probes).collect():
        assert r.ordinal == int(r.key[4:]) // 128 * 128
    exact = spark.createDataFrame([("key-00050", 500), ("key-00100", 1000)], "key string, ordinal long")
    asked = spark.createDataFrame([("key-00050",), ("key-00075",), ("key-00200",), ("key-00000",)], "key string")
    assert {r.key: r.ordinal for r in sparse_index.floor_lookup(exact, asked).collect()} == {"key-00050": 500, "key-00075": 500, "key-00200": 1000, "key-00000": 0}
    assert {r.ordinal for r in sparse_index.floor_lookup(exact.limit(0), asked).collect()} == {0}


def test_ordinals_follow_byte_order(spark):
    keys = ["", "a", "b", "é", "中", "😀", "Z", "z"]
    got = with_ordinals(spark.createDataFrame([(k,) for k in keys], "key string"), "key").orderBy("ordinal").collect()
    assert [r.key for r in got] == sorted(keys, key=str.encode) and [r.ordinal for r in got] == list(range(8))


def test_fnv(spark):
    def plain(data):
        h = 14695981039346656037
        for b in data:
            h = (h ^ b) * 1099511628211 & (1 << 64) - 1
        return h & 0xFFFFFFFF

    keys = ["", "a", "key-00000001", "é中😀", "\x00x"]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", fnv32("key").alias("h"), fnv32("key", "LSM").alias("g")).collect()
    assert all(r.h == plain(r.key.encode()) and r.g == plain(b"LSM" + r.key.encode()) for r in got)


def test_bloom_filter(spark):
    assert [bloom.parameters(n) for n in (100, 256, 1500, 5000, 10_000, 0)] == [(1024, 8), (4096, 12), (16384, 8), (65536, 10), (131072, 10), (64, 45)]
    keys = spark.range(1500).select(F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("key"))
    bits, hashes = bloom.parameters(1500)
    made = bloom.build(keys, bits, hashes)
    assert bloom.probe(made, keys, bits, hashes).where("not maybe").count() == 0
    others = spark.range(3000).select(F.concat(F.lit("other-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("key"))
    assert bloom.probe(made, others, bits, hashes).where("maybe").count() <= 150
    assert bloom.probe(made.limit(0), keys, bits, hashes).where("maybe").count() == 0


def test_statistics(spark):
    runs = spark.createDataFrame([(1, 1, "a", "a", "z", 9, 90), (1, 2, "b", "b", "c", 1, 10), (1, 3, "c", "d", "e", 1, 10), (2, 4, "d", "a", "b", 1, 5), (2, 5, "e", "c", "d", 1, 5)], RUN)
    # the third run meets the first, which is not its neighbour
    assert {r.level: r.overlaps for r in statistics.level_overlap(runs.where("run_id <> 2")).collect()} == {1: True, 2: False}
    assert [tuple(r) for r in statistics.level_sizes(runs, 4).orderBy("level").collect()] == [(0, 0, 0), (1, 3, 110), (2, 2, 10), (3, 0, 0)]
    none = spark.createDataFrame([(0, 0, 0, 0, 0)], "log_bytes long, flush_bytes long, compaction_bytes long, skips long, opened long")
    assert statistics.write_amplification(none).first()[0] == 0 and statistics.skip_rate(none).first()[0] == 0


def test_options():
    with pytest.raises(ValueError):
        Options(num_levels=1)


def test_merged_order_of_a_hot_key(spark):
    """A key with most versions lies in several stretches; places run on from one to the next."""
    rows = [("hot" if i % 4 else f"k{i % 12}", str(i), i // 2, i, False) for i in range(4000)] + [(None, "", 1, i, True) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many stretches as partitions
    try:
        got = merge.merged_order(spark.createDataFrame(rows, MUTATION).repartition(7)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, places = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3]), reverse=True):
        places[r[0]] = places.get(r[0], 0) + 1
        want.setdefault((r[0], places[r[0]]), (r[2], r[3]))
    assert {(r.key, r.place): (r.ts, r.seq) for r in got} == want and len(got) == len(rows)
    assert merge.merged_order(spark.createDataFrame([], MUTATION)).count() == 0


def test_packed_filters(spark):
    """No key is missed, few others pass, and stored bits give the same answers; the relation of bits agrees."""
    keys = spark.range(10_000).select(F.format_string("key-%08d", "id").alias("key"))
    others = spark.range(10_000).select(F.format_string("other-%08d", "id").alias("key"))
    bits, hashes = bloom.parameters(10_000)
    made = bloom.build(keys, bits, hashes)
    packed = bloom.Packed.of(made, bits, hashes)
    assert packed.probe(spark, keys).where("maybe").count() == 10_000
    assert packed.probe(spark, others).where("maybe").count() <= 500
    again = bloom.Packed.wrap(packed.raw(), hashes)
    assert again == packed and again.bits == bits
    some = others.limit(300).unionByName(keys.limit(300))
    assert sorted(map(tuple, bloom.probe(made, some, bits, hashes).collect())) == sorted(map(tuple, bloom.may_contain(made, some, bits, hashes).collect()))
    nulls = spark.createDataFrame([("key-00000001",), (None,), (None,)], "key string")
    assert bloom.build(nulls, bits, hashes).where("bit IS NULL").count() == 0
    assert all(dict(map(tuple, how(made, nulls, bits, hashes).collect())) == {"key-00000001": True, None: False} for how in (bloom.probe, bloom.may_contain))
    with pytest.raises(ValueError):
        bloom.Packed.wrap(b"\0" * 24, 3)
