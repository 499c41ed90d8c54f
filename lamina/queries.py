"""One query per operator over the test tables, with the same in DuckDB SQL. Names starting with ext_ are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.expressions import entry_bytes, entry_crc
from lamina.functions.ordinals import shared_folder
from lamina.operators import bloom, merge, read, resolve, sparse_index, statistics
from lamina.plans.compaction import MOST_INPUTS, oldest
from lamina.schema import MUTATION, Options
from lamina.sources.log import valid_prefix
from lamina.sources.manifest import Run
from lamina.store import Store

QUERIES = {}
ORACLE_SQL = {}

#: Mutations from ``events``: users are keys, errors are deletes.
MUTATIONS_SQL = """m AS (
  SELECT 'user-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || CAST(event_id AS VARCHAR) END AS value,
    CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts, event_id AS seq, event_type = 'error' AS tombstone FROM events),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1),
l AS (SELECT * FROM n WHERE NOT tombstone)"""
ORDERS_SQL = "o AS (SELECT 'order-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderstatus AS value FROM orders)"
RUNS_SQL = """u AS (
  SELECT CAST(seq % 8 AS BIGINT) AS run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS rows, CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS bytes FROM m GROUP BY 1),
v AS (SELECT *, CAST(run_id // 3 AS INTEGER) AS level FROM u)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, column: str, width: int):
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        padded("user-", "user_id", 8).alias("key"),
        F.when(dead, "").otherwise(F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("value"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") * 1000).alias("ts"),
        F.col("event_id").alias("seq"), dead.alias("tombstone"),
    )


def order_entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(padded("order-", "o_orderkey", 10).alias("key"), F.col("o_orderstatus").alias("value"))


def asked_orders(spark, sf_dir) -> DataFrame:
    """Keys of which some are orders and some are not."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("order-"), F.lpad((F.col("c_custkey") * 17).cast("string"), 10, "0")).alias("key"))


ASKED_SQL = "a AS (SELECT 'order-' || lpad(CAST(c_custkey * 17 AS VARCHAR), 10, '0') AS key FROM customer)"


def catalog(spark, sf_dir) -> DataFrame:
    """A run catalog: events dealt into eight runs in three levels."""
    rows = mutations(spark, sf_dir)
    return rows.groupBy((F.col("seq") % 8).alias("run_id")).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("rows"), F.sum(entry_bytes()).alias("bytes")
    ).withColumn("level", F.floor(F.col("run_id") / 3).cast("int"))


def as_mutations(rows: DataFrame, ts: int, seq: int = 0) -> DataFrame:
    return rows.select("key", "value", F.lit(ts).cast("long").alias("ts"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("tombstone")).select(*MUTATION.names)


@query(f"WITH {MUTATIONS_SQL} SELECT * FROM l")
def live_view(spark, sf_dir):
    return resolve.live(mutations(spark, sf_dir))


@query(f"WITH {MUTATIONS_SQL} SELECT * FROM n")
def latest_any(spark, sf_dir):
    return resolve.newest(mutations(spark, sf_dir))


@query(f"WITH {MUTATIONS_SQL} SELECT key, value FROM l WHERE key = 'user-00000007'")
def point_get(spark, sf_dir):
    return read.get(mutations(spark, sf_dir), "user-00000007")


CUSTOMERS_SQL = "k AS (SELECT 'user-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)"


@query(f"WITH {MUTATIONS_SQL}, {CUSTOMERS_SQL} SELECT k.key, l.value, l.key IS NOT NULL AS found FROM k LEFT JOIN l ON k.key = l.key")
def multi_get(spark, sf_dir):
    return read.multi_get(mutations(spark, sf_dir), table(spark, sf_dir, "customer").select(padded("user-", "c_custkey", 8).alias("key")))


@query(f"WITH {ORDERS_SQL}, {ASKED_SQL} SELECT a.key FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.key = a.key)")
def missing_keys(spark, sf_dir):
    return read.missing(as_mutations(order_entries(spark, sf_dir), 1), asked_orders(spark, sf_dir))


@query(f"""WITH {ORDERS_SQL}, x AS (SELECT key, value, 1 AS ts FROM o UNION ALL
  SELECT 'order-' || lpad(CAST(o_orderkey * 3 AS VARCHAR), 10, '0'), 'new-' || o_orderpriority, 2 FROM orders)
SELECT key, value FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) = 1""")
def upsert_orders(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.lpad((F.col("o_orderkey") * 3).cast("string"), 10, "0")).alias("key"), F.concat(F.lit("new-"), "o_orderpriority").alias("value")
    )
    return resolve.upsert(as_mutations(order_entries(spark, sf_dir), 1), as_mutations(changes, 2)).select("key", "value")


@query("SELECT 'customer-' || CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer WHERE c_custkey % 5 <> 0")
def delete_keys(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), "c_custkey")
    gone = resolve.tombstones(customers.where("c_custkey % 5 = 0"), 2, 0)
    return resolve.upsert(as_mutations(customers, 1), gone).select("key", "value")


@query(f"""WITH {MUTATIONS_SQL}, x AS (SELECT key, value, ts, seq, tombstone, 0 AS later FROM m
  UNION ALL SELECT DISTINCT key, 'restored', NULL, NULL, false, 1 FROM m WHERE tombstone)
SELECT key, value FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY later DESC, ts DESC, seq DESC) = 1 AND NOT tombstone""")
def delete_then_put(spark, sf_dir):
    rows = mutations(spark, sf_dir)
    again = rows.where("tombstone").select("key", F.lit("restored").alias("value")).distinct()
    return resolve.upsert(rows, as_mutations(again, 1 << 62)).select("key", "value")


@query(f"""WITH {MUTATIONS_SQL}, b AS (SELECT key || '@' || CAST(ts // 3600000000000 AS VARCHAR) AS key, value, seq FROM m)
SELECT key, value, seq FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""")
def in_batch_last_wins(spark, sf_dir):
    """Requests of one batch share a time; the later one wins by its sequence number."""
    hour = F.expr("ts div 3600000000000")
    batch = mutations(spark, sf_dir).withColumn("key", F.concat("key", F.lit("@"), hour.cast("string"))).withColumn("ts", F.lit(0).cast("long"))
    return resolve.newest(batch).select("key", "value", "seq")


@query(f"WITH {MUTATIONS_SQL} SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS place FROM m")
def kway_merge(spark, sf_dir):
    rows = mutations(spark, sf_dir)
    return merge.merged_order(merge.union_all([rows.where(F.col("seq") % 8 == i) for i in range(8)]))


@query(f"WITH {MUTATIONS_SQL} SELECT * FROM l")
def bottom_gc(spark, sf_dir):
    return merge.merge(mutations(spark, sf_dir), bottom=True)


@query(f"WITH {MUTATIONS_SQL} SELECT * FROM n")
def keep_tombstones(spark, sf_dir):
    return merge.merge(mutations(spark, sf_dir))


@query(f"""WITH {ORDERS_SQL}, s AS (SELECT key, (sum(strlen(key) + strlen(value) + 16) OVER (ORDER BY key) - 1) // 65536 AS piece FROM o)
SELECT min(key) AS min_key, max(key) AS max_key, count(*) AS rows FROM s GROUP BY piece""")
def split_runs(spark, sf_dir):
    """Runs of 64 KiB."""
    pieces = merge.split(as_mutations(order_entries(spark, sf_dir), 1), 64 << 10)
    return sparse_index.bounds(pieces, "piece").select("min_key", "max_key", "rows")


@query(f"WITH {ORDERS_SQL} SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS ordinal FROM o")
def sorted_run_scan(spark, sf_dir):
    return read.sorted_run(order_entries(spark, sf_dir))


INDEX_SQL = "i AS (SELECT key, ordinal FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS ordinal FROM o) WHERE ordinal % 128 = 0)"


@query(f"WITH {ORDERS_SQL}, {INDEX_SQL} SELECT * FROM i")
def sparse_index_build(spark, sf_dir):
    return sparse_index.build(order_entries(spark, sf_dir))


@query(f"WITH {ORDERS_SQL}, {INDEX_SQL}, {ASKED_SQL} SELECT a.key, coalesce(i.ordinal, 0) AS ordinal FROM a ASOF LEFT JOIN i ON a.key >= i.key")
def sparse_floor_lookup(spark, sf_dir):
    return sparse_index.floor_lookup(sparse_index.build(order_entries(spark, sf_dir)), asked_orders(spark, sf_dir))


@query(f"WITH {MUTATIONS_SQL}, {RUNS_SQL} SELECT run_id, min_key, max_key, rows FROM u")
def run_bounds(spark, sf_dir):
    return sparse_index.bounds(mutations(spark, sf_dir).withColumn("run_id", F.col("seq") % 8), "run_id")


@query(f"WITH {MUTATIONS_SQL}, {RUNS_SQL} SELECT a.run_id AS left_run, b.run_id AS right_run FROM v a JOIN v b ON a.level = 0 AND b.level = 1 AND a.max_key >= b.min_key AND a.min_key <= b.max_key")
def overlapping_runs(spark, sf_dir):
    runs = catalog(spark, sf_dir)
    return statistics.overlapping_runs(runs.where("level = 0"), runs.where("level = 1"))


@query(f"""WITH {MUTATIONS_SQL}, {RUNS_SQL}, w AS (SELECT level, min_key, max(max_key) OVER (PARTITION BY level ORDER BY min_key, max_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v)
SELECT level, coalesce(max(b >= min_key), false) AS overlaps FROM w GROUP BY level""")
def level_overlap(spark, sf_dir):
    return statistics.level_overlap(catalog(spark, sf_dir))


@query(f"WITH {MUTATIONS_SQL}, {RUNS_SQL} SELECT run_id, min_key, max_key FROM v WHERE level = 0 ORDER BY run_id LIMIT (SELECT least(greatest(count(*) // 2, 1), {MOST_INPUTS}) FROM v WHERE level = 0)")
def compaction_inputs(spark, sf_dir):
    """The oldest half of level 0's runs, at most four: a limit that the operator has."""
    zero = [Run(r.level, r.run_id, "", r.min_key, r.max_key, r.rows, r.bytes) for r in catalog(spark, sf_dir).where("level = 0").collect()]  # a catalog's rows
    return spark.createDataFrame([(r.run_id, r.min_key, r.max_key) for r in oldest(zero)], "run_id long, min_key string, max_key string")


@query(f"WITH {MUTATIONS_SQL}, {RUNS_SQL} SELECT r.level, coalesce(count(v.run_id), 0) AS files, CAST(coalesce(sum(v.bytes), 0) AS BIGINT) AS bytes FROM (SELECT unnest(range(7)) AS level) r LEFT JOIN v ON v.level = r.level GROUP BY r.level")
def level_sizes(spark, sf_dir):
    return statistics.level_sizes(catalog(spark, sf_dir), 7)


@query("SELECT level, CAST(1048576 * pow(10, level) AS BIGINT) AS max_bytes FROM (SELECT unnest(range(7)) AS level)")
def level_limits(spark, sf_dir):
    return statistics.level_limits(spark, 7)


@query("SELECT doc_id, CAST(strlen(CAST(doc_id AS VARCHAR)) + strlen(coalesce(text, '')) + 16 AS BIGINT) AS bytes FROM documents")
def entry_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), "text").select("doc_id", entry_bytes("key", "text").alias("bytes"))


@query(f"""WITH {MUTATIONS_SQL}, s AS (SELECT CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS log_bytes FROM m),
f AS (SELECT CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS flush_bytes FROM n), c AS (SELECT CAST(sum(strlen(key) + strlen(value) + 16) AS BIGINT) AS compaction_bytes FROM l)
SELECT CASE WHEN log_bytes > 0 THEN CAST(flush_bytes + compaction_bytes AS DOUBLE) / CAST(log_bytes AS DOUBLE) ELSE 0 END AS write_amp FROM s, f, c""")
def write_amplification(spark, sf_dir):
    """All mutations logged, their newest flushed, and those merged into the bottom level."""
    rows = mutations(spark, sf_dir)
    total = lambda df, name: df.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias(name))
    merged = resolve.newest(rows).agg(F.sum(entry_bytes()).alias("flush_bytes"), F.coalesce(F.sum(F.when(~F.col("tombstone"), entry_bytes())), F.lit(0)).alias("compaction_bytes"))
    return statistics.write_amplification(total(rows, "log_bytes").join(F.broadcast(merged)))  # one row each


def _filter(spark, sf_dir):
    keys = asked_orders(spark, sf_dir)
    bits, hashes = bloom.parameters(keys.count())
    return bloom.build(keys, bits, hashes), bits, hashes


def _bits_sql(keys: str, column: str) -> str:
    """DuckDB SQL for (key, bit) with the sizes that a filter of ASKED_SQL's rows has."""
    fold = lambda start: f"list_reduce(list_prepend({start}::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda h, x: (xor(h, x) * 435) & 4294967295)"
    start = 14695981039346656037
    for b in b"LSM":
        start = (start ^ b) * 1099511628211 & (1 << 64) - 1
    return f"""{column} AS (SELECT DISTINCT key, (h1 + i * h2) & (bits - 1) AS bit FROM (
  SELECT key, {fold(14695981039346656037 & 0xFFFFFFFF)} AS h1, {fold(start & 0xFFFFFFFF)} AS h2 FROM (SELECT DISTINCT key FROM {keys})), p, unnest(range(hashes)) AS t(i))"""


BLOOM_SQL = f"""{ORDERS_SQL}, {ASKED_SQL}, c AS (SELECT greatest(count(*), 1) AS n FROM a),
q AS (SELECT n, CAST(greatest(64, pow(2, ceil(log2(n * 10)))) AS BIGINT) AS bits FROM c),
p AS (SELECT bits, CAST(greatest(1, ceil(ln(2) * bits / n)) AS BIGINT) AS hashes FROM q),
{_bits_sql("a", "fb")}, f AS (SELECT DISTINCT bit FROM fb)"""


@query(f"WITH {BLOOM_SQL} SELECT bit FROM f")
def bloom_bits(spark, sf_dir):
    return _filter(spark, sf_dir)[0]


@query(f"WITH {BLOOM_SQL}, {_bits_sql('o', 'ob')} SELECT ob.key, count(f.bit) = count(*) AS maybe FROM ob LEFT JOIN f ON ob.bit = f.bit GROUP BY ob.key")
def bloom_probe(spark, sf_dir):
    made, bits, hashes = _filter(spark, sf_dir)
    return bloom.may_contain(made, order_entries(spark, sf_dir), bits, hashes)


@query(f"""WITH {BLOOM_SQL}, {_bits_sql('o', 'ob')}, g AS (SELECT ob.key, count(f.bit) = count(*) AS maybe FROM ob LEFT JOIN f ON ob.bit = f.bit GROUP BY ob.key)
SELECT CAST(count_if(maybe AND a.key IS NULL) AS BIGINT) AS false_positives, CAST(count_if(NOT maybe AND a.key IS NOT NULL) AS BIGINT) AS false_negatives, CAST(count_if(NOT maybe) AS BIGINT) AS skips, CAST(count_if(maybe) AS BIGINT) AS opened
FROM g LEFT JOIN (SELECT DISTINCT key FROM a) a ON g.key = a.key""")
def bloom_skips(spark, sf_dir):
    made, bits, hashes = _filter(spark, sf_dir)
    probed = bloom.may_contain(made, order_entries(spark, sf_dir), bits, hashes)
    asked = asked_orders(spark, sf_dir).distinct().withColumn("added", F.lit(True))
    maybe, added = F.col("maybe"), F.col("added").isNotNull()
    return probed.join(asked, "key", "left").agg(
        F.count_if(maybe & ~added).alias("false_positives"), F.count_if(~maybe & added).alias("false_negatives"), F.count_if(~maybe).alias("skips"), F.count_if(maybe).alias("opened")
    )


@query("""WITH s AS (SELECT user_id % 4 AS part, count_if(event_type = 'view') AS skips, count_if(event_type <> 'view') AS opened FROM events GROUP BY 1)
SELECT round(coalesce(avg(CASE WHEN skips + opened > 0 THEN CAST(skips AS DOUBLE) / CAST(skips + opened AS DOUBLE) ELSE 0 END * 100), 90.0), 6) AS skip_rate FROM s""")
def mean_skip_rate(spark, sf_dir):
    """The mean over four sets of counters; rounded, as a sum of doubles depends on its order."""
    counters = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("part")).agg(F.count_if(F.col("event_type") == "view").alias("skips"), F.count_if(F.col("event_type") != "view").alias("opened"))
    return statistics.mean_skip_rate(statistics.skip_rate(counters)).select(F.round("skip_rate", 6).alias("skip_rate"))


@query("""WITH f AS (SELECT event_id // 1000 AS batch_id, count(*) AS n FROM events GROUP BY 1)
SELECT batch_id, n FROM f WHERE batch_id < coalesce((SELECT min(batch_id) FROM f WHERE batch_id % 7 = 6), 9223372036854775807)""")
def log_valid_prefix(spark, sf_dir):
    frames = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 1000").alias("batch_id")).agg(F.count("*").alias("n"))
    return valid_prefix(frames.withColumn("ok", F.col("batch_id") % 7 != 6)).select("batch_id", "n")


#: CRC-32 by its table of 256 remainders, over the bytes of the two texts behind their lengths.
@query("""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id || coalesce(CAST(strlen(text) AS VARCHAR), '-') || ':' || coalesce(text, ''))), '..'),
  lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM d, t""")
def entry_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", entry_crc("doc_id", "text").alias("crc"))


STORED_SQL = f"""WITH {ORDERS_SQL}, x AS (SELECT key, value, 1 AS ts FROM o UNION ALL
  SELECT 'order-' || lpad(CAST(o_orderkey * 3 AS VARCHAR), 10, '0'), 'new-' || o_orderpriority, 2 FROM orders),
g AS (SELECT 'order-' || lpad(CAST(c_custkey * 17 AS VARCHAR), 10, '0') AS key FROM customer)
SELECT key, value FROM x WHERE key NOT IN (SELECT key FROM g) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) = 1"""


def stored(spark, sf_dir) -> Store:
    """A table of orders, changed and in part deleted in three batches, of which two are in merged runs and the last is in the log."""
    store = Store(spark, shared_folder(spark, "store"), Options(num_levels=3, level0_runs=1, level_base=1 << 16, flush_bytes=1 << 40, run_bytes=1 << 18))
    store.put_batch(order_entries(spark, sf_dir))
    store.flush()
    store.put_batch(table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.lpad((F.col("o_orderkey") * 3).cast("string"), 10, "0")).alias("key"), F.concat(F.lit("new-"), "o_orderpriority").alias("value")))
    store.flush()
    store.delete_keys(asked_orders(spark, sf_dir))
    return store


@query(STORED_SQL)
def stored_table(spark, sf_dir):
    """What a table that was flushed and merged has when it is opened again: runs, and the log's tail."""
    store = stored(spark, sf_dir)
    return Store(spark, store.root, store.options).table()


@query(STORED_SQL)
def recovered_table(spark, sf_dir):
    """The same after the manifest was lost, from the runs and the log alone, flushed again."""
    store = stored(spark, sf_dir)
    store.manifest.files.delete(store.manifest.folder)
    again = Store(spark, store.root, store.options)
    again.flush()
    return again.table()


@query(f"""WITH {ORDERS_SQL}, {ASKED_SQL}, g AS (SELECT DISTINCT key FROM a)
SELECT key, '' AS value, true AS tombstone FROM g""")
def memtable_scan(spark, sf_dir):
    """What the log has and no run: the newest version of each key, tombstones included."""
    return stored(spark, sf_dir).memtable().select("key", "value", "tombstone")


@query(f"WITH {MUTATIONS_SQL} SELECT key, value FROM l WHERE key BETWEEN 'user-00000010' AND 'user-00000099'")
def ext_range_scan(spark, sf_dir):
    return read.scan(mutations(spark, sf_dir), "user-00000010", "user-00000099")


@query(f"""WITH {MUTATIONS_SQL}, b AS (SELECT * FROM m WHERE ts <= 1704844800000000000)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1 AND NOT tombstone""")
def ext_as_of(spark, sf_dir):
    return resolve.as_of(mutations(spark, sf_dir), 1704844800000000000)


@query(f"WITH {MUTATIONS_SQL} SELECT key, count(*) AS versions, CAST(count_if(tombstone) AS BIGINT) AS tombstones, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY key")
def ext_version_history(spark, sf_dir):
    return resolve.history(mutations(spark, sf_dir))
