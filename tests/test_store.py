import random
import shutil

import pytest

from lamina.schema import MUTATION, Commit, Options
from lamina.sources.manifest import Conflict
from lamina.store import Store

SMALL = Options(num_levels=3, flush_bytes=200, run_bytes=400, level0_runs=2, level_base=50)


def state(store):
    return {r.key: r.value for r in store.table().collect()}


def test_put_get_delete_and_open_again(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    s.put_batch([("a", "1"), ("b", "2"), ("a", "3"), ("", "empty"), ("c", "")])
    s.delete("b")
    s.delete("never")
    s.put_batch([])
    want = {"a": "3", "": "empty", "c": ""}
    assert state(s) == want and s.get("b") is None and s.get("c") == "" and s.get("") == "empty"
    for _ in range(2):  # nothing is lost without a flush, however often the table is opened
        s = Store(spark, str(tmp_path), Options())
        assert state(s) == want
    s.flush()
    assert state(s) == want and state(Store(spark, str(tmp_path), Options())) == want


def test_random_operations_equal_a_dict(spark, tmp_path):
    rng, model, s = random.Random(5), {}, Store(spark, str(tmp_path), SMALL)
    for step in range(14):
        act = rng.random()
        if act < 0.6:
            batch = [(f"k{rng.randrange(12)}", f"v{step}-{i}") for i in range(6)]
            s.put_batch(batch)
            model.update(batch)
        elif act < 0.8:
            keys = [f"k{rng.randrange(14)}" for _ in range(3)]
            s.delete_keys(keys)
            for k in keys:
                model.pop(k, None)
        elif act < 0.9:
            s.flush()
        else:
            s = Store(spark, str(tmp_path), SMALL)
    assert state(s) == model
    stats = s.stats()
    assert stats["compaction_bytes"] > 0 and sum(stats["files_per_level"][1:]) > 0 and stats["write_amp"] > 1
    from lamina.operators.statistics import level_overlap

    assert not any(r.overlaps for r in level_overlap(s.catalog()).where("level > 0").collect())
    assert s.manifest.vacuum(s.snapshot, s.root, keep_versions=0) and state(s) == model  # what the last merge read


def test_tombstones_are_gone_from_the_last_level(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(num_levels=2, level0_runs=1, run_bytes=100))
    s.put_batch([(f"k{i}", "v") for i in range(5)])
    s.flush()
    s.delete_keys([f"k{i}" for i in range(5)])
    s.flush()
    from lamina.plans.compaction import from_zero

    while plan := from_zero(s.snapshot):
        s.compact(plan)
    assert s.mutations().count() == 0 and state(s) == {}


@pytest.mark.parametrize("harm", ["frame", "checksum", "data"])
def test_a_torn_or_wrong_batch_ends_the_log(spark, tmp_path, harm):
    s = Store(spark, str(tmp_path), Options())
    for i in range(5):
        s.put(f"k{i}", "v")
    frame = tmp_path / "log" / "b000000000002.json"
    if harm == "data":
        shutil.rmtree(tmp_path / "log" / "b000000000002")
    else:
        frame.write_text(frame.read_text().replace('"crc": ', '"crc": 1'))
        if harm == "frame":  # the file system does not notice
            (frame.parent / f".{frame.name}.crc").unlink()
    s = Store(spark, str(tmp_path), Options())
    assert set(state(s)) == {"k0", "k1"}
    s.put("next", "v")
    assert set(state(Store(spark, str(tmp_path), Options()))) == {"k0", "k1", "next"}


@pytest.mark.parametrize("stop", ["runs", "commit", "trim"])
def test_a_crash_in_a_flush_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch, stop):
    s = Store(spark, str(tmp_path), Options())
    s.put_batch([("a", "1"), ("b", "2")])

    def crash(*a, **b):
        raise KeyboardInterrupt

    target = {"runs": (s.manifest, "commit"), "commit": (s.log, "trim"), "trim": (s, "maintain")}[stop]
    monkeypatch.setattr(*target, crash)
    with pytest.raises(KeyboardInterrupt):
        s.flush()
    for _ in range(2):
        assert state(Store(spark, str(tmp_path), Options())) == {"a": "1", "b": "2"}


def test_two_writers_and_levels(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), Options()), Store(spark, str(tmp_path), Options())
    a.put("x", "1")
    a.flush()
    with pytest.raises(Conflict):
        b.manifest.commit(b.snapshot)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), Options(num_levels=3))


def test_without_a_log_and_from_a_table(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(use_log=False))
    df = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "key string, value string, place int")
    s.put_batch(df, order="place")
    assert state(s) == {"a": "new", "b": "x"}
    assert state(Store(spark, str(tmp_path), Options(use_log=False))) == {"a": "new", "b": "x"}
    assert s.get("a") == "new" and s.get("zz") is None and s.skips > 0
    asked = spark.createDataFrame([("a",), ("q",)], "key string")
    assert {(r.key, r.found) for r in s.multi_get(asked).collect()} == {("a", True), ("q", False)}
    assert [r.key for r in s.scan("a", "b").collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    from lamina.streaming.ingest import into_store, latest

    source = tmp_path / "in"
    for i, data in enumerate([[("a", "1", 1, 1, False), ("b", "2", 1, 2, False)], [("a", "late", 0, 3, False), ("b", "", 5, 4, True)], [("c", "3", 6, 5, False)]]):
        spark.createDataFrame(data, MUTATION).coalesce(1).write.parquet(str(source / f"p{i}"))
    read = lambda: spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    s = Store(spark, str(tmp_path / "table"), Options())
    for _ in range(2):  # the second run has nothing new
        into_store(read(), s, str(tmp_path / "check")).awaitTermination()
    assert state(s) == {"a": "1", "c": "3"}
    q = latest(read()).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    from lamina.operators.resolve import newest

    assert sorted((r.key, r.value, r.tombstone) for r in newest(spark.table("held")).collect()) == [("a", "1", False), ("b", "", True), ("c", "3", False)]


def test_group_commit(spark, tmp_path):
    options = Options(commit=Commit.GROUP, group=4)
    s = Store(spark, str(tmp_path), options)
    for i in range(6):
        s.put("k", f"v{i}")
    s.delete("gone")
    assert s.get("k") == "v5" and len(s.frames) == 1  # the first four are one batch
    assert Store(spark, str(tmp_path), options).get("k") == "v3"  # what a crash would leave
    s.close()
    assert Store(spark, str(tmp_path), options).get("k") == "v5" and len(s.frames) == 2


def test_a_lost_manifest_is_rebuilt_from_the_runs(spark, tmp_path):
    options = Options(num_levels=2, level0_runs=2, run_bytes=100)
    s = Store(spark, str(tmp_path), options)
    for i in range(4):
        s.put_batch([(f"k{j}", f"{i}-{j}") for j in range(5)])
        s.delete(f"k{i}")
        s.flush()
    s.put_batch([("k0", "in the log")])
    want, versions = state(s), sorted(map(tuple, s.catalog().select("rows").collect()))
    assert versions and not s.has_overlapping_levels()
    (tmp_path / "runs" / "l0-torn").mkdir()  # a run that was not whole
    shutil.rmtree(tmp_path / "manifest")
    s = Store(spark, str(tmp_path), options)
    assert state(s) == want
    s.put_batch([("k1", "later")])
    s.flush()
    s.maintain()
    assert state(s) == {**want, "k1": "later"} == state(Store(spark, str(tmp_path), options))
    shutil.rmtree(tmp_path / "manifest")
    with pytest.raises(ValueError):
        (tmp_path / "runs" / "l5-x").mkdir()
        (tmp_path / "runs" / "l5-x" / "_SUCCESS").touch()
        Store(spark, str(tmp_path), options)


def test_entries_of_a_run_come_in_order(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    s.put_batch([("b", "1"), ("a", "2"), ("c", "3")])
    s.delete("c")
    s.flush()
    assert [(r.key, r.tombstone) for r in s.entries(s.snapshot.runs[0])] == [("a", False), ("b", False), ("c", True)]


def test_a_log_without_its_first_batch_is_not_replayed(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    for i in range(4):
        s.put(f"k{i}", "v")
    for x in ("b000000000000.json", ".b000000000000.json.crc"):
        (tmp_path / "log" / x).unlink()
    s = Store(spark, str(tmp_path), Options())
    assert state(s) == {} and len(list((tmp_path / "lost").glob("*/b*"))) >= 7  # set aside, not deleted
    s.put("again", "v")
    assert state(Store(spark, str(tmp_path), Options())) == {"again": "v"}


def test_an_empty_table_is_no_batch_and_seq_counts_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    rows = spark.createDataFrame([(f"k{i}", str(i)) for i in range(8)], "key string, value string").repartition(8)
    s.put_batch(rows.limit(0))
    s.delete_keys(rows.limit(0).select("key"))
    assert s.frames == {} and not list((tmp_path / "log").glob("b*"))
    s.put_batch(rows)
    s.put_batch(spark.createDataFrame([("k0", "a", 1), ("k0", "c", 1), ("k0", "b", 1)], "key string, value string, ts long"))
    assert s._next_seq == 2
    s.put_batch(spark.createDataFrame([("t", "a"), ("t", "c"), ("t", "b")], "key string, value string").repartition(3))
    assert s.get("t") == "c" and s.get("k0") == "0"  # without an order the greatest value; a late row loses


def test_a_stream_batch_that_comes_again_is_not_appended(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    rows = lambda i: spark.createDataFrame([("a", str(i), i, i, False)], MUTATION)
    for i in (0, 0, 1, 1, 0):
        s._append(rows(i), ("in", i))
    assert len(s.frames) == 2 and s.stats()["log_bytes"] == 2 * (1 + 1 + 16)
    s = Store(spark, str(tmp_path), Options())
    s._append(rows(1), ("in", 1))
    s.flush()
    s._append(rows(1), ("in", 1))
    assert s.frames == {} and s.streams() == {"in": 1} == Store(spark, str(tmp_path), Options()).streams()
    s._append(rows(0), ("other", 0))
    assert len(s.frames) == 1


def test_a_changed_byte_of_a_run_is_an_error(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    s.put_batch([(f"k{i:03d}", f"value {i}") for i in range(200)])
    s.flush()
    path = tmp_path / "runs" / s.snapshot.runs[0].path
    (path.parent / f".{path.name}.crc").unlink()  # so that the file system does not notice
    data = bytearray(path.read_bytes())
    import pyarrow.parquet as pq

    column = pq.ParquetFile(path).metadata.row_group(0).column(1)
    data[column.data_page_offset + column.total_compressed_size // 2] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc|FAILED_READ_FILE"):
        state(s)


def test_commit_by_time_and_the_memtable(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(commit=Commit.PERIOD, seconds=3600))
    s.put("b", "1")
    s.put("a", "22")
    s.delete("b")
    assert s.frames == {} and [(r.key, r.tombstone) for r in s.memtable().collect()] == [("a", False), ("b", True)]
    assert s.memtable_size() == (2, 1 + 2 + 16 + 1 + 16)
    s.synced -= 3601
    s.put("c", "3")
    assert len(s.frames) == 1 and Store(spark, str(tmp_path), Options()).get("c") == "3"
    s.flush()
    assert s.memtable().count() == 0 and s.memtable_size() == (0, 0)


def test_a_level_gives_a_stretch_of_its_runs():
    from lamina.plans.compaction import next_merge
    from lamina.sources.manifest import Run, Snapshot

    one = tuple(Run(1, i, f"a/{i}", f"k{i}0", f"k{i}9", 1, 100) for i in (3, 1, 2, 0))
    two = tuple(Run(2, 10 + i, f"b/{i}", f"k{i}0", f"k{i}9", 1, 100) for i in range(4))
    plan = next_merge(Snapshot(num_levels=4, runs=one + two), Options(num_levels=4, level_base=25))
    assert plan.level == 2 and not plan.bottom and {r.run_id for r in plan.inputs} == {0, 1, 10, 11}


def test_a_log_that_was_trimmed_begins_after_the_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options())
    s.put("a", "1")
    s.flush()
    s.put("b", "2")
    s.put("c", "3")
    shutil.rmtree(tmp_path / "manifest")
    assert state(Store(spark, str(tmp_path), Options())) == {"a": "1", "b": "2", "c": "3"}
    (tmp_path / "log" / "b000000000001.json").unlink()  # after the recovery the manifest knows where the log begins
    assert state(Store(spark, str(tmp_path), Options())) == {"a": "1"}


def test_filters_spare_runs_of_point_reads(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), Options(level0_runs=8, flush_bytes=1 << 40))
    keys = [f"k{i:05d}" for i in range(3000)]
    for part in range(3):  # three runs over the same range, each with a third of the keys
        s.put_batch([(k, f"v{k}") for k in keys[part::3]])
        s.flush()
    assert all(f is not None and f.getBitsetSize() <= 4096 for r in s.snapshot.runs for f in s.filters.of(r))  # sized for the keys
    assert all(s.snapshot.runs[i % 3] in s.may_contain(k) for i, k in enumerate(keys[:300]))
    among = keys[300:600]
    assert sum(len(s.may_contain(k)) for k in among) <= len(among) * 1.1
    s.skips = s.opened = 0
    assert s.get(keys[0]) == "vk00000" and s.get("k00000x") is None and s.get("z") is None
    assert s.skips + s.opened == 9 and s.opened <= 3 and s.stats()["skip_rate"] == 100 * s.skips / 9
    with monkeypatch.context() as m:  # a miss that the filters answer needs no job
        m.setattr("lamina.operators.read.get", None)
        m.setattr(s.filters, "may_contain", lambda runs, key: [])
        assert s.get("k00000y") is None
    monkeypatch.setattr("lamina.sources.filters.MOST_HELD", 1)
    s = Store(spark, str(tmp_path), s.options)
    assert s.get(keys[1]) == "vk00001" and s.get(keys[2]) == "vk00002" and len(s.filters.held) == 1
    s.delete(keys[0])
    s.put("new", "1")
    assert s.get(keys[0]) is None and s.get("new") == "1"


def test_runs_that_share_no_keys_are_moved_and_not_written():
    from lamina.plans.compaction import Merge, parts
    from lamina.sources.manifest import Run

    run = lambda level, i, low, high, size=100, dead=0: Run(level, i, f"f/{level}{i}", low, high, 1, size, dead)
    split = lambda *runs, bottom=False: tuple({r.run_id for r in x} for x in parts(Merge(runs, 1, bottom), 100))
    assert split(run(0, 1, "a", "b"), run(0, 2, "c", "d"), run(1, 3, "e", "f")) == (set(), {1, 2, 3})
    assert split(run(0, 1, "a", "c"), run(1, 2, "c", "d"), run(0, 3, "e", "f")) == ({1, 2}, {3})
    assert split(run(0, 1, "a", "z"), run(1, 2, "c", "d"), run(1, 3, "e", "f"), run(0, 4, "zz", "zzz")) == ({1, 2, 3}, {4})
    # what is merged can be cut anywhere, so nothing that lies between is left out
    assert split(run(0, 1, "a", "c"), run(0, 2, "b", "c"), run(0, 3, "e", "f"), run(0, 4, "h", "i"), run(1, 5, "i", "j")) == ({1, 2, 3, 4, 5}, set())
    assert split(run(0, 1, "a", "c", 10), run(0, 2, "d", "e", 10), run(0, 3, "f", "g")) == ({1, 2}, {3})  # small ones grow
    assert split(run(0, 1, "a", "c", 10), run(0, 2, "d", "e")) == (set(), {1, 2})
    assert split(run(0, 1, "a", "c", 100, 1), run(0, 2, "d", "e"), bottom=True) == ({1}, {2})  # tombstones go in the bottom level
    assert split(run(0, 1, "a", "c", 100, None), run(0, 2, "d", "e"), bottom=True) == ({1}, {2})  # not counted
    assert split(run(0, 1, "a", "c", 100, 1), run(0, 2, "d", "e")) == (set(), {1, 2})


@pytest.mark.parametrize("seed,num_levels", [(1, 2), (2, 4)])
def test_moved_runs_survive_vacuum_and_a_lost_manifest(spark, tmp_path, seed, num_levels):
    rng, model = random.Random(seed), {}
    options = Options(num_levels=num_levels, flush_bytes=1 << 30, run_bytes=110, level0_runs=2, level_base=150)
    s = Store(spark, str(tmp_path), options)
    moved = 0
    for step in range(8):
        at = rng.randrange(4) * 10  # ranges that come again, so that some runs share keys and some don't
        batch = [(f"k{at + i:03d}", f"v{step}-{i}") for i in range(10)]
        s.put_batch(batch)
        model.update(batch)
        if step % 2:
            gone = [f"k{rng.randrange(40):03d}" for _ in range(4)]
            s.delete_keys(gone)
            for k in gone:
                model.pop(k, None)
        s.flush()
        moved += sum(c.get("moved", 0) for c in s.snapshot.compactions)
        if step in (3, 6):
            s.manifest.vacuum(s.snapshot, s.root, keep_versions=0)
            named = {r.path for r in s.snapshot.runs}
            assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "runs").glob("*/part-*")} == named
            if step == 6:
                s.put_batch([("k000", "after")])
                model["k000"] = "after"
                s.flush()
            shutil.rmtree(tmp_path / "manifest")
            s = Store(spark, str(tmp_path), options)
        assert state(s) == model
    assert moved and not s.has_overlapping_levels()
    assert s.vacuum(grace=3600) == [] and state(s) == model


def test_rows_in_order_are_written_once(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(num_levels=4, flush_bytes=1 << 30, run_bytes=2000, level0_runs=2, level_base=3000))
    for part in range(3):
        s.put_batch([(f"k{i:05d}", "v") for i in range(part * 300, part * 300 + 300)])
        s.flush()
    stats = s.stats()
    assert sum(stats["files_per_level"][1:]) and stats["compaction_bytes"] <= stats["flush_bytes"] / 4 and len(state(s)) == 900
    assert s.get("k00450") == "v" and not s.has_overlapping_levels()


def test_a_rebuilt_table_is_merged_at_once(spark, tmp_path):
    options = Options(num_levels=3, level0_runs=1, level_base=1, flush_bytes=1 << 30, run_bytes=500)
    s, model = Store(spark, str(tmp_path), options), {}
    for step in range(4):
        batch = {f"k{i * (step + 1) % 97:03d}": f"v{step}-{i}" for i in range(60)}
        s.put_batch(list(batch.items()))
        s.delete_keys([f"k{step:03d}", f"k{step * 7:03d}"])
        model = {k: v for k, v in (model | batch).items() if k not in (f"k{step:03d}", f"k{step * 7:03d}")}
        s.flush()
        assert {r.level for r in s.snapshot.runs} == {2}  # past the level that has no room
    s.delete("k050")
    model.pop("k050", None)
    shutil.rmtree(tmp_path / "manifest")
    again = Store(spark, str(tmp_path), options)
    before = len({r.path.split("/")[0] for r in again.snapshot.runs})
    again.flush()
    assert before > 4 and len(again.snapshot.compactions) == 1 and {r.level for r in again.snapshot.runs} == {2}
    assert not again.has_overlapping_levels() and again.mutations().where("tombstone").count() == 0
    assert state(again) == model == state(Store(spark, str(tmp_path), options))


def test_files_of_a_write_do_not_follow_the_tables_size():
    from lamina.sources.runs import LARGE_RUN, pieces_of

    assert [pieces_of(n, 100) for n in (0, 1, 100, 101, 6400)] == [1, 1, 1, 2, 64]
    assert pieces_of(6401, 100) == pieces_of(1 << 30, 100) == 64  # more bytes, not more files
    assert pieces_of(LARGE_RUN * 1000, 100) == 1000 and pieces_of(1 << 40, 1 << 35) == 32


def test_merges_and_whole_levels_shuffle_no_key_twice(spark, tmp_path, monkeypatch):
    from lamina.operators import resolve

    s = Store(spark, str(tmp_path), Options(num_levels=2, level0_runs=1, flush_bytes=1 << 30, run_bytes=300))
    plans, reduced = [], resolve.newest
    monkeypatch.setattr("lamina.operators.merge.newest", lambda rows: (plans.append((out := reduced(rows))._jdf.queryExecution().executedPlan().toString()), out)[1])
    for step in range(2):
        s.put_batch([(f"k{i:03d}", f"v{step}") for i in range(step * 3, 40)])
        s.flush()
    assert plans and all(p.count("Exchange") == 1 and "rangepartitioning" in p for p in plans)
    assert "Exchange" not in s.table()._jdf.queryExecution().executedPlan().toString()
    assert state(s) == {f"k{i:03d}": f"v{int(i > 2)}" for i in range(40)}
    s.put("k000", "new")
    assert state(s)["k000"] == "new" and len(state(s)) == 40


def test_bounds_come_from_the_rows_places(spark, tmp_path):
    from pyspark.sql import functions as F

    from lamina.sources import runs

    keys = ["", "a", "\u00e9", "\U0001f600", "z" * 5000, None, None]
    rows = spark.createDataFrame([(k, "v", i, i, i % 3 == 0) for i, k in enumerate(keys)], MUTATION)
    made = runs.write(rows, str(tmp_path), 0, 0, 1 << 20, 1, 7)
    assert [(r.min_key, r.max_key, r.rows, r.tombstones) for r in made] == [("", "\U0001f600", 7, 3)]
    runs.write(spark.createDataFrame([(f"k{i}", "v", i, i, False) for i in range(500)], MUTATION), str(tmp_path), 0, 0, 100, 1000, 500)
    found = runs.described(spark, [f"{tmp_path}/runs/{n.name}" for n in (tmp_path / "runs").iterdir()])
    want = {}
    for r in runs.verified(spark).parquet(f"{tmp_path}/runs/*").withColumn("file", F.input_file_name()).collect():
        want.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    assert len(found) == len(want) > 5
    for f in found:
        rows = want[f["file"].rsplit("/", 1)[1]]
        known = [r.key.encode() for r in rows if r.key is not None]
        assert (f["low"].encode(), f["high"].encode(), f["n"], f["first_seq"]) == (min(known), max(known), len(rows), min(r.seq for r in rows))
