"""Keyed stores and streams: several instalments, stopped and repeated runs, single files and folders."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from compare import comparable, duck
from pyspark.sql import functions as F

from casewright.plans import registry
from casewright.session import table
from casewright.sources.keyed import Conflict, KeyedStore
from casewright.streaming import streams

STREAMS = ["stream_latest_attempt", "stream_dedup", "stream_breaker", "stream_case_states", "stream_rounds"]


def rows_of(store):
    return sorted(map(tuple, store.read().collect()))


def made(spark, root, **how):
    return KeyedStore(spark, str(root), ["k"], "k long, v string", buckets=how.pop("buckets", 4), **how)


# The store


def test_the_first_writer_wins_and_versions_stay(spark, tmp_path):
    store = made(spark, tmp_path)
    assert rows_of(store) == [] and store.versions() == []
    assert store.insert_first(spark.createDataFrame([(k, f"a{k}") for k in range(20)], "k long, v string")) == 1
    other = made(spark, tmp_path)  # a second writer, after the first
    assert other.insert_first(spark.createDataFrame([(3, "late"), (40, "b"), (40, "c")], "k long, v string"), "v") == 2
    assert rows_of(store) == [(k, f"a{k}") for k in range(20)] + [(40, "b")]
    assert sorted(map(tuple, store.read(1).collect())) == [(k, f"a{k}") for k in range(20)]


def test_of_two_writers_from_one_version_the_second_fails(spark, tmp_path):
    store, other = made(spark, tmp_path), made(spark, tmp_path)
    row = spark.createDataFrame([(1, "x")], "k long, v string")

    def between(both):
        other.insert_first(spark.createDataFrame([(1, "other")], "k long, v string"))
        return store._one(both, F.min_by, F.col("_old"))

    with pytest.raises(Conflict):
        store.merge(row, between)
    assert rows_of(store) == [(1, "other")]


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    store = made(spark, tmp_path, buckets=8)
    store.insert_first(spark.createDataFrame([(k, "a") for k in range(200)], "k long, v string"))
    before = store._state()[1]["buckets"]
    store.evict(spark.createDataFrame([(7,), (7,), (999,)], "k long"))
    after = store._state()[1]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) in (1, 2)
    assert [k for k, _ in rows_of(store)] == [k for k in range(200) if k != 7]
    store.upsert_latest(spark.createDataFrame([(5, "a"), (5, "z"), (6, "A")], "k long, v string"), "v")
    assert dict(rows_of(store))[5] == "z" and dict(rows_of(store))[6] == "a"
    assert store.vacuum() >= 1 and len(store.versions()) == 1 and len(rows_of(store)) == 199


@pytest.mark.parametrize("harm", ["torn", "gone", "other"])
def test_an_unreadable_store_counts_as_empty(spark, tmp_path, harm):
    store = made(spark, tmp_path)
    store.insert_first(spark.createDataFrame([(k, "a") for k in range(9)], "k long, v string"))
    if harm == "torn":
        path = tmp_path / "versions" / "1.json"
        path.write_text(path.read_text()[:20])
        (tmp_path / "versions" / ".1.json.crc").unlink(missing_ok=True)
    elif harm == "gone":
        next(iter((tmp_path / "data").iterdir())).rename(tmp_path / "elsewhere")
    else:
        store = made(spark, tmp_path, buckets=5)  # dealt otherwise
    assert rows_of(store) == []
    store.insert_first(spark.createDataFrame([(1, "new")], "k long, v string"))
    assert rows_of(store) == [(1, "new")] and store.versions() == [1, 2]


def test_a_batch_is_merged_once(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["k"], "k long, n long", 2)
    total = lambda both: both.groupBy("k").agg(F.sum("n").alias("n"))
    one = spark.createDataFrame([(1, 1), (2, 5)], "k long, n long")
    for batch in (0, 0, 1, 1, 0):
        store.merge(one, total, ("s", batch))
    assert rows_of(store) == [(1, 2), (2, 10)] and store.tokens() == {"s": 1}


# Streams in instalments


def attempts(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aaaabcd") if k > 5 else "z", k, rng.random() < 0.4) for k in range(n)]


def append(spark, folder, rows, files):
    spark.createDataFrame(rows, "key string, seq long, ok boolean").repartitionByRange(files, "seq").write.mode("append").parquet(str(folder))


def plain_runs(rows):
    out = {}
    for key, _, ok in sorted(rows, key=lambda r: r[1]):
        run, most, n = out.get(key, (0, 0, 0))
        run = 0 if ok else run + 1
        out[key] = (run, max(most, run), n + 1)
    return out


def test_three_instalments_give_what_a_batch_gives(spark, tmp_path):
    rows = attempts(600, 1)
    source, places = tmp_path / "in", {n: str(tmp_path / n) for n in ("latest", "first", "runs")}
    for part, files in ((rows[:200], 3), (rows[200:210], 1), (rows[210:], 4)):
        append(spark, source, part, files)
        stream = lambda: streams.file_stream(spark, str(source))
        latest = streams.keep_latest(stream(), places["latest"], "key", "seq", buckets=3)
        first = streams.keep_first(streams.file_stream(spark, str(source), 100), places["first"], ["key", "ok"], "seq", buckets=3)
        runs = streams.keep_runs(streams.file_stream(spark, str(source), 100), places["runs"], "key", 3, buckets=3)
        seen = [r for r in rows if r[1] <= part[-1][1]]
        assert rows_of(latest) == sorted({k: (k, s, ok) for k, s, ok in seen}.values())
        assert {(r["key"], r["ok"]): r["seq"] for r in first.read().collect()} == {(k, ok): min(s for a, s, b in seen if (a, b) == (k, ok)) for k, _, ok in seen}
        assert {r.key: (r["tail"], r["most"], r["n"]) for r in runs.read().collect()} == plain_runs(seen)
    assert latest.tokens()["latest"] >= 2  # several batches


def test_the_run_stops_at_the_limit_and_goes_on_later(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "state")
    for k, ok in enumerate((True, False, False, False, True, False)):  # one file each, in order
        append(spark, source, [("a", 2 * k, ok), ("b", 2 * k + 1, True)], 1)
    kept = streams.keep_runs(streams.file_stream(spark, str(source)), folder, "key", 3, halt=True)
    got = {r.key: (r["n"], r["tail"], r["most"]) for r in kept.read().collect()}
    assert got == {"a": (4, 3, 3), "b": (4, 0, 0)}  # two files are left
    kept = streams.keep_runs(streams.file_stream(spark, str(source)), folder, "key", 3)
    assert {r.key: (r["n"], r["tail"], r["most"]) for r in kept.read().collect()} == {"a": (6, 1, 3), "b": (6, 0, 0)}


def test_runs_of_stretches_are_put_together(spark):
    for seed in range(3):
        rows = attempts(400, seed)
        frame = spark.createDataFrame(rows, "key string, seq long, ok boolean")
        for stretch in (1, 7, 65_536):
            got = {r.key: (r["tail"], r["most"], r["n"]) for r in streams.failure_runs(frame, "key", stretch=stretch).collect()}
            assert got == plain_runs(rows)


def test_a_failing_batch_is_repeated_without_doubling(spark, tmp_path):
    append(spark, tmp_path / "in", attempts(50, 4), 5)
    fails = Counter()
    store = KeyedStore(spark, str(tmp_path / "s/t"), ["key"], "key string, n long", 2)

    def each(batch, number):
        store.merge(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n")), lambda both: both.groupBy("key").agg(F.sum("n").alias("n")), ("n", number))
        fails[number] += 1
        if number == 2 and fails[number] == 1:
            raise ValueError("lost after the merge")

    with pytest.raises(Exception, match="lost after the merge"):
        streams.drain(streams.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "s"), each)
    streams.drain(streams.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "s"), each)
    assert fails[2] == 2 and dict(rows_of(store)) == Counter(k for k, _, _ in attempts(50, 4))


def test_drained_rows_of_all_runs(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    for part, n in ((attempts(40, 5)[:20], 20), (attempts(40, 5)[20:], 40)):
        append(spark, source, part, 2)
        whole = streams.run_available(streams.file_stream(spark, str(source)), folder, "append")
        assert whole.count() == n
        latest = streams.run_available(streams.latest_by_key(streams.file_stream(spark, str(source)), "key", "seq"), folder + "u", "update", ["key"])
        assert sorted(map(tuple, latest.select("key", "seq").collect())) == sorted({k: (k, s) for k, s, _ in attempts(40, 5)[:n]}.values())


def test_cases_never_go_back(spark, tmp_path):
    entries = [(1, 1, "started"), (1, 3, "error"), (1, 5, "completed"), (2, 1, "started"), (3, 2, "completed")]
    later = [(1, 2, "completed"), (2, 4, "needs_human_review"), (3, 9, "started"), (4, 1, "started")]
    for part in (entries, later):
        spark.createDataFrame(part, "case_id long, seq long, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept = streams.keep_case_states(streams.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "s"))
    assert rows_of(kept) == [(1, "completed", 2, 5, 4), (2, "needs_human_review", 4, 4, 2), (3, "completed", 2, 9, 2), (4, "open", None, 1, 1)]


# Rounds


def test_rounds_go_on_where_they_ended(spark, tmp_path):
    done, waits, asked = [0], [], []
    log = lambda: KeyedStore(spark, str(tmp_path / "log"), ["round"], streams.ROUND, 1)

    def run(gains):
        def one(number):
            asked.append(number)
            gain = gains.pop(0)
            if gain is None:
                raise OSError("no service")
            done[0] += gain

        return streams.supervise(log(), one, lambda: (done[0], 10), max_rounds=6, max_idle=2, backoff=1.5, sleep=waits.append)

    assert run([4, None, 0]) == "no_progress"
    assert [(r["round"], r.phase, r.fresh, r.idle, r.failed) for r in log().read().orderBy("round").collect()] == [(1, "round_finished", 4, 0, False), (2, "round_finished", 0, 1, True), (3, "no_progress", 0, 2, False)]
    assert waits == [1.5, 1.5] and run([]) == "no_progress"  # a new supervisor knows that two rounds were idle
    done[0] = 10
    assert run([]) == "complete" and asked == [1, 2, 3]


def test_rounds_end(spark, tmp_path):
    done = [0]
    log = KeyedStore(spark, str(tmp_path / "log"), ["round"], streams.ROUND, 1)
    step = lambda n: done.__setitem__(0, done[0] + 1)
    assert streams.supervise(log, step, lambda: (done[0], 10), max_rounds=2, max_idle=2) == "max_rounds"
    assert streams.supervise(log, step, lambda: (done[0], 10), max_rounds=20, max_idle=2) == "complete" and done == [10]


# Queries over a single file and a folder


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    """The given tables, events and line items as folders of several files that are not in the order of their ids."""
    place = tmp_path_factory.mktemp("folders")
    for name in ("events", "lineitem"):
        table(spark, data, name).repartition(5).write.parquet(f"{place}/{name}.parquet")
    return str(place)


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_folders(spark, data, folders, name):
    want = comparable(duck(data).sql(registry.oracle_sql()[name]).df())
    assert comparable(registry.queries()[name](spark, folders).toPandas()) == want and want[1]
