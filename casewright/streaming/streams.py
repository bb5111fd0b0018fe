"""Structured Streaming forms: folded state by key, latest attempts, exactly-once keys, breaker, case states, rounds, windows.

What a stream knows about its keys lives in a keyed table (``sources.keyed``). Each batch is
first reduced to one row a key in the JVM, then merged into the buckets that its keys touch,
under the batch's number, so a batch that runs again after a failure changes
nothing. A run drains what is there and ends; the next one goes on from the checkpoint.

Event times are cast to TIMESTAMP, since watermarks don't take TIMESTAMP_NTZ.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.sources.keyed import KeyedStore


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table as a stream of its files, be it a single file or a folder that files are added to."""
    path = path.rstrip("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if single:  # a stream reads folders only
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.option("recursiveFileLookup", "false").parquet(path)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of its files, with ``ts`` as a timestamp."""
    return file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


# Draining


class _Stop(Exception):
    """Raised inside a batch, after its merge, to end the run there."""


def drain(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], stop: Callable[[], bool] | None = None) -> bool:
    """Run ``each`` over the batches that are there, from the checkpoint in ``folder`` on; whether ``stop`` ended the run early.

    ``stop`` is asked after each batch. A stopped batch isn't marked as done, so it comes
    again in the next run under its old number; ``each`` has to know it by that.
    """
    stopped: list[bool] = []

    def one(batch: DataFrame, number: int) -> None:
        each(batch, number)
        if stop is not None and stop():
            stopped.append(True)
            raise _Stop

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            raise
    return bool(stopped)


def run_available(stream: DataFrame, folder: str, mode: str, key: list[str] | None = None) -> DataFrame:
    """Drain what is there into Parquet under ``folder`` and return all that this and earlier runs have written.

    Each batch overwrites a place of its own, so a batch that is run again after a failure is not
    doubled. In complete mode the last batch is the result; in update mode the last row of each ``key``.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(place)) if fs.exists(place) else []
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    if mode == "complete":
        return rows.parquet(f"{folder}/rows/batch={numbers[-1]}")
    whole = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    if mode == "update" and key:
        rest = [c for c in stream.columns if c not in key]
        return whole.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")
    return whole.drop("batch")


# State by key


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def keep_latest(attempts: DataFrame, folder: str, key: str, order: str, buckets: int = 16) -> KeyedStore:
    """The latest row of each key over this and all earlier runs, as a keyed table."""
    store = KeyedStore(attempts.sparkSession, f"{folder}/latest", [key], _ddl(attempts), buckets)

    def each(batch: DataFrame, number: int) -> None:
        store.upsert_latest(latest_by_key(batch, key, order), order, ("latest", number))

    drain(attempts, folder, each)
    return store


def keep_first(attempts: DataFrame, folder: str, keys: list[str], order: str, buckets: int = 16) -> KeyedStore:
    """The first row of each key, once and for all: what an earlier batch has brought stays."""
    store = KeyedStore(attempts.sparkSession, f"{folder}/first", keys, _ddl(attempts), buckets)
    rest = [c for c in attempts.columns if c not in keys]

    def each(batch: DataFrame, number: int) -> None:
        own = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
        store.insert_first(own, order, ("first", number))

    drain(attempts, folder, each)
    return store


#: Runs of failures in a stretch of attempts. ``head``: failures before the first success (all of them, if there is none);
#: ``tail``: failures after the last one; ``most``: the longest run; ``n``: attempts; ``solid``: no success at all.
_RUNS = "n long, head long, tail long, most long, solid boolean"


def _stretch(seq: str, ok: str, by: list[str]) -> Callable[[DataFrame], DataFrame]:
    def of(rows: DataFrame) -> DataFrame:
        """Runs of each key and stretch, by numbering the islands between successes."""
        group = Window.partitionBy(*by)
        marked = rows.withColumn("_island", F.sum(F.col(ok).cast("int")).over(group.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
        runs = marked.groupBy(*by, "_island").agg(F.count_if(~F.col(ok)).alias("_run"), F.count(F.lit(1)).alias("_n"))
        first, last = F.min_by("_run", "_island"), F.max_by("_run", "_island")
        head = F.when(F.min("_island") == 0, first).otherwise(0)
        return runs.groupBy(*by).agg(F.sum("_n").alias("n"), head.alias("head"), last.alias("tail"), F.max("_run").alias("most"), (F.max("_island") == 0).alias("solid"))

    return of


def _after(a: Column, b: Column) -> Column:
    """Two stretches in a row as one."""
    return F.struct(
        (a["n"] + b["n"]).alias("n"), F.when(a["solid"], a["head"] + b["head"]).otherwise(a["head"]).alias("head"), F.when(b["solid"], a["tail"] + b["tail"]).otherwise(b["tail"]).alias("tail"),
        F.greatest(a["most"], b["most"], a["tail"] + b["head"]).alias("most"), (a["solid"] & b["solid"]).alias("solid"),
    )


def _empty() -> Column:
    """A stretch without attempts."""
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("n"), zero.alias("head"), zero.alias("tail"), zero.alias("most"), F.lit(True).alias("solid"))


def failure_runs(attempts: DataFrame, key: str, seq: str = "seq", ok: str = "ok", stretch: int = 65_536) -> DataFrame:
    """``key``, n, head, tail, most and solid: runs of failures in order of ``seq``.

    A key's attempts are cut into stretches by ``seq``, so that a hot key is dealt over
    tasks; stretches of a key are then put together in their order.
    """
    part = F.floor(F.col(seq) / stretch)
    runs = _stretch(seq, ok, [key, "_part"])(attempts.select(key, seq, ok, part.alias("_part")))
    listed = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "n", "head", "tail", "most", "solid"))).alias("_s"))
    whole = F.aggregate("_s", _empty(), _after)
    return listed.select(key, whole.alias("_w")).select(key, "_w.*")


def keep_runs(attempts: DataFrame, folder: str, key: str, limit: int, seq: str = "seq", ok: str = "ok", halt: bool = False, buckets: int = 16) -> KeyedStore:
    """The failure breaker: one row a key with its open run of failures (tail) and its longest (most), over all batches and runs.

    Attempts come batch after batch in the order of ``seq``. With ``halt`` the run
    ends after the batch in which a key first fails ``limit`` times in a row; the state is kept, and so is what is left to read.
    """
    kind = dict(attempts.dtypes)[key]
    store = KeyedStore(attempts.sparkSession, f"{folder}/runs", [key], f"`{key}` {kind}, {_RUNS}", buckets)

    def combine(both: DataFrame) -> DataFrame:
        one = F.struct("n", "head", "tail", "most", "solid")
        put = both.groupBy(key).agg(F.max(F.when(F.col("_old"), one)).alias("a"), F.max(F.when(~F.col("_old"), one)).alias("b"))
        joined = _after(F.coalesce("a", _empty()), F.coalesce("b", _empty()))
        return put.select(key, joined.alias("_w")).select(key, "_w.*")

    def each(batch: DataFrame, number: int) -> None:
        store.merge(failure_runs(batch, key, seq, ok), combine, ("runs", number))

    drain(attempts, folder, each, (lambda: not store.read().where(F.col("most") >= limit).isEmpty()) if halt else None)
    return store


#: What closes a case.
CLOSED = ("completed", "needs_human_review", "error")


def keep_case_states(entries: DataFrame, folder: str, case: str = "case_id", seq: str = "seq", state: str = "state", buckets: int = 16) -> KeyedStore:
    """One row a case: ``status``, ``closed_at``, ``last`` (its greatest place) and n entries.

    A case is open until its first closing entry by ``seq`` (then by name), and never goes
    back, whatever comes behind that entry. Entries may arrive in any order.
    """
    kind = dict(entries.dtypes)[case]
    store = KeyedStore(entries.sparkSession, f"{folder}/cases", [case], f"`{case}` {kind}, status string, closed_at long, last long, n long", buckets)

    def summed(rows: DataFrame, closed: Column, last: str, n: Column) -> DataFrame:
        put = rows.groupBy(case).agg(F.min(closed).alias("_c"), F.max(last).alias("last"), F.sum(n).alias("n"))
        return put.select(case, F.coalesce("_c.state", F.lit("open")).alias("status"), F.col("_c.seq").alias("closed_at"), "last", "n")

    def each(batch: DataFrame, number: int) -> None:
        own = F.when(F.col(state).isin(*CLOSED), F.struct(F.col(seq).cast("long").alias("seq"), F.col(state).alias("state")))
        kept = F.when(F.col("closed_at").isNotNull(), F.struct(F.col("closed_at").alias("seq"), F.col("status").alias("state")))
        store.merge(summed(batch, own, seq, F.lit(1)), lambda both: summed(both, kept, "last", F.col("n")), ("cases", number))

    drain(entries, folder, each)
    return store


# Rounds

ROUND = "round long, phase string, done long, total long, fresh long, idle long, failed boolean, backoff double"


def supervise(log: KeyedStore, run: Callable[[int], None], progress: Callable[[], tuple[int, int]], max_rounds: int, max_idle: int, backoff: float = 0.0, sleep: Callable[[float], None] = clock.sleep) -> str:
    """Run rounds until all is done: ``complete``, ``no_progress`` or ``max_rounds``.

    Each round's outcome goes into ``log`` (one row a round), so that a supervisor that is started
    again goes on with the next round and with the count of idle ones. A round that raises
    counts as failed, and as idle if it brought nothing.
    """
    known = log.read().agg(F.max_by(F.struct("*"), "round").alias("r")).first().r
    number, idle = (known["round"], known["idle"]) if known else (0, 0)
    before, total = progress()
    if before >= total:
        return "complete"
    while True:
        if idle >= max_idle:
            return "no_progress"
        if number >= max_rounds:
            return "max_rounds"
        if number and backoff > 0:
            sleep(backoff)
        number, failed = number + 1, False
        try:
            run(number)
        except Exception:  # noqa: BLE001  whatever ends a round, its progress counts
            failed = True
        done, total = progress()
        fresh, before = done - before, done
        idle = 0 if fresh > 0 else idle + 1
        phase = "complete" if done >= total else "no_progress" if idle >= max_idle else "max_rounds" if number >= max_rounds else "round_finished"
        row = [(number, phase, done, total, fresh, idle, failed, float(backoff))]
        log.upsert_latest(log.spark.createDataFrame(row, ROUND), "round")
        if phase != "round_finished":
            return phase


# Operators on one stream


def latest_by_key(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Running latest row of each key: one struct of state."""
    rest = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def first_by_key(attempts: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark; later ones are dropped."""
    return attempts.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """Counts by window and event type; sliding if ``slide`` is given."""
    return events.groupBy(F.window(time, width, slide) if slide else F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, gap: str, time: str = "ts") -> DataFrame:
    """Sessions of each key that a gap ends."""
    return events.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
