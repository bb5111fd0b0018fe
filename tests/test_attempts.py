"""Attempt files of events whose ids are there more than once."""

from __future__ import annotations

from pathlib import Path

import duckdb
from compare import TABLES, comparable, duck

from casewright.plans import stores


def test_repeated_events_meet_the_sql(spark, data, tmp_path):
    for name in TABLES:
        if name != "events":
            (tmp_path / f"{name}.parquet").symlink_to(Path(data) / f"{name}.parquet")
    duckdb.sql(f"COPY (SELECT e.* REPLACE (event_id + 2000 AS event_id, user_id + 5000 * i AS user_id) FROM range(3) r(i), '{data}/events.parquet' e) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = stores.QUERIES["attempts_parse_status"](spark, str(tmp_path)).toPandas()
    assert comparable(found) == comparable(duck(str(tmp_path)).sql(stores.ORACLES["attempts_parse_status"]).df())


def test_a_file_is_written_whole_by_many_tasks(spark, tmp_path):
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.01/{name}.parquet")
    # So that Spark joins small partitions of the lines less than those of what is smaller.
    for key, value in {"advisoryPartitionSizeInBytes": "40k", "coalescePartitions.minPartitionSize": "1k", "coalescePartitions.parallelismFirst": "false"}.items():
        spark.conf.set(f"spark.sql.adaptive.{key}", value)
    try:
        found = stores.QUERIES["attempts_parse_status"](spark, str(tmp_path)).toPandas()
    finally:
        for key in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize", "coalescePartitions.parallelismFirst"):
            spark.conf.unset(f"spark.sql.adaptive.{key}")
    assert comparable(found) == comparable(duck(str(tmp_path)).sql(stores.ORACLES["attempts_parse_status"]).df())
