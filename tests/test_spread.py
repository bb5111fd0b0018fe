"""Costly work on small tables is dealt over all tasks, and Python gets bounded batches."""

from __future__ import annotations

import pytest

from casewright.operators import training
from casewright.plans import registry, stores

QUERIES = registry.queries()


def _tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["sanitize_nested", "scrub_payload", "schema_violations"])
def test_rows_of_one_file_are_dealt(spark, data, name):
    assert QUERIES[name](spark, data).rdd.getNumPartitions() == _tasks(spark) > 1


def test_decomposed_texts_come_in_bounded_batches(spark, data):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    QUERIES["text_tokens_nfkd"](spark, data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


class _Seen:
    """In place of a pipeline: the tasks that it is given rows in."""

    def fit(self, rows):
        raise StopAsyncIteration(rows.rdd.getNumPartitions())


def test_training_rows_are_dealt(spark, data):
    with pytest.raises(StopAsyncIteration) as seen:
        training.train(stores._training_rows(spark, data), _Seen())
    assert seen.value.args == (_tasks(spark),)
