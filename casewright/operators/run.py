"""Cases run through all stages in a row, with the trace they leave, and their way into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import schemas

from . import cases as K

TRACE = f"array<struct<{schemas.TRACE}>>"
#: The stage that each step of a path stands for.
AGENTS = {"standardize": "final_standardizer", "detect": "final_detector", "classify": "final_classifier", "explain": "final_mitigator", "judge": "final_judge"}
#: Closing states of a case.
CLOSED = ("completed", "needs_human_review", "error")


def append(trace: Column, agent: Column | str, status: Column, started: Column, finished: Column) -> Column:
    """A trace with one entry more, numbered after the last; the array that is given stays as it is."""
    agent = F.lit(agent) if isinstance(agent, str) else agent
    entry = F.struct((F.size(trace) + 1).cast("bigint").alias("seq"), agent.alias("agent"), status.alias("status"), started.cast("bigint").alias("started_us"), finished.cast("bigint").alias("finished_us"))
    return F.concat(trace, F.array(entry))


def traced(cases: DataFrame, began_us: Column, step_us: int = 1000) -> DataFrame:
    """Adds ``trace``: an entry for the orchestrator and for each stage of the case's path; a stage with an error closes as one.

    An error of a case belongs to its standardizer, the first stage that can fail.
    """
    agent_of = F.create_map(*(F.lit(x) for pair in AGENTS.items() for x in pair))
    agents = F.concat(F.array(F.lit("orchestrator")), F.transform(F.split("path", ">"), lambda name: agent_of[name]))

    def entry(agent: Column, place: Column) -> Column:
        start = (began_us + place * step_us).cast("bigint")
        status = F.when((agent == AGENTS["standardize"]) & (F.col("n_errors") > 0), "error").otherwise("ok")
        return F.struct((place + 1).cast("bigint").alias("seq"), agent.alias("agent"), status.alias("status"), start.alias("started_us"), (start + step_us // 2).alias("finished_us"))

    return K.route(cases).withColumn("trace", F.transform(agents, entry))


def with_trace_facts(cases: DataFrame) -> DataFrame:
    """Flat cases with a ``trace``, whose trace facts are those of the trace itself."""
    entries = cases.select("case_id", F.explode("trace").alias("t")).select("case_id", "t.*")
    facts = K.trace_facts(entries)
    return cases.drop(*(c for c in facts.columns if c != "case_id")).join(facts, "case_id")


def persist(store: DataFrame, results: DataFrame, traces: DataFrame, known_agents: tuple[str, ...]) -> DataFrame:
    """(case_id, failed_step, stored_status, n_stored) of every result (case_id, status) that is to enter ``store`` (case_id).

    A case is created, its trace (case_id, seq, agent) is appended entry by
    entry, then it is closed; nothing is done after the first step that fails:
    creation where the case exists, an entry of an unknown agent, a status that
    closes nothing. What was done before stays: an open case, the entries before.
    """
    exists = store.select("case_id").distinct().withColumn("_exists", F.lit(True))
    bad = F.min(F.when(~F.coalesce(F.col("agent").isin(*known_agents), F.lit(False)), F.col("seq")))
    seen = traces.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), bad.alias("_bad"))
    before = traces.join(seen, "case_id").where(F.col("_bad").isNotNull() & (F.col("seq") < F.col("_bad"))).groupBy("case_id").agg(F.count(F.lit(1)).alias("_before"))
    joined = results.join(exists, "case_id", "left").join(seen, "case_id", "left").join(before, "case_id", "left")
    step = F.when(F.col("_exists"), "create_case").when(F.col("_bad").isNotNull(), "append_trace").when(~F.coalesce(F.col("status").isin(*CLOSED), F.lit(False)), "update_case")
    n = F.when(step == "create_case", 0).when(step == "append_trace", F.coalesce("_before", F.lit(0))).otherwise(F.coalesce("_n", F.lit(0)))
    status = F.when(step.isNull(), F.col("status")).when(step == "create_case", None).otherwise("open")
    return joined.select("case_id", step.alias("failed_step"), status.alias("stored_status"), n.cast("bigint").alias("n_stored"))


def batch(cases: DataFrame, by: str) -> DataFrame:
    """(by, n, n_abstained, n_detected, n_classified): what the batch forms of the stages report."""
    detected = ~F.col("ingest_abstain") & F.col("det_present")
    return cases.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ingest_abstain")).alias("n_abstained"), F.count_if(detected).alias("n_detected"), F.count_if(detected & F.col("cls_present")).alias("n_classified"))


def numbered(trace: DataFrame, order: list[str]) -> DataFrame:
    """Trace rows with ``seq`` from 1 in each case."""
    return trace.withColumn("seq", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)).cast("bigint"))
