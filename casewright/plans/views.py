"""Base views that give the driver's tables the roles of attempts, manifests, cases and so on.

Each view is written twice: as a DataFrame and as a DuckDB common table
expression with the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import table


def split_of(key: Column) -> Column:
    """About 70, 15 and 15 percent by the first two digits of the key's SHA-256."""
    bucket = F.left(F.sha2(key.cast("string"), 256), F.lit(2))
    return F.when(bucket < "b3", "train").when(bucket < "da", "val").otherwise("test")


def _split_sql(key: str) -> str:
    return f"CASE WHEN left(sha256(CAST({key} AS VARCHAR)), 2) < 'b3' THEN 'train' WHEN left(sha256(CAST({key} AS VARCHAR)), 2) < 'da' THEN 'val' ELSE 'test' END"


def v_manifest(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("manifest_id"), F.col("c_mktsegment").alias("class"), (F.col("c_acctbal") < 0).alias("is_attack"), F.col("r_name").alias("origin"), F.col("n_name").alias("detail"), split_of(F.col("c_custkey")).alias("split")
    )


def v_attempt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("manifest_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").isin("view", "purchase", "signup").alias("llm"),
        F.when(F.col("event_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"), (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") / 100).alias("confidence"), F.col("value").alias("latency"), F.col("event_type").alias("state"), "ts", "props",
    )


def v_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("case_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"), F.col("c_mktsegment").alias("profile"), F.col("o_totalprice").alias("price"), F.col("c_nationkey").alias("nation_key")
    )


TRACE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def v_trace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("started_us"), F.col("l_linenumber").cast("bigint").alias("stage"), F.struct(*TRACE_ORDER).alias("place"), F.col("l_returnflag").alias("flag"))


def v_score(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("origin"))
    prob = ((F.col("o_orderkey") * 7919) % 1000) / 1000
    return table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), prob.alias("prob"), (F.col("o_orderstatus") == "F").alias("truth"), (prob >= 0.5).alias("pred"), "origin")


CLASSES = ("click", "error", "purchase", "signup", "view")


def v_multi(spark: SparkSession, d: str) -> DataFrame:
    following = F.col("event_type")
    for a, b in zip(CLASSES, (*CLASSES[1:], CLASSES[0]), strict=True):
        following = F.when(F.col("event_type") == a, b).otherwise(following)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("truth"), F.when(F.col("event_id") % 5 == 0, following).otherwise(F.col("event_type")).alias("pred"), (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") / 100).alias("conf"), (F.col("user_id") % 3).alias("origin")
    )


def v_doc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.sha2("text", 256).alias("fp"), F.col("lang").alias("dataset"), "source", F.col("quality").alias("label"), split_of(F.col("doc_id")).alias("split"), "n_chars")


def v_cat(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("p_size") <= 16, "containment").when(F.col("p_size") <= 33, "eradication").otherwise("prevention")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("type"), F.col("p_name").alias("base_text"), phase.alias("phase"), F.col("p_brand").alias("brand"), F.col("p_size").cast("bigint").alias("size"))


_FOLLOWING = " ".join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in zip(CLASSES, (*CLASSES[1:], CLASSES[0]), strict=True))
SQL = {
    "v_manifest": f"SELECT c_custkey AS manifest_id, c_mktsegment AS class, c_acctbal < 0 AS is_attack, r_name AS origin, n_name AS detail, {_split_sql('c_custkey')} AS split FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_attempt": "SELECT user_id AS manifest_id, event_id AS seq, event_type <> 'error' AS ok, event_type IN ('view', 'purchase', 'signup') AS llm, CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 100 AS confidence, value AS latency, event_type AS state, ts, props FROM events",
    "v_case": "SELECT o_orderkey AS case_id, epoch_us(o_orderdate) AS created_us, o_orderstatus AS status, o_orderpriority AS type, c_mktsegment AS profile, o_totalprice AS price, c_nationkey AS nation_key FROM orders JOIN customer ON o_custkey = c_custkey",
    "v_trace": f"SELECT l_orderkey AS case_id, epoch_us(l_shipdate) AS started_us, CAST(l_linenumber AS BIGINT) AS stage, l_returnflag AS flag, {', '.join(TRACE_ORDER)} FROM lineitem",
    "v_score": "SELECT o_orderkey AS id, ((o_orderkey * 7919) % 1000) / 1000 AS prob, o_orderstatus = 'F' AS truth, ((o_orderkey * 7919) % 1000) / 1000 >= 0.5 AS pred, r_name AS origin FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_multi": f"SELECT event_id AS id, event_type AS truth, CASE WHEN event_id % 5 = 0 THEN CASE {_FOLLOWING} END ELSE event_type END AS pred, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 100 AS conf, user_id % 3 AS origin FROM events",
    "v_doc": f"SELECT d.doc_id, sha256(text) AS fp, lang AS dataset, source, quality AS label, {_split_sql('d.doc_id')} AS split, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "v_cat": "SELECT p_partkey AS item_id, p_type AS type, p_name AS base_text, CASE WHEN p_size <= 16 THEN 'containment' WHEN p_size <= 33 THEN 'eradication' ELSE 'prevention' END AS phase, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part",
}
TRACE_SQL = ", ".join(TRACE_ORDER)
SPLIT_SQL = _split_sql("o_orderkey")


def sql(body: str) -> str:
    """DuckDB SQL with the views that ``body`` names; ``body`` may begin with further expressions and a comma."""
    used = [name for name in SQL if name in body]
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in used)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {views}{body}" if views else f"WITH {body[1:]}"
    return f"WITH {views} {body}" if views else body
