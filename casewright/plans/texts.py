"""Queries over texts, models, streams and time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.operators import catalog as G
from casewright.operators import learning, textmetrics
from casewright.session import checkpoint_dir, table
from casewright.sources.keyed import KeyedStore
from casewright.streaming import streams

R = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1)).alias("n")


def _pairs(s, d):
    """Each document with the benchmark item of its number."""
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("item_text"))
    n = b.agg(F.count(F.lit(1)).alias("n_items"))
    docs = table(s, d, "documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n_items"))  # one row
    return docs.join(b, "item_id").select("doc_id", "lang", "text", "item_text")


PAIRS_SQL = "pa AS (SELECT doc_id, lang, d.text, b.text AS item_text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
TOK = lambda x: f"regexp_extract_all(translate(lower({x}), '{textmetrics.MARKED}', '{textmetrics.PLAIN}'), '[a-z0-9]+')"


def _cited(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.lit("uses T"), F.lpad((F.col("event_id") % 3000).cast("string"), 4, "0"), F.lit(" and capec-"), (F.col("event_id") % 7).cast("string"), F.lit(", m1001 x")).alias("t"))
    return e.select("event_id", F.array_join(G.unknown_references(F.col("t"), F.array(F.lit("T0001"), F.lit("CAPEC-3"), F.lit("M1001"))), ",").alias("unknown"))


def _json(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))).otherwise(F.concat(F.lit("[1, {\"k\": "), F.col("event_id").cast("string"), F.lit("}]"))).alias("t"))
    return e.select("event_id", F.try_variant_get(textmetrics.json_object(F.col("t")), "$.k", "bigint").alias("k"))


def _scrubbed(s, d):
    t = table(s, d, "documents").select("doc_id", F.concat(F.lit('a=1 label="x y", '), F.col("text"), F.lit(" type={a:[1,2]} z=2")).alias("t"))
    return t.select("doc_id", textmetrics.scrub_text(F.col("t")).alias("clean"))


def _scores(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 13).cast("double").alias("c13"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    model = learning.detector(["o_orderpriority", "price", "c13"], key="o_orderkey").fit(rows)
    return learning.scored(model, rows, ["o_orderkey"])


def _folder(s) -> str:
    return f"{checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"


def _case_stream(s, d):
    """Line items as trace entries: returned ones are failures, some accepted ones close their case."""
    flag = F.col("l_returnflag")
    state = F.when((flag == "R") & (F.col("l_quantity") > 45), "error").when((flag == "A") & (F.col("l_linenumber") > 2), "completed").when((flag == "N") & (F.col("l_discount") > 0.09), "needs_human_review").otherwise("started")
    seq = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")
    entries = streams.file_stream(s, f"{d.rstrip('/')}/lineitem.parquet").select(F.col("l_orderkey").alias("case_id"), seq.alias("seq"), state.alias("state"))
    kept = streams.keep_case_states(entries, _folder(s)).read()
    return kept.select("case_id", "status", "n", F.coalesce(F.col("last") > F.col("closed_at"), F.lit(False)).alias("went_on"))


CASE_STREAM_SQL = "WITH e AS (SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'error' WHEN l_returnflag = 'A' AND l_linenumber > 2 THEN 'completed' WHEN l_returnflag = 'N' AND l_discount > CAST(0.09 AS DOUBLE) THEN 'needs_human_review' ELSE 'started' END AS state FROM lineitem), c AS (SELECT case_id, seq, state FROM e WHERE state <> 'started' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY seq, state) = 1) SELECT e.case_id, coalesce(max(c.state), 'open') AS status, count(*) AS n, coalesce(max(e.seq) > max(c.seq), false) AS went_on FROM e LEFT JOIN c ON e.case_id = c.case_id GROUP BY 1"


def _rounds(s, d):
    """Rounds over the events until every user has a good purchase, or two rounds bring none."""
    folder = _folder(s)
    users = table(s, d, "events").select("user_id").distinct().count()
    good = lambda: streams.event_stream(s, d).where("event_type = 'purchase' and event_id % 20 = 0").select("user_id", "event_id")
    found = KeyedStore(s, f"{folder}/first", ["user_id"], "user_id bigint, event_id bigint")
    log = KeyedStore(s, f"{folder}/rounds", ["round"], streams.ROUND, buckets=1)
    streams.supervise(log, lambda n: streams.keep_first(good(), folder, ["user_id"], "event_id"), lambda: (found.read().count(), users), max_rounds=9, max_idle=2)
    return log.read().select("round", "phase", "done", "total", "fresh", "idle")


ROUNDS_SQL = "WITH p AS (SELECT count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (event_type = 'purchase' AND event_id % 20 = 0) AS done FROM events), r AS (SELECT CAST(unnest(range(1, 4)) AS BIGINT) AS round) SELECT round, CASE WHEN done = total THEN 'complete' WHEN done = 0 AND round = 2 OR round = 3 THEN 'no_progress' ELSE 'round_finished' END AS phase, done, total, CASE WHEN round = 1 THEN done ELSE 0 END AS fresh, CAST(CASE WHEN done = 0 THEN round ELSE round - 1 END AS BIGINT) AS idle FROM p, r WHERE (done < total OR round = 1) AND (done > 0 OR round < 3)"


def _window(df):
    return df.select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us"), "event_type", "n")


ALL = {
    "text_tokens": (lambda s, d: table(s, d, "documents").select("doc_id", F.size(textmetrics.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(textmetrics.tokens(F.col("text")))).cast("bigint").alias("n_distinct")), f"SELECT doc_id, CAST(len({TOK('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOK('text')})) AS BIGINT) AS n_distinct FROM documents"),
    "tfidf_pair_cosine": (lambda s, d: textmetrics.tfidf_cosine(_pairs(s, d), "doc_id", "text", "item_text").select("doc_id", R("cosine").alias("cosine")), f"WITH {PAIRS_SQL}, tk AS (SELECT doc_id, 'a' AS side, unnest({TOK('text')}) AS token FROM pa UNION ALL SELECT doc_id, 'b', unnest({TOK('item_text')}) FROM pa), c AS (SELECT doc_id, side, token, count(*) AS tf FROM tk WHERE length(token) >= 2 GROUP BY ALL), i AS (SELECT token, ln((1 + 2 * (SELECT count(*) FROM pa)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1), w AS (SELECT doc_id, token, sum(CASE WHEN side = 'a' THEN tf * idf END) AS a, sum(CASE WHEN side = 'b' THEN tf * idf END) AS b FROM c JOIN i USING (token) GROUP BY 1, 2) SELECT doc_id, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0), 6) AS cosine FROM w GROUP BY 1"),
    "similarity_by_type": (lambda s, d: _pairs(s, d).select("lang", textmetrics.jaccard(F.array_distinct(textmetrics.tokens(F.col("text"))), F.array_distinct(textmetrics.tokens(F.col("item_text")))).alias("j")).rollup("lang").agg(N(), R(F.avg("j")).alias("mean")).select(F.coalesce("lang", F.lit("(all)")).alias("lang"), "n", "mean"), f"WITH {PAIRS_SQL}, s AS (SELECT lang, list_distinct({TOK('text')}) AS a, list_distinct({TOK('item_text')}) AS b FROM pa), j AS (SELECT lang, len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) AS j FROM s) SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, round(avg(coalesce(j, 0)), 6) AS mean FROM j GROUP BY ROLLUP (lang)"),
    "rouge_l": (lambda s, d: _pairs(s, d).select("doc_id", R(textmetrics.rouge_l(textmetrics.tokens(F.col("text")), textmetrics.tokens(F.col("item_text")))).alias("f1")), None),
    "unknown_reference_ids": (_cited, "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3000 <> 1 THEN 'T' || lpad(CAST(event_id % 3000 AS VARCHAR), 4, '0') END, CASE WHEN event_id % 7 <> 3 THEN 'capec-' || (event_id % 7) END) AS unknown FROM events"),
    "extract_json_object": (_json, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events"),
    "scrub_text": (_scrubbed, None),
    "ml_scores": (_scores, None),
    "stream_latest_attempt": (lambda s, d: streams.keep_latest(streams.event_stream(s, d).select("user_id", "event_id", "event_type"), _folder(s), "user_id", "event_id").read(), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "stream_dedup": (lambda s, d: streams.keep_first(streams.event_stream(s, d).select("user_id", "event_type", "event_id"), _folder(s), ["user_id", "event_type"], "event_id").read().select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_case_states": (_case_stream, CASE_STREAM_SQL),
    "stream_rounds": (_rounds, ROUNDS_SQL),
    "ext_tumbling_counts": (lambda s, d: _window(streams.tumbling(table(s, d, "events"), "1 hour")), "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "ext_sliding_counts": (lambda s, d: _window(streams.tumbling(table(s, d, "events"), "1 hour", "30 minutes")), "SELECT epoch_us(b - k * INTERVAL 30 MINUTE) AS start_us, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events) CROSS JOIN range(2) r(k) GROUP BY 1, 2"),
    "ext_sessions": (lambda s, d: streams.sessions(table(s, d, "events"), "user_id", "30 minutes").select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start_us"), "n"), "SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k"),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: o for name, (_, o) in ALL.items() if o}
