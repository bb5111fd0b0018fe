"""The training-data pipeline: five operators in a row over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``. Rows with a null
doc_id, or one that comes with different texts, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import decontam, linedup, mixing, neardup, quality
from casewright.session import stored, table


#: Keys that are made of hashes have this bit, so that they come after usual ids.
HASHED = 1 << 62


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that only rows equal in doc_id and text share, and the key's name.

    The key is doc_id; where that is null, or comes with different texts, a
    hash of doc_id and text.
    """
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    own = docs["doc_id"].cast("long")
    texts = docs.select(own.alias("_of"), F.xxhash64(docs["text"]).alias("_h")).where("_of is not null").groupBy("_of").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    many = stored(texts.where("lo <> hi").select("_of"), "repeated-ids")
    hashed = F.xxhash64(own, docs["text"]).bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))
    key = F.when(own.isNull() | many["_of"].isNotNull(), hashed).otherwise(own)
    return docs.join(many, own == many["_of"], "left").select(*(docs[c] for c in docs.columns), key.alias(name)), name


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Keyed rows as an operator takes them, the key as doc_id."""
    return rows.select(F.col(key).alias("doc_id"), *(rows[c] for c in rows.columns if c not in ("doc_id", key)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    rows, key = keyed(docs)
    bad = quality.judge(by_key(rows, key)).where("not kept").select(F.col("doc_id").alias("_bad")).distinct()
    return rows.join(bad, rows[key] == bad["_bad"], "left_anti").drop(key)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; documents that were nothing else are dropped."""
    rows, key = keyed(docs)
    gone = linedup.removals(by_key(rows, key)).select(F.col("doc_id").alias("_id"), "places")
    places = gone["places"]
    joined = rows.join(gone, rows[key] == gone["_id"], "left")
    text = F.when(places.isNull(), rows["text"]).otherwise(linedup.without_places(rows["text"], places))
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(places.isNull(), rows["n_chars"]).otherwise(F.length(text).cast("long"))
    left = places.isNull() | F.coalesce(text.rlike(linedup.WORD), F.lit(False))
    cleaned = joined.select(*(fresh.get(c, rows[c]).alias(c) for c in docs.columns), left.alias(key))
    return cleaned.where(cleaned[key]).drop(key)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest key) of each group of near-duplicates; rows equal in doc_id and text count once."""
    rows, key = keyed(docs)
    judged = neardup.near_duplicates(by_key(rows, key)).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone"))
    # Both steps deal by the key, so the texts are shuffled once.
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti").dropDuplicates([key]).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = keyed(docs)
    leaks = decontam.find_leaks(by_key(rows, key), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leaked")).distinct()
    return rows.join(leaks, rows[key] == leaks["_leaked"], "left_anti").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn under the target weights, and how many times."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Outlier estimates and near-duplicate components are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
