"""File sources and sinks: CSV with row ids, manifests and attempts as JSON lines, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.session import stored

MANIFEST_SCHEMA = "manifest_id string, dataset string, source_file string, row_id string, content_hash string, split string, tasks array<string>, target struct<class: string, is_attack: boolean>, row map<string, string>"
ATTEMPT_SCHEMA = "manifest_id string, ok boolean, parsed_by_llm boolean, from_cache boolean, provider string, model string, mapping_confidence double, selected_columns array<string>, latency_s double, failure_code string, error string"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, id_column: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV rows with ``source_file`` and ``row_id``.

    Row ids are 0-based places in a file. A file is one ordered stream of rows, so
    its places come from the scan's own order: partitions of one file are numbered
    in order, and within a partition rows are. The scan is written out once with
    its numbers, which all that follows reads. With ``id_column`` nothing needs
    numbering, which is the form for large files. With ``multi_line`` quoted
    fields may hold line breaks, and a file is then read by one task.
    """
    rows = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=multi_line, escape='"').withColumn("source_file", F.col("_metadata.file_path"))
    if id_column is not None:
        return rows.withColumn("row_id", F.col(id_column).cast("bigint"))
    placed = stored(rows.withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_id", F.monotonically_increasing_id()), "csv-rows")
    sizes = placed.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(starts, ["source_file", "_block"]).withColumn("row_id", F.col("_start") + F.col("_id") - F.col("_first")).drop("_block", "_id", "_first", "_start")


def recover(requests: DataFrame, rows: DataFrame, key: str = "row_id", digest: str = "content_hash", label: str | None = None, needed: str | None = None) -> DataFrame:
    """Requests (key, digest, ...) with the scanned row of their key and ``state``.

    missing: no row has the key; repeated: several have; empty: the ``needed`` column is blank; hash_mismatch: the
    row's digest is another; class_mismatch: its ``label`` is another than the request's, as tokens; else verified.
    """
    from casewright.functions.values import normalize_token

    own = [key, digest, *([label] if label else [])]
    rest = [c for c in rows.columns if c not in own]
    named = rows.select(key, F.struct(F.col(digest).alias("d"), *([F.col(label).alias("l")] if label else []), *rest).alias("_s"))
    scanned = named.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_s"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    if needed:
        state = state.when(F.coalesce(F.trim(F.col(f"_s.{needed}")) == "", F.lit(True)), "empty")
    state = state.when(~F.col("_s.d").eqNullSafe(F.col(digest)), "hash_mismatch")
    if label:
        state = state.when(normalize_token(F.col("_s.l")) != normalize_token(F.col(label)), "class_mismatch")
    found = requests.join(scanned, key, "left").withColumn("state", state.otherwise("verified"))
    return found.select(*requests.columns, *(F.when(F.col("state") == "verified", F.col(f"_s.{c}")).alias(c) for c in rest), "state")


def require_verified(recovered: DataFrame) -> DataFrame:
    """The same rows, or an error that names some of those that weren't verified."""
    bad = recovered.where("state <> 'verified'").limit(5).collect()
    if bad:
        raise ValueError(f"rows can't be recovered: {[r.asDict() for r in bad]}")
    return recovered


def recover_context(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """manifest_id, state, proto and service of requests (manifest_id, content_hash, dataset) from manifest lines.

    missing, repeated, hash_mismatch, dataset_mismatch, row_missing or verified; names in the row count in any case.
    """
    from casewright.functions.values import normalize_token, pick

    one = manifests.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("content_hash", "dataset", "row")).alias("_m"))
    met = requests.join(one, "manifest_id", "left")
    state = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(~F.col("_m.content_hash").eqNullSafe(F.col("content_hash")), "hash_mismatch")
        .when(normalize_token(F.col("_m.dataset")) != normalize_token(F.col("dataset")), "dataset_mismatch").when(F.col("_m.row").isNull(), "row_missing").otherwise("verified")
    )
    row = F.when(state == "verified", F.col("_m.row"))
    return met.select("manifest_id", state.alias("state"), pick(row, "proto", "protocol").alias("proto"), pick(row, "service", "app_proto").alias("service"))


def union_sources(*parts: tuple[DataFrame, Column]) -> DataFrame:
    """Rows of several sources with the ``cls`` that each source's labeler column gives; rows without one are left out."""
    labelled = [df.withColumn("cls", labeler).where("cls is not null") for df, labeler in parts]
    out = labelled[0]
    for df in labelled[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines with ``violation``: unparsable, missing_field, bad_split or target_in_row; null if good."""
    from casewright.functions.leak import is_target_field

    raw = spark.read.text(path).where(F.trim("value") != "")
    m = raw.withColumn("m", F.from_json("value", MANIFEST_SCHEMA, {"mode": "PERMISSIVE"})).select("value", "m.*")
    violation = (
        F.when(F.try_parse_json("value").isNull() | F.col("manifest_id").isNull() & F.col("dataset").isNull(), "unparsable")
        .when(F.col("manifest_id").isNull() | F.col("content_hash").isNull() | F.col("target").isNull(), "missing_field")
        .when(~F.coalesce(F.col("split"), F.lit("")).isin("train", "val", "test"), "bad_split")
        .when(F.exists(F.map_keys(F.coalesce("row", F.create_map().cast("map<string,string>"))), lambda k: is_target_field(k)), "target_in_row")
    )
    return m.withColumn("violation", violation).drop("value")


def duplicate_manifests(manifests: DataFrame) -> DataFrame:
    """(field, value, n) of manifest ids and content hashes that are there more than once."""
    parts = [manifests.groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1") for c in ("manifest_id", "content_hash")]
    return parts[0].unionByName(parts[1])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of text files: value, source_file, line (0-based in the file), seq (0-based over files in the order
    of their paths), last (of its file) and closed (false for a last line without a line feed).

    A file's splits are counted, lines and bytes, and their sums say where each split begins; a line's place inside
    of its split comes from the scan's order, which is written out once. Lines end at a line feed only. Where the last
    one has none, bytes and line feeds make one more than the file's size, or than that less the three of a mark which the scan skips.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    raw = stored(raw, "text-lines")
    splits = raw.groupBy("source_file", "_size", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    files = splits.groupBy("source_file", "_size").agg(F.sum("_n").alias("_lines"), F.sum("_bytes").alias("_all"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = stored(files.select("source_file", "_lines", (F.col("_size") - F.col("_all")).isin(0, 3).alias("_ended"), F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_base")), "text-files")
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("source_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = raw.join(stored(starts, "text-splits"), ["source_file", "_block"]).join(files, "source_file")
    line = F.col("_start") + F.col("_id") - F.col("_first")
    last = line == F.col("_lines") - 1
    return placed.select("value", "source_file", line.alias("line"), (F.col("_base") + line).alias("seq"), last.alias("last"), (~last | F.col("_ended") | F.col("value").endswith("\r")).alias("closed"))


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Attempt lines with source_file, line, seq and ``state``: parsed, truncated or corrupt; blank lines are left out.

    Only the last line of a file, and only one without a line feed, may be truncated: its writer is still at
    work. Any other line that is no JSON of finite numbers in UTF-8 is corrupt. A byte order mark counts on a first line only.
    """
    lines = _numbered(spark, path)
    text = F.when(F.col("line") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    lines = lines.withColumn("value", text).where(~F.is_valid_utf8("value") | (F.regexp_replace("value", r"^\s+|\s+$", "") != ""))
    odd = ~F.is_valid_utf8("value") | F.try_parse_json(F.try_validate_utf8("value")).isNull() | F.col("value").rlike(r":\s*(?:NaN|-?Infinity)\b") | F.col("value").startswith("\ufeff")
    state = F.when(~odd, "parsed").when(F.col("last") & ~F.col("closed"), "truncated").otherwise("corrupt")
    parsed = lines.withColumn("state", state).withColumn("a", F.from_json(F.when(F.col("state") == "parsed", F.col("value")), ATTEMPT_SCHEMA))
    return parsed.select("source_file", "line", "seq", "a.*", "state")


def require_whole(attempts: DataFrame) -> DataFrame:
    """The parsed attempts, or an error that names corrupt lines."""
    bad = attempts.where("state = 'corrupt'").select("source_file", "line").limit(5).collect()
    if bad:
        raise ValueError(f"no JSON: {[(r.source_file, r.line) for r in bad]}")
    return attempts.where("state = 'parsed'").drop("state")


def read_lines(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(line, value) of JSON lines from physical line ``offset`` on, counted over the files in the order of their paths; blank ones are skipped, at most ``limit`` come."""
    kept = _numbered(spark, path).where((F.col("seq") >= offset) & (F.trim("value") != "")).select(F.col("seq").alias("line"), "value")
    return kept if limit is None else kept.orderBy("line").limit(limit)


def write_selected(rows: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "split"), targets: tuple[str, ...] = ()) -> None:
    """Selected rows as JSON lines, one folder for each dataset and split; ``targets`` go into a struct of their own, apart from the row's."""
    rest = [c for c in rows.columns if c not in (*by, *targets)]
    apart = [F.struct(*rest).alias("row"), F.struct(*targets).alias("target")] if targets else rest
    rows.select(*by, *apart).write.mode("overwrite").partitionBy(*by).json(path)


def inventory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(name, n_bytes, sha256) of the files under a path, of all folders below it if ``recursive``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_hash(files: DataFrame) -> DataFrame:
    """One hash of an inventory that doesn't depend on folders: of bucket hashes over sorted ``name:sha256`` lines, so that no task holds all names."""
    lines = files.select(F.concat_ws(":", "name", "sha256").alias("l")).withColumn("_b", F.left(F.sha2("l", 256), F.lit(3)))
    buckets = lines.groupBy("_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_b", "h"))), "\n"), 256).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))  # 4,096 buckets at most
