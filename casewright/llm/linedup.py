"""Line dedup by distinct-site spread.

The sites (sources) that a line appears on are counted by HyperLogLog sketches
per line hash, which merge by aggregation before and after the shuffle. Lines
whose estimate is clearly above the threshold are boilerplate, those clearly
below are not; lines within ``margin`` of it get an exact distinct count of
their sites. A boilerplate line stays in its first document (smallest doc_id)
and is removed from all others. Lines with fewer than ``min_words`` words are
left alone.

Documents are never gathered: the removed places of a document come from a join
on the line hash, whose hot side adaptive execution splits, and only lists of
places travel back to the texts.

Defined results: null text stays null, with no line; null source counts as one
site; rows that repeat a doc_id are one document, whose own lines stay in all of
them, and each row loses lines of its own text only; rows with a null doc_id
keep all their lines; an empty table gives an empty result; other columns
pass through, whatever their names, except one named ``n_removed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.session import stored

WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame, min_words: int, site: Column) -> DataFrame:
    """doc_id, hash of the text, place, line hash and site of every line that is long enough."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.alias("site"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    worded = split.where(F.col("line").rlike(rf"^[\x20\x09-\x0D]*(?:{WORD}[\x20\x09-\x0D]+){{{min_words - 1}}}{WORD}"))
    return worded.select("doc_id", "text_hash", "place", "site", F.xxhash64("line").alias("h"))


def spread(docs: DataFrame, min_sites: int = 5, margin: float = 0.3, min_words: int = 3, lg_k: int = 11, site: Column | None = None) -> DataFrame:
    """h, first_doc, n_sites and ``exact`` of every line that is on at least ``min_sites`` sites."""
    sites = F.coalesce(F.col("source").cast("string"), F.lit("")) if site is None else site
    lines = _lines(docs, min_words, sites)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    # A line that is found fewer times than there must be sites needs no estimate. Candidates are written out:
    # joins on them then deal both sides anew, which lets adaptive execution split a hot line, or broadcast few lines.
    rated = sketched.where(F.col("n") >= min_sites).select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("n_sites")).where(F.col("n_sites") > min_sites * (1 - margin))
    rated = stored(rated, "line-candidates")
    near = rated.where(F.col("n_sites") < min_sites * (1 + margin))
    counted = lines.join(near.select("h"), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("true_sites"))
    both = rated.join(counted, "h", "left")
    n_sites = F.coalesce("true_sites", "n_sites")
    return both.where(n_sites >= min_sites).select("h", "first_doc", n_sites.alias("n_sites"), F.col("true_sites").isNotNull().alias("exact"))


def removals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, ``text_hash`` and ``places`` (0-based, ascending) of the lines that each text of a document loses.

    A document that loses nothing, a null text and a null doc_id have no row; texts of a repeated doc_id have a
    row each, equal ones one for all; an empty table gives none.
    """
    site = options.pop("site", None)
    min_words = options.get("min_words", 3)
    found = stored(spread(docs, site=site, **options).select("h", "first_doc"), "line-boilerplate")
    lines = _lines(docs, min_words, F.lit(None).cast("string")).drop("site")
    hit = lines.join(found, "h").where("doc_id <> first_doc")
    # A line that repeats inside its first document is no cross-site matter and stays.
    return hit.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their texts without boilerplate lines, and ``n_removed``."""
    gone = removals(docs, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    places = gone["places"]
    joined = docs.join(gone, (docs["doc_id"].cast("long") == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left")
    text = F.when(places.isNull(), docs["text"]).otherwise(without_places(docs["text"], places))
    n_removed = F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long")
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns if c != "n_removed"), n_removed.alias("n_removed"))


def without_places(text: Column, places: Column) -> Column:
    """A text without the lines at some 0-based places, in ascending order.

    What stays is cut between one removed place and the next, so that the work
    grows with the lines and not with lines times places.
    """
    lines = F.split(text, "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    run = lambda s, k: F.slice(s["lines"], F.get(s["edges"], k - 1) + 2, F.get(s["edges"], k) - F.get(s["edges"], k - 1) - 1)
    left = lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.size(s["edges"]) - 1), lambda k: run(s, k)))
    # An array of one struct, so that the text is split once and not for every place.
    return F.array_join(F.flatten(F.transform(F.array(F.struct(lines.alias("lines"), edges.alias("edges"))), left)), "\n")


def sql(min_sites: int = 5, min_words: int = 3) -> str:
    """DuckDB SQL for the query's rows over ``documents``."""
    return f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
w AS (SELECT * FROM l WHERE len(regexp_extract_all(line, '[^ \\t-\\r]+')) >= {min_words}),
s AS (SELECT line, min(doc_id) AS first_doc FROM w GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {min_sites}),
g AS (SELECT w.doc_id, w.place FROM w JOIN s USING (line) WHERE w.doc_id <> s.first_doc),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.place = g.place WHERE g.doc_id IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(coalesce(k.text, '')) AS text_md5 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
