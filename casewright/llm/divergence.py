"""Source divergence audit: how each source of a language departs from its other sources, and by which terms.

Terms are runs of ASCII letters and of other characters above U+007F, with A-Z
lower-cased. A language keeps the terms of at least ``min_docs`` of its documents.
A group (language, source), and each language, gives every kept term the
smoothed share p = 1 + floor(scale * (count + prior) / (N + prior * V)), where N is
the number of kept terms' occurrences there and V the number of kept terms.

Terms are counted per document and group while texts are read, so that only
counts are shuffled. The terms that set a group apart from its language are
chosen by radix selection (``operators.radix``): histograms over the digits of the
value find each group's threshold, and ties at it are refined by UTF-8 bytes.

Sums over all V terms between two sources g and h never visit the terms that
neither has: each of those differs by B, the difference of the groups' shares of
a term that doesn't occur. The sum is V * B, plus a correction for the terms of g, one
for those of h, and one for those of both. The corrections for one group's terms need
only how many of its terms occur n times; the one for both is a join of counts
by term, summed as it is made. A term has at most one row a source there, so its
pairs are bounded by the pairs of sources that the result lists anyway.

Defined results: null text, lang and source count as ''; a group without terms,
or in a language without kept terms, still has its pairs (with value 0 if V is
0); repeated rows are documents of their own; doc_id is not looked at; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators import radix
from casewright.session import bounded_batches, stored

from . import textkit

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BLOCK = 1 << 22
_HELD = 200_000
_SCHEMA = "lang string, source string, term string, n long, docs long"


def _block_counts(buf: np.ndarray, offs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of the terms of a block, given each row's group."""
    starts, ends, rows = textkit.word_spans(buf, offs, _LETTER)
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = textkit._LOWER[buf][_LETTER[buf]]
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters)).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    by_row, many = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
    by_group, place = np.unique(groups[by_row // size] * size + by_row % size, return_inverse=True)
    n = np.bincount(place, weights=many, minlength=len(by_group)).astype(np.int64)
    return by_group // size, coded.dictionary.take(pa.array(by_group % size)), n, np.bincount(place, minlength=len(by_group))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts, summed over batches as long as few rows are held."""
    names = ["lang", "source", "term", "n", "docs"]
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        found = pa.concat_tables(held).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
        return found.select([*names[:3], "n_sum", "docs_sum"]).rename_columns(names)

    for batch in batches:
        lang, source = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
        width = max(len(source.dictionary), 1)
        groups = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        for first, end, buf, offs in textkit.blocks(batch.column("text"), _BLOCK):
            at, terms, n, docs = _block_counts(buf, offs, groups[first:end])
            held.append(pa.table([lang.dictionary.take(pa.array(at // width)), source.dictionary.take(pa.array(at % width)), terms, pa.array(n), pa.array(docs.astype(np.int64))], names=names))
        if sum(t.num_rows for t in held) > _HELD:
            held = [summed()]
            if held[0].num_rows > _HELD // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held = []
    if held:
        yield from summed().to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term) of every group."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(_count_terms, _SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, n_terms: str, prior: int, scale: int) -> Column:
    """The smoothed share in whole numbers; 0 where a language has no kept term."""
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"if({n_terms} = 0, 0, 1 + (cast({scale} as decimal(12, 0)) * {wide(f'{count} + {prior}')}) div {wide(f'if({n_terms} = 0, 1, {total} + {prior} * {n_terms})')})")


def audit(docs: DataFrame, min_docs: int = 30, prior: int = 5, scale: int = 1_000_000_000, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources of the language (``pair``) by
    their distance, and the first ``ranks`` terms (``term``) that the group has more of than its language."""
    counts = stored(term_counts(docs), "divergence-counts")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    cells = stored(counts.drop("docs").join(terms, ["lang", "term"]), "divergence-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total"])
    sized = stored(sized.withColumn("base", _share("0", "total", "v", prior, scale)), "divergence-groups")
    shares = cells.join(sized, ["lang", "source"]).select("lang", "source", "term", "n", "base", _share("n", "total", "v", prior, scale).alias("p"), _share("in_lang", "lang_total", "v", prior, scale).alias("q"))
    shares = stored(shares, "divergence-shares")

    over = stored(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "divergence-over")
    listed = radix.top(over, ["lang", "source"], "value", "item", ranks).withColumn("part", F.lit("term"))
    return listed.select("lang", "source", "part", "item", "value", "rank").unionByName(_pairs(shares, sized))


def _pairs(shares: DataFrame, sized: DataFrame) -> DataFrame:
    """Every other source of the language with the sum of differences over all kept terms."""
    of = lambda frame, end: frame.select("lang", *(F.col(c).alias(f"{c}_{end}") for c in frame.columns if c != "lang"))
    small = sized.select("lang", "source", "base", "v")
    pairs = of(small, "g").join(of(small, "h"), "lang").where("source_g <> source_h")
    # What all terms of g would add if h had none of them; terms that occur as often have the same share.
    often = stored(shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")), "divergence-often")
    own = of(often, "g").join(pairs, ["lang", "source_g"]).groupBy("lang", "source_g", "source_h").agg(F.sum(F.expr("m_g * (abs(p_g - base_h) - abs(base_g - base_h))")).alias("own"))
    # What the terms of both differ from that.
    narrow = shares.select("lang", "term", "source", "p", "base")
    left = narrow.select("lang", "term", *(F.col(c).alias(f"{c}_g") for c in ("source", "p", "base")))
    right = narrow.select("lang", "term", *(F.col(c).alias(f"{c}_h") for c in ("source", "p", "base")))
    met = left.join(right, ["lang", "term"]).where("source_g < source_h")
    both = stored(met.groupBy("lang", "source_g", "source_h").agg(F.sum(F.expr("abs(p_g - p_h) - abs(p_g - base_h) - abs(p_h - base_g) + abs(base_g - base_h)")).alias("both")), "divergence-both")
    both = both.unionByName(both.select("lang", F.col("source_h").alias("source_g"), F.col("source_g").alias("source_h"), "both"))
    own = stored(own, "divergence-own")
    back = own.select("lang", F.col("source_h").alias("source_g"), F.col("source_g").alias("source_h"), F.col("own").alias("back"))
    keys = ["lang", "source_g", "source_h"]
    summed = pairs.join(own, keys, "left").join(back, keys, "left").join(both, keys, "left")
    value = F.col("v_g") * F.abs(F.col("base_g") - F.col("base_h")) + sum(F.coalesce(F.col(c), F.lit(0)) for c in ("own", "back", "both"))
    found = summed.select("lang", F.col("source_g").alias("source"), F.lit("pair").alias("part"), F.col("source_h").alias("item"), value.cast("long").alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def sql(min_docs: int = 30, prior: int = 5, scale: int = 1_000_000_000, ranks: int = 50) -> str:
    """DuckDB SQL of the audit over ``documents``, every group against every kept term."""
    share = f"(1 + ({scale}::HUGEINT * (n + {prior})) // (total + {prior} * v))::BIGINT"
    return rf"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {min_docs}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n AS own, {share} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM full_) JOIN v USING (lang)),
q AS (SELECT lang, term, {share} AS q FROM (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)) JOIN v USING (lang)),
sums AS (SELECT lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE own > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= {ranks}
"""
