"""SimHash near-duplicates by the segment-popcount embedding.

A fingerprint has 64 bits: bit k is set if it is set in over half of the XXH64
hashes of the text's shingles, repeats included. It is cut into 32 segments of
two bits and mapped to the number of set bits in each. The Manhattan distance
of two such vectors is never above the Hamming distance of the fingerprints.
A count is kept in unary (0, 1, 3) in its segment's own two bits, so a vector
is a long again, and the Manhattan distance is the number of bits in which two
such longs differ.

The range join: the segments are dealt into radius // 2 + 1 faces. Two vectors
within ``radius`` are within 1 on one face at least, so a face is a grid of width
one: every fingerprint stands in its own cell of each face, and those with an
even sum there also look into the cells beside it (neighbours at distance one
have sums of different parity, so one side is enough). That is 13 rows a face
on average. Rows that share a cell are compared by the Manhattan distance of the
whole vectors, then by the exact Hamming distance.

Equal fingerprints are one node from the start. In a cell all rows meet its
least node first; what that links is one component. After that only rows outside
of the cell's largest component (its guests) meet the cell's other rows, since
a link inside a component changes nothing. So a crowded cell costs rows times
guests, not rows times rows, and its links are never listed in full.

Defined results: null, empty or blank text has fingerprint 0 and is linked like
any other; a text with fewer words than a shingle is one shingle of all its words;
rows that repeat a doc_id are one node with the links of all of them and
come back once per row; a null doc_id is linked with nothing and has no component;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import bounded_batches, cut, stored

from . import textkit
from .components import components

SEED = 42


def _spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a block with one space after each, and each word's new start (and the end of all)."""
    lengths = ends - starts
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(places[-1], 0x20, dtype=np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(places[:-1], lengths) + within] = buf[np.repeat(starts, lengths) + within]
    return out.tobytes(), places


def _set_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each of the 64 bits set; rows are the runs that begin at ``bounds``.

    Bits are counted in bytes, eight to a word, over runs of 255 hashes at most.
    """
    long_rows = np.diff(bounds, append=len(hashes))
    pieces = -(-long_rows // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(bounds, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    counts = np.zeros((len(at), 8, 8), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), at)
        counts[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(len(at), 64), first, axis=0)


def fingerprints(column: pa.Array, width: int) -> np.ndarray:
    """SimHash of every whole text: bit k is set if it is in over half of the text's shingle hashes."""
    out = np.zeros(len(column), dtype=np.uint64)
    for first, _, buf, offs in textkit.blocks(column):
        starts, ends, rows = textkit.word_spans(buf, offs)
        if not len(starts):
            continue
        raw, places = _spaced(textkit._LOWER[buf], starts, ends)
        many = np.bincount(rows, minlength=len(offs) - 1)
        # a shingle begins at every word that has width - 1 after it, and at the first of a shorter text
        head = np.cumsum(many) - many
        after = many[rows] - (np.arange(len(rows)) - head[rows])
        begin = np.flatnonzero((after >= width) | ((after == many[rows]) & (many[rows] < width)))
        end = begin + np.minimum(width, after[begin])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(places[begin].tolist(), (places[end] - 1).tolist(), strict=True)], dtype=np.uint64)
        at = rows[begin]
        bounds = np.flatnonzero(np.diff(at, prepend=-1))
        counts = _set_counts(hashes, bounds)
        n = np.diff(bounds, append=len(hashes))
        bits = (2 * counts > n[:, None]).astype(np.uint8)
        out[first + at[bounds]] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return sign


def signed(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and ``print`` (the 64 bits as a long) of every whole text."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_signer(width), "doc_id long, print long")


def embedded(bits: str) -> str:
    """SQL of the segment counts of a long: the two bits of each segment sorted, so that the lower is set first."""
    odd = "6148914691236517205L"  # every lower bit of a segment
    return f"((({bits} | shiftrightunsigned({bits}, 1)) & {odd}) | shiftleft({bits} & shiftrightunsigned({bits}, 1) & {odd}, 1))"


def _faces(radius: int) -> list[range]:
    """The bits of each face: whole segments, as evenly as they go."""
    n = radius // 2 + 1
    cuts = [2 * (32 * k // n) for k in range(n + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(face: range) -> str:
    value = sum(1 << k for k in face)
    return f"{value - (1 << 64) if value >> 63 else value}L" if value != 1 << 63 else "(-9223372036854775807L - 1L)"


def _standing(nodes: DataFrame, radius: int) -> DataFrame:
    """face, cell, own, node, print: each node in its own cells, and in those beside them where the sum of counts is even."""
    t, parts = embedded("print"), []
    for place, face in enumerate(_faces(radius)):
        cell = f"({t} & {_mask(face)})"
        # A bit of a unary count may be turned if the segment's other bit is 0 (for the lower) or 1 (for the upper).
        near = f"transform(filter(sequence({face[0]}, {face[-1]}), k -> (shiftrightunsigned({t}, k ^ 1) & 1) = (k & 1)), k -> named_struct('face', {place}, 'cell', {cell} ^ shiftleft(1L, k), 'own', false))"
        parts += [f"array(named_struct('face', {place}, 'cell', {cell}, 'own', true))", f"if(bit_count({cell}) % 2 = 0, {near}, array())"]
    return nodes.select("node", "print", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("at")).select("at.face", "at.cell", "at.own", "node", "print")


def _close(a: str, b: str, radius: int) -> str:
    """The lower bound first, then the distance itself."""
    return f"bit_count({embedded(a)} ^ {embedded(b)}) <= {radius} AND bit_count({a} ^ {b}) <= {radius}"


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between ``nodes`` (node, print; prints distinct) that give the components of all pairs within ``radius``."""
    rows = _standing(nodes, radius)
    first = F.min(F.when(F.col("own"), F.struct("node", "print")))
    crowd = rows.groupBy("face", "cell").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1 and first is not null")
    crowd = stored(crowd.select("face", "cell", F.col("first.node").alias("star"), F.col("first.print").alias("star_print")), "simhash-cells")
    met = stored(rows.join(crowd, ["face", "cell"]), "simhash-rows")
    stars = cut(met.where("node <> star").where(_close("print", "star_print", radius)).select(F.col("node").alias("a"), F.col("star").alias("b")).distinct())
    known = stored(components(stars), "simhash-known")
    placed = stored(met.select("face", "cell", "own", "node", "print").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "simhash-placed")
    homes = placed.groupBy("face", "cell", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("face", "cell").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.count(F.lit(1)).alias("n"))
    homes = stored(homes.where("n > 1").select("face", "cell", "home"), "simhash-homes")
    guests = stored(placed.join(homes, ["face", "cell"]).where("component <> home").select("face", "cell", *(F.col(c).alias(f"guest_{c}") for c in ("own", "node", "print", "component"))), "simhash-guests")
    pairs = guests.join(placed, ["face", "cell"]).where("component <> guest_component and (own or guest_own)").where(_close("print", "guest_print", radius))
    return stars.unionByName(pairs.select(F.col("guest_node").alias("a"), F.col("node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    Documents are linked when their fingerprints differ in ``radius`` bits or
    fewer; component_id is the smallest doc_id reachable.
    """
    prints = stored(signed(docs, width), "simhash-prints")
    alone = prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_copies"))
    nodes = stored(alone, "simhash-nodes")
    # Only prints with copies need a join to find their node.
    copies = nodes.where("n_copies > 1").select("print", F.col("node").alias("first_copy"))
    own = prints.join(copies, "print", "left").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("first_copy", "doc_id")))
    # The prints of a repeated doc_id are tied together.
    ids = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    tied = own.join(stored(ids.where("least <> most"), "simhash-ties"), "doc_id").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = components(links(nodes.select("node", "print"), radius).unionByName(tied)).withColumnsRenamed({"node": "linked"})
    placed = own.join(stored(found, "simhash-components"), own["node"] == F.col("linked"), "left")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.coalesce("component", "node").alias("component_id"))
