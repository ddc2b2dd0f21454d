"""SimHash fingerprints and their exact near-duplicate links.

Fingerprints are compared in tiles with exclusive-or and bit counts. A tile holds
fingerprints whose two halves have the same population counts; tile pairs of which the
counts of both halves together differ by more than the radius are never made, since every
differing bit changes one of those counts by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodeworks.llm.common import stored, stored_alone, unused
from lodeworks.llm.components import components
from lodeworks.llm.tokens import slices

#: Fingerprints in a tile on average, rows of a tile compared and bytes of text hashed at a time.
TILE, ROWS, SLICE_BYTES = 16_384, 16, 3_000_000
LANES = np.uint64(0x0101010101010101)


def words_joined(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, A-Z lower-cased, each with a blank after it; their sizes; words per text."""
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())  # in this order: lower-casing a slice that has been cast is wrong
    texts = pc.ascii_trim_whitespace(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    counts = np.diff(parts.offsets.to_numpy())
    size = pc.binary_length(flat).to_numpy()
    keep = size > 0
    if not keep.all():  # an empty text splits into one empty word
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        counts = np.bincount(owner, minlength=len(counts))
        flat, size = flat.filter(pa.array(keep)), size[keep]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.scalar(" ", flat.type))
    return joined[0].as_buffer().to_pybytes(), size, counts


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """The SimHash of each text over its word shingles' XXH64 (seed 42)."""
    import xxhash

    blob, size, counts = words_joined(texts)
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.minimum(at + shingle - 1, np.repeat(first + counts - 1, n))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(blob[s:e], 42) for s, e in zip(starts[at].tolist(), ends[last].tolist())], np.uint64, len(at))
    has = np.flatnonzero(n)
    if not len(has):
        return out
    # byte-wide counters, eight bits of a hash at a time, over runs of at most 255 hashes
    runs = -(-n[has] // 255)
    opened = np.cumsum(runs) - runs
    start = np.repeat((np.cumsum(n) - n)[has], runs) + 255 * (np.arange(runs.sum()) - np.repeat(opened, runs))
    total = np.empty((len(has), 8, 8), np.int64)  # text, byte, bit
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, start).astype("<u8").view(np.uint8).reshape(-1, 8)
        total[:, :, bit] = np.add.reduceat(lanes.astype(np.int64), opened, axis=0)
    bits = (2 * total > n[has][:, None, None]).astype(np.uint8)
    out[has] = np.packbits(bits, axis=2, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint) of every row; text_key: a hash of the text; fingerprint: as a signed 64-bit integer."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                print_of = fingerprints(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(print_of)], ["doc_id", "text_key", "fingerprint"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return own.mapInArrow(made, "doc_id long, text_key long, fingerprint long")


def _forest(hit: np.ndarray):
    """Links (row, column) that join all that ``hit`` joins: itself, or stars if it is dense."""
    i, j = np.nonzero(hit)
    if len(i) <= 2 * sum(hit.shape):
        return i, j
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit = hit[np.ix_(rows, cols)]
    none = len(cols)
    of_col = np.arange(none)
    while True:
        of_row = np.where(hit, of_col, none).min(1)
        nearer = np.minimum(of_col, np.where(hit, of_row[:, None], none).min(0))
        if (nearer == of_col).all():
            break
        of_col = nearer
    # every row hangs on a column of its own group, every column on a row of its group
    row_at = np.full(none, -1)
    row_at[of_row[::-1]] = np.arange(len(rows))[::-1]
    return np.concatenate((rows, rows[row_at[of_col]])), np.concatenate((cols[of_row], cols))


def _thinned(i: np.ndarray, j: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least one of its group, in place of the given links."""
    least = np.arange(nodes)
    while True:
        low = np.minimum(least[i], least[j])
        nearer = least.copy()
        np.minimum.at(nearer, i, low)
        np.minimum.at(nearer, j, low)
        nearer = nearer[nearer]
        if (nearer == least).all():
            break
        least = nearer
    of = np.flatnonzero(least != np.arange(nodes))
    return least[of], of


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int):
    """Links that join all of two tiles which lie at ``radius`` or fewer differing bits, fewer than there are fingerprints."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(a), ROWS):
        hit = np.bitwise_count(a[s : s + ROWS, None] ^ b[None, :]) <= radius
        if hit.any():
            i, j = _forest(hit)
            left.append(s + i)
            right.append(j)
    both = np.concatenate((a, b))
    i, j = _thinned(np.concatenate(left), len(a) + np.concatenate(right), len(both))
    return both[i], both[j]


def tile_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(one, other, left, right): every two tiles that the population counts leave, with their fingerprints.

    Which tiles meet follows from the sizes of the cells of equal counts, at most 33 * 33. Each tile is sent
    once to each pair it is in, so a join key has one row on either side.
    """
    cells = prints.select("fingerprint", F.bit_count(F.shiftrightunsigned("fingerprint", 32)).alias("high"), F.bit_count(F.col("fingerprint").bitwiseAND(0xFFFFFFFF)).alias("low"))
    sizes = cells.groupBy("high", "low").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    before = Window.orderBy("high", "low").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("first", F.coalesce(F.sum("tiles").over(before), F.lit(0))), "cells")
    tile = F.col("first") + F.pmod(F.xxhash64("fingerprint"), F.col("tiles"))
    placed = cells.join(F.broadcast(sizes), ["high", "low"]).select("high", "low", tile.alias("tile"), "fingerprint")
    tiles = stored(placed.groupBy("high", "low", "tile").agg(F.collect_list("fingerprint").alias("prints")), "tiles")
    there = sizes.select(F.col("high").alias("_high"), F.col("low").alias("_low"), F.col("first").alias("_first"), F.col("tiles").alias("_tiles"))
    apart = F.abs(F.col("high") - F.col("_high")) + F.abs(F.col("low") - F.col("_low"))
    meets = sizes.join(F.broadcast(there), apart <= radius).groupBy("high", "low")
    meets = meets.agg(F.collect_list(F.struct(F.col("_first").alias("first"), F.col("_tiles").alias("tiles"))).alias("met"))
    partner = F.explode(F.flatten(F.transform("met", lambda m: F.sequence(m["first"], m["first"] + m["tiles"] - 1))))
    sent = tiles.join(F.broadcast(meets), ["high", "low"]).select("tile", "prints", partner.alias("partner"))
    left = sent.where("partner >= tile").select(F.col("tile").alias("one"), F.col("partner").alias("other"), F.col("prints").alias("left"))
    right = sent.where("partner <= tile").select(F.col("partner").alias("one"), F.col("tile").alias("other"), F.col("prints").alias("right"))
    return left.join(right, ["one", "other"])


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between different fingerprints that join all that lie within the radius of each other."""

    def compared(batches):
        for batch in batches:
            for row in range(len(batch)):
                sides = [batch.column(c)[row].values.to_numpy().view(np.uint64) for c in ("left", "right")]
                a, b = near_pairs(*sides, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return tile_pairs(prints, radius).select("left", "right").mapInArrow(compared, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fingerprint, label, component_id) of every row.

    Texts are lower-cased (A-Z) and cut into words at ASCII blanks; a text of fewer than
    ``shingle`` words is one shingle, a text without words or a null one has fingerprint
    zero and is linked like any other. ``label``: the least fingerprint of the component, its name; ``component_id``: the
    smallest id that links reach, the row's own included; a null id keeps its row and never names a component unless all its
    ids are null. ``text_key``: Spark's XXH64 of the text. Rows that share an id stay apart rows. An empty table gives no rows;
    further columns aren't read.
    """
    own = stored(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    prints = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(prints.select("fingerprint"), radius), "a", "b")
    named = prints.join(labels, prints.fingerprint == labels.node, "left").select("fingerprint", "first_id", F.coalesce("label", "fingerprint").alias("label"))
    groups = stored(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "groups")  # read anew, a large group's rows can be split
    by_print = named.join(groups, "label").select("fingerprint", "label", "component_id")
    return own.join(by_print, "fingerprint").select("doc_id", "text_key", "fingerprint", "label", "component_id")


def deduplicated(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of the smallest id (a null one comes last), of several such rows of the least text hash.

    Of rows that are equal in both, one stays. Any column names may be in ``docs``.
    """
    at, key, number = unused(docs, "kept_id", "kept_text", "number")

    def first_of_each() -> DataFrame:
        found = near_duplicates(docs, radius, shingle, id_col, text_col)
        each = found.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "rows")).alias("k")
        return each.groupBy("label").agg(best).select(F.col("k.doc_id").alias(at), F.col("k.text_key").alias(key), F.col("k.rows").alias("rows"))

    kept = stored_alone(first_of_each, "kept")
    on = F.col(id_col).cast("long").eqNullSafe(F.col(at)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key))
    once = docs.join(kept.where("rows = 1").drop("rows"), on, "inner").drop(at, key)
    several = stored(kept.where("rows > 1").drop("rows"), "several")  # few, as a rule, and then broadcast
    plain = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, AtomicType)]
    order = Window.partitionBy(at, key).orderBy(F.xxhash64(*plain))
    more = docs.join(several, on, "inner").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(at, key, number)
    return once.unionAll(more)
