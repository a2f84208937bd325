"""Near copies: word shingles with Jaccard similarity of 0.8 or more; a part of the near-duplicate stage.

Bits of a SimHash do not reach this similarity (pairs at 0.8 differ in up to 14 bits), so texts that
may be similar are found by MinHash: 40 bands of 7 values, of which two texts of similarity 0.8 share
one but for a chance of 8 in 100,000, and more similar ones but for less.  The bands only deal texts
into candidate groups; what links two texts is the exact similarity of their shingle sets.  A group
is compared pair by pair in blocks of about ``chunk`` texts against as many, so a large group is
spread over tasks; nothing is dropped from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from tesserspark.llm.common import join_spread, materialize
from tesserspark.llm.simhash import HOT, _hash, components, headed, keep_heads

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 7


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a shorter text is one shingle, a blank one has none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    parts = {b" ".join(x) for x in zip(*[w[k:] for k in range(size)])} if len(w) >= size else {b" ".join(w)}
    return np.unique(np.fromiter(map(_hash, parts), np.uint64, len(parts)))


def band_keys(hashes: np.ndarray, block: int = 2048) -> list[int]:
    """One key a band, of its least hashes under fixed multiplications; none for no hashes."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(11)
    times = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), block):
        np.minimum(low, (hashes[k : k + block, None] * times).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(v.tobytes(), seed=k) for k, v in enumerate(low.reshape(BANDS, ROWS))]


def similar(sets: list[np.ndarray], side: list[int], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """A forest of the links between sets of Jaccard similarity ``least`` or more; if there are two sides, of links across them."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owners = owner[np.argsort(ids, kind="stable")]
    many = np.bincount(ids)
    first = np.cumsum(many) - many
    begin = np.cumsum(sizes) - sizes
    sides = np.array(side)
    across = len(set(side)) > 1
    label = np.arange(len(sets))
    out = []
    for a in range(len(sets)):
        mine = ids[begin[a] : begin[a] + sizes[a]]
        n = many[mine]
        places = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owners[places], minlength=len(sets))
        near = common >= least * (sizes + sizes[a] - common)
        near[: a + 1] = False
        if across:
            near &= sides != sides[a]
        for b in np.flatnonzero(near):
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                out.append((a, int(b)))
    return out


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.array(band_keys(shingles(t.as_py() or b"", shingle)), np.uint64).view(np.int64) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["key", "mark", "bands"])

    return run


def _block_links(shingle: int, similarity: float):
    """Links of blocks whose rows (root, i, j, part, mark, text) come sorted; a text that comes again counts once."""

    def links(marks: list[int], sets: list[np.ndarray], side: list[int]) -> pa.RecordBatch:
        found = similar(sets, side, similarity)
        return pa.RecordBatch.from_arrays([pa.array([marks[a] for a, _ in found], pa.int64()), pa.array([marks[b] for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, marks, sets, side = None, [], [], []
        for batch in batches:
            root, i, j, part, mark = (batch.column(k).to_pylist() for k in range(5))
            texts = batch.column(5).cast(pa.large_binary())
            for k in range(batch.num_rows):
                if (root[k], i[k], j[k]) != now:
                    if len(sets) > 1:
                        yield links(marks, sets, side)
                    now, marks, sets, side = (root[k], i[k], j[k]), [], [], []
                if not marks or marks[-1] != mark[k]:
                    marks.append(mark[k])
                    sets.append(shingles(texts[k].as_py(), shingle))
                    side.append(part[k])
        if len(sets) > 1:
            yield links(marks, sets, side)

    return run


def links(docs: DataFrame, sketches: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = 250, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(a, b): links between the marks of texts of the given similarity; they make its components."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    banded = sketches.select("mark", F.explode("bands").alias("band"))
    crowded = banded.groupBy(F.col("band").alias("cband")).agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where(F.col("least") < F.col("most"))
    crowded = materialize(crowded.select("cband", "least"), "crowded")
    met = banded.join(small(crowded), F.col("band") == F.col("cband")).where(F.col("mark") != F.col("least"))
    groups = materialize(components(met.select(F.col("mark").alias("a"), F.col("least").alias("b")).distinct()), "groups")
    parts = groups.groupBy(F.col("root").alias("r")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"), F.count(F.lit(1)).alias("members"))
    dealt = join_spread(groups, parts, "root", "r", "members", HOT).select("node", "root", "parts", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    # if there are several parts, one is compared with itself in a block of its own
    dealt = dealt.select("node", "root", "part", other).select("node", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dealt = materialize(dealt, "dealt")
    texts = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    rows = texts.join(small(dealt), F.col("mark") == F.col("node")).select("root", "i", "j", "part", "mark", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "mark")
    return rows.mapInArrow(_block_links(shingle, similarity), "a long, b long").distinct()


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = 250) -> DataFrame:
    """One row of each component of near copies, that of the least doc_id, with all columns.

    Equal texts are copies of each other; blank texts that differ are not.  Rows without doc_id stand
    for a component only if no row has one; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("bands", ArrayType(LongType()))
    sketches = materialize(rows.mapInArrow(_sketched(shingle), schema), "sketches")
    marked = sketches.select("key", "mark", F.col("mark").alias("fp"))
    return keep_heads(docs, marked, headed(marked, links(docs, sketches, shingle, similarity, chunk)))
