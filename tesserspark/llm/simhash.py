"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed once, then equal ones are merged, so copies cost nothing further.  Two
fingerprints that differ in at most two bits agree on one of three blocks of bits: the distinct
fingerprints are dealt by (block, its value), three rows each, and each such bucket is a subtrie in
which pairs of nodes are walked down together, bit by bit.  A pair carries the number of bits in
which its two prefixes differ and is dropped beyond the budget, and also when both nodes already lie
in one component, so a dense group costs little more than its size.  A bucket emits a forest of its
links, never all pairs.

Buckets of over ``hot`` fingerprints are dealt again by a third of the bits left (the same argument
holds below a node), twice at most; then 45 bits or more are fixed and no bucket can hold more than
2**20 distinct fingerprints.  Components of the links come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tesserspark.llm.common import discard, join_spread, materialize

SHINGLE, BUDGET, HOT = 3, 2, 100_000
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the hashes of all word shingles, repeats included."""
    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    parts = [b" ".join(x) for x in zip(*[w[k:] for k in range(shingle)])] if len(w) >= shingle else [b" ".join(w)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(parts), 1 << 16):
        h = np.fromiter(map(_hash, parts[k : k + (1 << 16)]), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(parts), bitorder="little").view(np.uint64)[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """key, mark (xxhash64 of the text) and fp of every row; a null or blank text has fingerprint 0."""
    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("fp", "long")
    return rows.mapInArrow(_fingerprinted, schema)


def trie_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET, block: int = 250_000) -> np.ndarray:
    """A label for each of ``values``: the first index that it is linked to, over chains of links within its bucket.

    Buckets are [starts, ends); values are distinct and ascending within each, so every trie node is a range.
    """
    n = len(values)
    label = np.arange(n)
    changes = np.arange(n)  # number of label changes up to here: a range has one label if its ends agree
    some = ends - starts > 1
    lo, hi = starts[some], ends[some]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
    ones: dict[int, np.ndarray] = {}

    def rank(bit: int) -> np.ndarray:
        if bit not in ones:
            if len(ones) >= 16:
                ones.clear()
            ones[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)).astype(np.int64) & 1)))
        return ones[bit]

    while stack:
        bit, a, b, c, d, e = stack.pop()
        if len(a) > block:
            half = len(a) // 2
            stack += [(bit, *(x[:half] for x in (a, b, c, d, e))), (bit, *(x[half:] for x in (a, b, c, d, e)))]
            continue
        joined = (label[a] == label[c]) & (changes[a] == changes[b - 1]) & (changes[c] == changes[d - 1])
        if joined.any():
            a, b, c, d, e = (x[~joined] for x in (a, b, c, d, e))
        if not len(a):
            continue
        if bit < 0:  # ranges of one value each
            label = _merged(label, a, c)
            changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            continue
        r = rank(bit)
        m, k = b - (r[b] - r[a]), d - (r[d] - r[c])  # first value of either node with the bit set
        same = a == c
        children = [(a, m, c, k, e), (m, b, k, d, e), (a, m, k, d, e + 1), (m[~same], b[~same], c[~same], k[~same], e[~same] + 1)]
        parts = []
        for w, x, y, z, f in children:
            ok = (w < x) & (y < z) & (f <= budget) & ~((w == y) & (x - w == 1))
            parts.append([v[ok] for v in (w, x, y, z, f)])
        stack.append((bit - 1, *(np.concatenate(v) for v in zip(*parts))))
    return label


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: least labels, spread until nothing changes."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _bucket_links(batches: Iterator[pa.RecordBatch], budget: int = BUDGET, chunk: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Links of buckets whose rows (mask, key, fp) come sorted; works on whole buckets, about ``chunk`` rows at a time."""
    held = [np.empty(0, np.int64)] * 3

    def links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fp))
        group = np.cumsum(new)
        order = np.lexsort((fp.view(np.uint64), group))
        values = fp[order].view(np.uint64)
        label = trie_links(values, starts, ends, budget)
        far = np.flatnonzero(label != np.arange(len(label)))
        v = values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(v[far]), pa.array(v[label[far]])], names=["a", "b"])

    for batch in batches:
        held = [np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
        if len(held[0]) >= chunk:
            edge = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(edge):
                cut = edge[-1] + 1
                yield links(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield links(*held)


def _masks(free: list[int], parts: int = BUDGET + 1) -> list[tuple[int, list[int]]]:
    """The free bits dealt into blocks: (mask of the block, free bits left)."""
    blocks = [list(x) for x in np.array_split(np.array(free), parts)]
    return [(sum(1 << int(i) for i in block), [i for i in free if i not in set(map(int, block))]) for block in blocks]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(distinct: DataFrame, hot: int = HOT, levels: int = 3) -> DataFrame:
    """(a, b): a forest of the links between the distinct fingerprints, column fp."""
    level = [(mask, rest) for mask, rest in _masks(list(range(64)))]
    masks = F.array(*[F.lit(_signed(m)) for m, _ in level])
    rows = distinct.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    done = []
    for depth in range(1, levels + 1):
        if depth == levels:
            done.append(rows)
            break
        crowded = materialize(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("mask").alias("hmask"), F.col("key").alias("hkey")), "hot")
        if crowded.isEmpty():
            done.append(rows)
            break
        is_hot = (F.col("mask") == F.col("hmask")) & (F.col("key") == F.col("hkey"))
        done.append(rows.join(crowded, is_hot, "left_anti"))
        deeper = [(m, m | sub, left) for m, rest in level for sub, left in _masks(rest)]
        choice = F.array().cast("array<bigint>")
        for m, _ in level:
            choice = F.when(F.col("mask") == F.lit(_signed(m)), F.array(*[F.lit(_signed(t)) for o, t, _ in deeper if o == m])).otherwise(choice)
        again = rows.join(crowded, is_hot, "left_semi").select("fp", F.explode(choice).alias("mask"))
        rows = again.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()
        level = [(t, left) for _, t, left in deeper]
    found = [r.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_bucket_links, "a long, b long") for r in done]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) for every node of an edge: alternating large-star and small-star rounds, each written to the shared folder.

    No step gathers a node's neighbours; they only meet as partial minima and as rows of a join, in
    which the edges of a node with more than ``hot`` stay where they are.
    """

    def signed(df: DataFrame) -> tuple:
        one, other = F.xxhash64("a", "b"), F.xxhash64("b", F.lit(1), "a")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(20)")), F.bit_xor(other)).first())

    def star(df: DataFrame, large: bool, edges_now: int) -> DataFrame:
        both = df.union(df.select("b", "a")) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "n")
        joined = both.join(least, F.col("a") == F.col("n")) if 2 * edges_now <= hot else join_spread(both, least, "a", "n", "degree", hot)
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        return out.where(F.col("a") != F.col("b")).distinct()

    now = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")), "edges")
    sign, same = signed(now), False
    while not same:
        half = star(now, True, sign[0])
        half = materialize(half, "edges") if 2 * sign[0] > hot else half  # read several times if nodes are crowded
        then = materialize(star(half, False, sign[0]), "edges")
        was, sign = sign, signed(then)
        same = sign == was and then.join(now, ["a", "b"], "left_anti").isEmpty()  # equal sums may be chance; equal tables are not
        discard(now)
        now = then
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def headed(rows: DataFrame, edges: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(cfp, head, copies): first (key, mark) of the component of each fp of ``rows``, by ``edges`` or else by links of fingerprints, and how many rows have the fp."""
    # rows without a key come last, so they stand for a component only if no row has one
    first = F.min(F.struct(F.col("key").isNull().alias("void"), "key", "mark"))
    classes = materialize(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    roots = components(links(classes.select("fp"), hot) if edges is None else edges, hot)
    member = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    heads = member.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("members"))
    return materialize(join_spread(member, heads, "root", "r", "members", hot).select(F.col("fp").alias("cfp"), "head", "copies"), "heads")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    A null or blank text has fingerprint zero, linked like any other.  Repeated rows each get their
    own equal result; a component of rows without doc_id has a null component_id; an empty table
    gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    heads = headed(rows, hot=hot)
    return join_spread(rows, heads, "fp", "cfp", "copies", hot).select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head")["key"].alias("component_id"))


def one_of_each(docs: DataFrame, hot: int = HOT, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each component, that of the least doc_id, with all columns, whatever their names.

    Null and blank texts are copies of each other, as in ``near_duplicates``; of repeated rows one
    stays; texts of any length count whole; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    return keep_heads(docs, rows, headed(rows, hot=hot), broadcast_rows, hot)


def keep_heads(docs: DataFrame, rows: DataFrame, heads: DataFrame, broadcast_rows: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """The first row of each component, with all columns.

    The rows that go, and the few keys that stand on several rows, are counted; up to
    ``broadcast_rows`` they are broadcast and the texts stay where they are, beyond they are shuffled.
    """
    columns = docs.columns
    keyed = join_spread(rows.groupBy("key", "mark", "fp").agg(F.count(F.lit(1)).alias("n")), heads, "fp", "cfp", "copies", hot)
    head = (F.col("key").eqNullSafe(F.col("head")["key"])) & (F.col("mark") == F.col("head")["mark"])
    marked = keyed.select(F.col("key").alias("__key"), F.col("mark").alias("__mark"), F.when(~head, "drop").when(F.col("n") > 1, "several").alias("__what"))
    some = materialize(marked.where("__what is not null"), "dropped")
    some = F.broadcast(some) if some.count() <= broadcast_rows else some
    every = docs.select(*[F.col(f"`{c}`").alias(f"__carry_{k}") for k, c in enumerate(columns)], F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__own"))
    joined = every.join(some, F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__mark")), "left")
    single = joined.where("__what is null")
    kept = single.unionByName(joined.where("__what = 'several'").dropDuplicates(["__id", "__own"]))
    return kept.select(*[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(columns)])
