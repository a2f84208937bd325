"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive k-grams of words the least hash is kept, for documents and
items alike, so any shared run of ``WINDOW`` words shares a kept hash.  A document keeps with each hash
the places of the windows that it was kept for.  The fingerprints are joined; a hit is extended to the
whole windows that it stands for, each of which is then met, by 128 bits of hash, with the windows of
the items.  So an extension costs what the document's hits hold and never pairs places of a document
with places of an item.  Items shorter than a window are one window each: for their lengths, twelve
at most, documents and items keep every k-gram of that length.

Windows that stand in the same items share the name of that set of items, so a phrase of many items
is spelled out once for each document and not once for each window.

Plans hold DataFrame functions only.  Texts are read three times (fingerprints, extension of the few
candidates, word counts) and never shuffled but for candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesserspark.llm.common import let, materialize, plain_words

WINDOW, GRAM = 13, 7
#: Item fingerprints, item windows, sets and candidates (16 to 100 bytes each) are broadcast up to this many
#: rows, counted first; beyond, both sides are shuffled, and the items' side is repeated for each of SALTS parts.
BROADCAST_ROWS, SALTS = 1_000_000, 16


def _grams(hashes: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, in order, from the hashes of the words."""
    every = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, every).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column, window: int, gram: int) -> Column:
    """(fp, b, e): the least hash of each run of k-grams that a window holds, with the range [b, e) of places of the windows in a row that have it."""
    width = window - gram + 1
    least = F.transform(F.sequence(F.lit(0), F.size(grams) - width), lambda i: F.least(*[F.get(grams, i + k) for k in range(width)]))

    def runs(m: Column) -> Column:
        heads = F.filter(F.transform(m, lambda h, i: F.struct(h.alias("fp"), i.alias("b"))), lambda x: (x["b"] == 0) | (F.get(m, x["b"] - 1) != x["fp"]))
        return let(heads, lambda c: F.transform(c, lambda x, i: F.struct(x["fp"].alias("fp"), x["b"].alias("b"), F.coalesce(F.get(c, i + 1)["b"], F.size(m)).alias("e"))))

    return F.when(F.size(grams) >= width, let(least, runs)).otherwise(F.array().cast(_RUNS))


_RUNS = "array<struct<fp: bigint, b: int, e: int>>"


def _fingerprints(hashes: str, window: int, gram: int, short: list[int]) -> Column:
    """(n, fp, b, e) of a text: a shared window of n words, that begins in [b, e), shares fp."""
    kept = let(_grams(F.col(hashes), gram), lambda g: _winnow(g, window, gram))
    whole = [F.transform(_grams(F.col(hashes), n), lambda h, i: F.struct(h.alias("fp"), i.alias("b"), (i + 1).alias("e"))) for n in short]

    def marked(n: int, runs: Column) -> Column:
        return F.transform(runs, lambda x: F.struct(F.lit(n).alias("n"), x["fp"].alias("fp"), x["b"].alias("b"), x["e"].alias("e")))

    return F.concat(*map(marked, (window, *short), (kept, *whole)))


def _name(hashes: Column, at: Column, n: int) -> Column:
    """(n, w1, w2): 128 bits for the window of n words at a place."""
    words = [F.get(hashes, at + k) for k in range(n)]
    return F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *words).alias("w1"), F.xxhash64(F.lit(-n), *reversed(words)).alias("w2"))


def _hashed(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _items(items: DataFrame) -> DataFrame:
    """item, its words, the hashes of the words and its place among equal ids: one row per item row that has words."""
    split = items.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("iw")).distinct()
    return split.where(F.size("iw") > 0).select("item", "iw", _hashed("iw").alias("ih"))


def _met(many: DataFrame, few: DataFrame, on: list[str], small: int) -> DataFrame:
    """Rows of ``many`` joined to ``few``, whose columns ``on`` are unique or nearly so; a key that very many rows of ``many`` have is spread."""
    if few.count() <= small:
        return many.join(F.broadcast(few), on)
    spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64("key", "mark"), F.lit(SALTS)).cast("int")).join(spread, [*on, "__salt"]).drop("__salt")


def _item_windows(own: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(n, w1, w2, bundle) of every window of the items, and (bundle, content) of the sets of contents that a window stands in."""
    lengths = [r["n"] for r in own.select(F.least(F.size("ih"), F.lit(window)).alias("n")).distinct().orderBy("n").collect()]  # window rows at most
    no = F.array().cast("array<struct<n: int, w1: bigint, w2: bigint>>")

    def names(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size("ih") - n), lambda i: _name(F.col("ih"), i, n))
        return F.when(F.size("ih") >= n if n == window else F.size("ih") == n, every).otherwise(no)

    listed = own.select("ih").distinct().select(F.xxhash64("ih").alias("content"), F.explode(F.concat(no, *map(names, lengths))).alias("w")).select("content", "w.*").distinct()
    listed = materialize(listed, "item-windows")
    bundle = F.xxhash64(F.count(F.lit(1)), F.sum(F.col("content").cast("decimal(20)")), F.bit_xor(F.xxhash64(F.lit(3), "content")))  # of a set, in any order
    windows = materialize(listed.groupBy("n", "w1", "w2").agg(bundle.alias("bundle")), "windows")
    return windows, materialize(listed.join(windows, ["n", "w1", "w2"]).select("bundle", "content").distinct(), "bundles")


def contaminations(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, small: int = BROADCAST_ROWS) -> DataFrame:
    """key, mark, n_hit, item_ids (sorted) and runs [b, e) of each distinct (doc_id, text) that holds a window of an item.

    ``mark`` is the xxhash64 of the text; equal rows share one result.
    """
    own = materialize(_items(items), "items")
    windows, bundles = _item_windows(own, window)
    short = [r["n"] for r in windows.where(F.col("n") < window).select("n").distinct().orderBy("n").collect()]  # window - 1 rows at most
    prints = own.select("ih").distinct().select(F.size("ih").alias("size"), F.explode(_fingerprints("ih", window, gram, short)).alias("x"))
    item_prints = materialize(prints.where((F.col("x")["n"] == window) | (F.col("x")["n"] == F.col("size"))).select("x.n", "x.fp").distinct(), "fingerprints")

    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    hashed = rows.select("key", "mark", _hashed(plain_words(F.col("text"))).alias("dh"))
    kept = hashed.select("key", "mark", F.explode(_fingerprints("dh", window, gram, short)).alias("x")).select("key", "mark", "x.*")
    hits = _met(kept, item_prints, ["n", "fp"], small).select("key", "mark", "n", "b", "e").distinct()
    candidates = materialize(hits.groupBy("key", "mark").agg(F.collect_list(F.struct("n", "b", "e")).alias("spans")), "candidates")

    # the candidates' words, once more: the windows that their hits stand for
    wanted = candidates.select(F.col("key").alias("ckey"), F.col("mark").alias("cmark"), "spans")
    wanted = F.broadcast(wanted) if candidates.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0] <= small else wanted  # then the texts stay where they are read
    matched = rows.join(wanted, F.col("key").eqNullSafe(F.col("ckey")) & (F.col("mark") == F.col("cmark"))).select("key", "mark", "spans", _hashed(plain_words(F.col("text"))).alias("dh"))

    def spelled_out(n: int) -> Column:
        places = F.array_distinct(F.flatten(F.transform(F.filter("spans", lambda x: x["n"] == n), lambda x: F.sequence(x["b"], x["e"] - 1))))
        return F.transform(places, lambda p: F.struct(p.alias("p"), _name(F.col("dh"), p, n).alias("w")))

    spelled = matched.select("key", "mark", F.explode(F.concat(*map(spelled_out, (window, *short)))).alias("x")).select("key", "mark", "x.p", "x.w.*").distinct()
    found = materialize(_met(spelled, windows, ["n", "w1", "w2"], small).select("key", "mark", "p", "n", "bundle"), "found")
    by_doc = found.groupBy("key", "mark").agg(F.collect_set(F.struct("p", "n")).alias("windows"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["p"], x["p"] + x["n"] - 1)))))

    def runs(places: Column) -> Column:
        begins = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1) != p - 1))
        ends = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != p + 1))
        return F.arrays_zip(begins.alias("b"), F.transform(ends, lambda p: p + 1).alias("e"))

    spans = by_doc.select("key", "mark", let(hit, lambda h: F.struct(F.size(h).cast("long").alias("n_hit"), runs(h).alias("runs"))).alias("x")).select("key", "mark", "x.*")
    contents = _met(found.select("key", "mark", "bundle").distinct(), bundles, ["bundle"], small).select("key", "mark", "content").distinct()
    listed = _met(contents, own.select(F.xxhash64("ih").alias("content"), "item"), ["content"], small)
    ids = listed.groupBy("key", "mark").agg(F.array_sort(F.collect_set("item")).alias("item_ids")).select(F.col("key").alias("ikey"), F.col("mark").alias("imark"), "item_ids")
    joined = spans.join(ids, F.col("key").eqNullSafe(F.col("ikey")) & (F.col("mark") == F.col("imark")), "left")
    return joined.select("key", "mark", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "runs")


def _against(hit: Column, total: Column) -> Column:
    return (hit > 0) & (20 * hit >= total)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, small: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    Null and empty texts have no words and no hits; an item without words has no window; items of
    equal id count once and a null item_id is not listed (its words still count as hit).  Repeated
    rows each get their own equal result; texts of any length are read whole; windows that several
    items share count for each of them; empty tables give no rows, or rows without hits; other
    columns are ignored.
    """
    found = materialize(contaminations(docs, items, window, gram, small).select(F.col("key").alias("fkey"), F.col("mark").alias("fmark"), "n_hit", "item_ids"), "hits")
    counted = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("fkey")) & (F.col("mark") == F.col("fmark")), "left")
    hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        _against(hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    Null and empty texts stay, repeated rows stay or go together, and empty tables of documents or
    items are as in ``decontaminate``.
    """
    columns = docs.columns
    found = contaminations(docs, items, window, gram)
    found = materialize(found.select(F.col("key").alias("__fkey"), F.col("mark").alias("__fmark"), F.col("n_hit").alias("__hit")), "hits")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__carry_{k}") for k, c in enumerate(columns)], F.col("doc_id").alias("__key"), F.xxhash64("text").alias("__mark"), F.col("text").alias("__text"))
    joined = rows.join(found, F.col("__key").eqNullSafe(F.col("__fkey")) & (F.col("__mark") == F.col("__fmark")), "left")
    bad = F.when(F.col("__hit").isNotNull(), _against(F.col("__hit"), F.size(plain_words(F.col("__text"))))).otherwise(False)
    return joined.where(~bad).select(*[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(columns)])
