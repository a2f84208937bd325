"""Mixing sources to target weights by capped water-filling.

Targets: every source gets min(cap * size, level * weight) with the one level at which the targets
sum to the budget.  Sampling: a document is taken floor(rate) whole times, and the fraction left of
the rate is met by taking every (1/fraction)-th document once more, in order of size within a cell
of the source.  Neighbours in that order have nearly the same size, so a cell misses its share by
less than its largest document.  What the documents above the source's mean size miss is then met by
the others, whose rate is corrected for it, so a source misses its target by a few small documents.
Cells hold about ``cell_rows`` documents each, so a source with a third of all rows is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserspark.llm.common import join_spread, materialize, words

WEIGHTS, CELL_ROWS = (1.0, 2.0, 3.0), 1_000
#: Sources, and documents with their copies, are broadcast up to this many rows, counted first; beyond, a source of more than HOT rows stays where it is.
BROADCAST_ROWS, HOT = 1_000_000, 100_000


def _by_source(rows: DataFrame, table: DataFrame, broadcast_rows: int, hot: int) -> DataFrame:
    """``rows`` joined on source to ``table``, one row a source, with how many rows each has in source_rows; the sources of ``table`` come as __source."""
    keyed = table.withColumn("__skey", _source_key()).withColumnRenamed("source", "__source")
    if table.count() <= broadcast_rows:
        return rows.withColumn("__key", _source_key()).join(F.broadcast(keyed), F.col("__key") == F.col("__skey")).drop("__key", "__skey")
    return join_spread(rows.withColumn("__key", _source_key()), keyed, "__key", "__skey", "source_rows", hot).drop("__key", "__skey")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, budget: float | None = None) -> DataFrame:
    """source, source_size, source_rows, target of a table (source, size), one row per source.

    Weights go round over the sources in code-point order, null last.  The two windows run over one
    row per source, after the aggregation.  By default the budget is the sum of all sizes.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("top", cap * F.col("source_size"))
    every = Window.partitionBy()
    # in order of top / w the capped sources are a prefix; the level after k capped ones is what they leave, over the weight left
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("source_size").over(every).cast("double") if budget is None else F.lit(float(budget))
    spent, gone = F.coalesce(F.sum("top").over(order), F.lit(0.0)), F.coalesce(F.sum("w").over(order), F.lit(0.0))
    levels = weighted.withColumn("level", (whole - spent) / (F.sum("w").over(every) - gone))
    capped = levels.withColumn("fits", F.col("top") >= F.col("level") * F.col("w"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("top") / F.col("w"), "level"))).over(every)["level"]
    target = F.least(F.col("top"), F.coalesce(level * F.col("w"), F.col("top")))
    return capped.withColumn("target", target).select("source", "source_size", "source_rows", "target")


def _decided(keyed: DataFrame, seed: str, cell_rows: int, weights: tuple[float, ...], cap: float, broadcast_rows: int, hot: int) -> DataFrame:
    """Adds source_size, target and copies to rows (id, source, size, mark); equal rows decide alike."""
    targets = materialize(source_targets(keyed.select("source", "size"), weights, cap), "targets")
    rows = _by_source(keyed, targets, broadcast_rows, hot)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    luck = F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.col("size").cast("string")))
    cells = F.ceil(F.col("source_rows") / cell_rows)
    dealt = rows.withColumn("__rate", rate).withColumn("__luck", luck).withColumn("__cell", F.pmod(F.conv(F.substring("__luck", 1, 8), 16, 10).cast("long"), cells))
    place = F.rank().over(Window.partitionBy("__source", "__cell").orderBy("size", "__luck", "id", "mark")) - 1
    large = F.col("size") * F.col("source_rows") > F.col("source_size")
    ranked = materialize(dealt.withColumn("__place", place).withColumn("__large", large).select("id", "source", "size", "mark", "source_size", "target", "source_rows", "__rate", "__place", "__large"), "ranked")

    def extra(fraction: Column) -> Column:
        return F.floor((F.col("__place") + 1) * fraction + 0.5) - F.floor(F.col("__place") * fraction + 0.5)

    whole, fraction = F.floor("__rate"), F.col("__rate") - F.floor("__rate")
    of_large = F.coalesce(F.sum(F.when(F.col("__large"), extra(fraction) * F.col("size"))), F.lit(0))
    of_small = F.sum(F.when(~F.col("__large"), F.col("size")).otherwise(0))
    left = F.col("target") - F.sum(whole * F.col("size")) - of_large
    corrected = F.when(of_small > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / of_small))).otherwise(0.0)
    rates = ranked.groupBy("source", "target", "source_rows").agg(corrected.alias("__small_rate")).select("source", "__small_rate", "source_rows")  # one row per source
    rates = materialize(rates, "rates")
    copies = whole + F.when(fraction == 0, 0).when(F.col("__large"), extra(fraction)).otherwise(extra(F.col("__small_rate")))
    return _by_source(ranked.drop("source_rows"), rates, broadcast_rows, hot).withColumn("copies", copies.cast("long")).select("id", "source", "size", "mark", "source_size", "target", "copies")


def _keyed(docs: DataFrame) -> DataFrame:
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("id"), source.alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("mark"))


def mix(docs: DataFrame, seed: str = "mix", cell_rows: int = CELL_ROWS, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    A null text has size 0; a null source is one of the sources, the last.  A source of size 0 has
    target 0.  Repeated rows decide alike; an empty table gives no rows; other columns are ignored.
    A document is taken whole or not at all in each round, so ``taken`` is a multiple of ``size``; ties
    of size go by a seeded hash, and texts of any length count whole.
    """
    keyed = materialize(_keyed(docs), "sizes")
    out = _decided(keyed, seed, cell_rows, weights, cap, broadcast_rows, hot)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", cell_rows: int = CELL_ROWS, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, whatever their names.

    A document without words is drawn like the others of its source, and those of a source of size 0
    are not; null ids and sources, repeated rows and an empty table are as in ``mix``.
    """
    columns = docs.columns
    keyed = materialize(_keyed(docs), "sizes")
    chosen = _decided(keyed, seed, cell_rows, weights, cap, broadcast_rows, hot).where("copies > 0").groupBy(F.col("id").alias("__id"), F.col("source").alias("__src"), F.col("mark").alias("__mark")).agg(F.max("copies").alias("__copies"))
    source: Column = F.col("source").cast("string") if "source" in columns else F.lit(None).cast("string")
    marked = docs.select(*[F.col(f"`{c}`").alias(f"__carry_{k}") for k, c in enumerate(columns)], F.col("doc_id").alias("__id0"), source.alias("__src0"), F.xxhash64("text").alias("__mark0"))
    chosen = materialize(chosen, "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen  # then the texts stay where they are read
    joined = marked.join(chosen, F.col("__id0").eqNullSafe(F.col("__id")) & (F.col("__mark0") == F.col("__mark")) & F.col("__src0").eqNullSafe(F.col("__src")))
    repeated = joined.withColumn("__round", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(columns)])
