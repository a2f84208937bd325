"""What the corpus operators share: tokens, let-bindings and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserspark.plans.staging import discard, materialize, shared_dir, shared_path  # noqa: F401

#: White space of the word contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything between the words of the decontamination contract (after lower-casing).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.  ``lower`` agrees with that on pure ASCII and is far faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def plain_words(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and anything outside ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def join_spread(rows: DataFrame, unique: DataFrame, left: str, right: str, n: str, hot: int) -> DataFrame:
    """``rows`` joined to ``unique`` on left = right, though some key may stand on a large part of ``rows``.

    ``unique`` has one row a key, and in ``n`` how many rows of ``rows`` have it (and is read several
    times).  Keys of more than ``hot`` rows, of which there is at most one for each ``hot`` rows, are
    broadcast, and their rows stay where they are.
    """
    crowded = materialize(unique.where(F.col(n) > hot), "crowded")
    same = F.col(left) == F.col(right)
    if crowded.isEmpty():
        return rows.join(unique, same)
    usual = rows.join(F.broadcast(crowded.select(right)), same, "left_anti").join(unique.where(F.col(n) <= hot), same)
    return rows.join(F.broadcast(crowded), same).unionByName(usual)
