"""Quality rules: repetition and length rules, then distribution divergence.

The verdict compares each document with a reference of its language by the Jensen-Shannon
distance (base 2, so between 0 and 1) of two histograms: character classes, and the common words
of the language with all other words as one more class.  A document shorter than the guards is
not judged by them.  Everything is a DataFrame expression over one row; the only aggregate is the
reference, of one row per known language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tesserspark.llm.common import let, materialize, words

#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los"],
}
#: Character classes, each with the Java pattern that keeps nothing else; the rest, mostly a-z, is counted by difference.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": r"[^#*$%&|<>]+", "point": r"[^!\"'()+,\-./:;=?@\[\\\]^_`{}~]+", "wide": r"[\x00-\x7F]+"}
BINS = [*CLASSES, "other"]
OTHER = "other"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; ``min_chars`` and ``min_words`` guard the two divergence tests.

    A short text is far from any reference by chance alone, so the distance of common words may be
    ``short_allowance`` over the number of words more.
    """

    min_document_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_chars: int = 200
    min_words: int = 60
    short_allowance: float = 0.9
    max_char_distance: float = 0.28
    max_word_distance: float = 0.25
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two distributions, given as arrays; empty bins add nothing."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v) / 2, F.lit(0.0)))


def _window_hashes(hashes: Column, window: int) -> Column:
    """Hash of every window, in order, from the hashes of the words.  (``slice`` would copy the whole array for each.)"""
    every = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
    return F.when(F.size(hashes) >= window, every).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words inside windows found twice or more, from the hashes of all windows in order."""

    def covered(found: Column) -> Column:
        places = F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(1), F.size(found)),
                    lambda i: ((i > 1) & (F.get(found, i - 1)["h"] == F.get(found, i - 2)["h"])) | ((i < F.size(found)) & (F.get(found, i - 1)["h"] == F.get(found, i)["h"])),
                ),
                lambda i: F.get(found, i - 1)["i"],
            )
        )
        return let(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(window), lambda acc, j: acc + F.least(F.lit(window), F.get(p, j) - F.get(p, j - 1))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, covered)).cast("long")


def _those_in(tokens: Column, listed: list[str]) -> Column:
    return F.filter(tokens, lambda w: w.isin(listed))


def _count_of(tokens: str, word: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: w == word)).cast("long")


def _counts(text: Column, tokens: Column, language: Column, rules: QualityRules) -> list[Column]:
    """Histogram columns: char_<class> and word_<rank>, the latter for the document's language."""
    out = [F.length(F.regexp_replace(text, drop, "")).cast("long").alias(f"char_{name}") for name, drop in CLASSES.items()]
    hits = F.array().cast("array<string>")
    for code, listed in rules.common_words.items():
        hits = F.when(language == code, _those_in(tokens, listed)).otherwise(hits)
    return [*out, hits.alias("hits")]


def _features(docs: DataFrame, rules: QualityRules, repeats: bool, carry: list[Column]) -> DataFrame:
    """Per row: ``carry``, the contract's counts and the histograms.  Row order and multiplicity stay."""
    known = list(rules.common_words)
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.when(F.col("lang").isin(known), F.col("lang")).otherwise(OTHER) if "lang" in docs.columns else F.lit(OTHER)
    one = docs.select(*carry, text.alias("__text"), lang.alias("__lang"), words(F.col("text")).alias("__words"))
    two = one.select(
        *[c for c in one.columns if c not in ("__text", "__words")],
        F.size("__words").cast("long").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("__chars"),
        *_counts(F.col("__text"), F.col("__words"), F.col("__lang"), rules),
        *(
            [
                F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
                F.transform("__words", lambda w: F.xxhash64(w))
                .alias("__hashes"),
            ]
            if repeats
            else []
        ),
    )
    ranks = len(next(iter(rules.common_words.values())))
    extra = [_window_hashes(F.col("__hashes"), rules.window).alias("__windows"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup")] if repeats else []
    keep = [c for c in two.columns if c not in ("hits", "__lines", "__hashes")]
    ranked = []
    for j in range(ranks):
        count = F.lit(0).cast("long")
        for code, listed in rules.common_words.items():
            count = F.when(F.col("__lang") == code, _count_of("hits", F.lit(listed[j]))).otherwise(count)
        ranked.append(count.alias(f"word_{j}"))
    three = two.select(*keep, *ranked, *extra)
    return three.select(*[c for c in three.columns if c != "__windows"], _repeat_words(F.col("__windows"), rules.window).alias("__repeat")) if repeats else three


def _totals(rules: QualityRules) -> tuple[list[str], list[str]]:
    return [f"char_{b}" for b in CLASSES], [f"word_{j}" for j in range(len(next(iter(rules.common_words.values()))))]


def _references(features: DataFrame, rules: QualityRules) -> DataFrame:
    chars, ranks = _totals(rules)
    enough = (F.col("__chars") >= rules.min_chars) & (F.col("__n") >= rules.min_words)
    sums = [F.sum(c).alias(c) for c in (*chars, *ranks)]
    return features.where(enough).groupBy(F.col("__lang").alias("lang")).agg(F.sum("__chars").alias("chars"), F.sum("__n").alias("words"), *sums)


def language_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per known language: summed histograms of all its documents that reach the guards."""
    return _references(materialize(_features(docs, rules, False, []), "features"), rules)


def _shares(counts: list[int], total: int) -> list[float]:
    """The reference's distribution: the given classes and the rest."""
    whole = max(1, total)
    return [*(c / whole for c in counts), (total - sum(counts)) / whole]


def _distances(rules: QualityRules, references: list) -> tuple[Column, Column]:
    """Distances of a row's histograms from its language's reference; of an unknown language, from the nearest."""
    chars, ranks = _totals(rules)

    def own(names: list[str], total: str) -> Column:
        rest = F.col(total) - sum((F.col(n) for n in names[1:]), F.col(names[0]))
        return F.transform(F.array(*names, rest), lambda c: c / F.greatest(F.col(total), F.lit(1)))

    def held(row, names: list[str], total: str) -> Column:
        return F.array(*[F.lit(x) for x in _shares([int(row[n]) for n in names], int(row[total]))])

    known = sorted((r for r in references if r["lang"] != OTHER and r["words"]), key=lambda r: r["lang"])
    if not known:
        return F.lit(0.0), F.lit(0.0)

    def against(names: list[str], own_total: str, total: str, of_unknown: Column) -> Column:
        is_known = F.col("__lang").isin([r["lang"] for r in known])
        reference = F.array().cast("array<double>")
        for r in known:
            reference = F.when(F.col("__lang") == r["lang"], held(r, names, total)).otherwise(reference)
        return F.when(is_known, js_distance(own(names, own_total), reference)).otherwise(of_unknown)

    every = F.array(*[held(r, chars, "chars") for r in known])
    nearest = F.array_min(F.transform(every, lambda r: js_distance(own(chars, "__chars"), r)))
    lacking = F.when(F.col("__lang") == OTHER, nearest).otherwise(0.0)
    return against(chars, "__chars", "chars", lacking), against(ranks, "__n", "words", F.lit(0.0))


def _judged(docs: DataFrame, rules: QualityRules, references: DataFrame | None, carry: list[str]) -> DataFrame:
    """Features, distances and verdict of every row; the carried columns are named ``__carry_<k>``.

    The features are written once, so the texts are read and split once for references and verdict.
    """
    f = materialize(_features(docs, rules, True, [F.col(f"`{c}`").alias(f"__carry_{k}") for k, c in enumerate(carry)]), "features")
    found = (_references(f, rules) if references is None else references).collect()  # one row per known language
    char, word = _distances(rules, found)
    failed = (F.col("__n") < rules.min_document_words) | (100 * F.col("__repeat") > rules.max_repeat_percent * F.col("__n"))
    odd = ((F.col("__chars") >= rules.min_chars) & (F.col("__dc") > rules.max_char_distance)) | ((F.col("__n") >= rules.min_words) & (F.col("__dw") > rules.max_word_distance + rules.short_allowance / F.col("__n")))
    return f.select("*", char.alias("__dc"), word.alias("__dw"), failed.alias("__failed")).select("*", (~F.col("__failed") & ~odd).alias("__kept"))


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), references: DataFrame | None = None) -> DataFrame:
    """Counts and verdict of every document.

    Null and empty texts have no words and fail the base rules.  A null or unlisted ``lang`` (or a
    table without that column) is held against the nearest known reference by characters, and not
    by common words; a language without a reference row counts as near.  Repeated rows each get
    their own equal result, texts of any length count whole, an empty table gives no rows, and other
    columns are ignored; a distance at a threshold passes.
    ``references`` is a table as ``language_references`` returns; by default that of ``docs`` itself.
    """
    return _judged(docs, rules, references, ["doc_id"]).select(
        F.col("__carry_0").alias("doc_id"),
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("char_symbol").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.col("__dc").alias("char_distance"),
        F.col("__dw").alias("word_distance"),
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), references: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names; no join and no shuffle.

    Null and empty texts go, repeated rows stay or go together, and an empty table stays empty.
    """
    judged = _judged(docs, rules, references, docs.columns)
    return judged.where("__kept").select(*[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(docs.columns)])
