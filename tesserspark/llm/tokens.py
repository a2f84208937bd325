"""Token counts without token ids.

Pieces are counted once per distinct pre-token of the whole corpus.  A document's count is the sum,
over its pre-tokens, of frequency times pieces.  The most frequent pre-tokens (``head``, a fixed
number, so a broadcast of bounded size) are summed where the document is read; the frequencies of the
others are shuffled to their pre-token, so no task and no driver ever holds the whole vocabulary, and
a very common pre-token is never a join key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tesserspark.llm.common import materialize

TOKENIZER, LIMIT, HEAD = "byte_bpe_50k.json", 1024, 250_000
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(name: str) -> Tokenizer:
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _splitters(name: str) -> tuple:
    """The pre-token pattern and, if the tokenizer has any, the pattern of its added strings, which are tokens of their own."""
    added = [t.content for t in _tokenizer(name).get_added_tokens_decoder().values()]
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return regex.compile(PATTERN), special, added


def pretokens(text: str, name: str = TOKENIZER) -> list[str]:
    word, special, added = _splitters(name)
    if special is None or not any(a in text for a in added):
        return word.findall(text)
    out: list[str] = []
    for k, part in enumerate(special.split(text)):
        out += [part] if k % 2 else word.findall(part)
    return out


def pieces(distinct: list[str], name: str = TOKENIZER) -> list[int]:
    return [len(e.ids) for e in _tokenizer(name).encode_batch(distinct, add_special_tokens=False)]


def _partition_counts(name: str, flush: int = 2_000_000):
    """(pre, n) of each task; the counts held are written out whenever there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        emit = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["pre", "n"])
        for batch in batches:
            for t in batch.column(0):
                held.update(pretokens(t.as_py() or "", name))
                if len(held) > flush:
                    yield emit(held)
                    held = Counter()
        if held:
            yield emit(held)

    return run


def _partition_pieces(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pieces(batch.column(0).to_pylist(), name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counted, pa.int32())], names=["pre", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """(pre, n, pieces): every distinct pre-token of the corpus, how often it occurs, and its pieces."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_partition_counts(name), "pre string, n long")
    return counted.groupBy("pre").agg(F.sum("n").alias("n")).mapInArrow(_partition_pieces(name), "pre string, n long, pieces int")


def _document_parts(name: str, head, most: int = 200_000):
    """Of each document a row without ``pre`` that holds the sum over the head, and its other pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            keys, marks, texts = batch.columns
            take, pre, n, size_of = [], [], [], []

            def emit() -> pa.RecordBatch:
                at = pa.array(take, pa.int64())
                return pa.RecordBatch.from_arrays([keys.take(at), marks.take(at), pa.array(pre, pa.string()), pa.array(n, pa.int64()), pa.array(size_of, pa.int64())], names=["key", "mark", "pre", "n", "bytes"])

            for k, t in enumerate(texts):
                text, total = t.as_py() or "", 0
                for p, c in Counter(pretokens(text, name)).items():
                    size = known.get(p)
                    if size is None:
                        take.append(k)
                        pre.append(p)
                        n.append(c)
                        size_of.append(None)
                    else:
                        total += size * c
                take.append(k)
                pre.append(None)
                n.append(total)
                size_of.append(len(text.encode()))
                if len(take) >= most:
                    yield emit()
                    take, pre, n, size_of = [], [], [], []
            if take:
                yield emit()

    return run


def count_tokens(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Null counts as an empty text: no bytes, no tokens.  Strings of added tokens inside a text are the
    tokens they name, as the library has it by default.  Repeated rows each get their own equal
    result, texts of any length are counted whole, an empty table gives no rows, and other columns
    are ignored.
    """
    spark = docs.sparkSession
    all_pieces = materialize(vocabulary(docs, name), "vocabulary")
    # whole classes of frequency, from the top, as long as they have ``head`` members at most: no task sends more than its share of those
    rank = F.floor(F.log2("n") * 16)
    classes = sorted(((r["rank"], r["members"]) for r in all_pieces.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("members")).collect()), reverse=True)  # 16 for each power of two
    members, least = 0, None
    for r, m in classes:
        members += m
        if members > head:
            break
        least = r
    common = all_pieces.where(rank >= least if least is not None else F.lit(False)).select("pre", "pieces").toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(common["pre"], common["pieces"].tolist())))
    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("pre", "string").add("n", "long").add("bytes", "long")
    parts = rows.mapInArrow(_document_parts(name, shared), schema)
    # a document's own row meets no pre-token; its join key is spread by its mark
    keyed = parts.withColumn("at", F.coalesce("pre", F.concat(F.lit("\0"), F.hex("mark"))))
    known = all_pieces.select(F.col("pre").alias("vpre"), "pieces")
    joined = keyed.join(known, F.col("at") == F.col("vpre"), "left")
    n = F.when(F.col("pre").isNull(), F.col("n")).otherwise(F.col("n") * F.col("pieces"))
    # equal rows give equal parts, so sums are divided among as many rows as there were
    summed = joined.groupBy("key", "mark").agg(F.sum(n).alias("total"), F.count("bytes").alias("copies"), F.max("bytes").alias("n_bytes"))
    each = summed.select(F.col("key").alias("doc_id"), "n_bytes", F.expr("total div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
