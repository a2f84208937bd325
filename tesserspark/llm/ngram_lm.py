"""Bigram language model in Elias-Fano tries.

The model: P(b | a) = (c(a b) + k p(b)) / (c(a) + k), where p(b) = (c(b) + 1) / (N + V + 1) is the
add-one unigram probability, so the probabilities after a context sum to one, the unknown word
included.  Contexts begin with a start mark and documents end with an end token.  Words are known by
the 64-bit hash of their bytes.

The trie holds n-grams last word first, and is dealt over shards by that word; a word that holds much
of the corpus is dealt further by its contexts.  So a shard has all that its words' tokens need: how
often the word occurs, which contexts it follows, and, as each occurrence of a word is also once a
context, what the next token's probability is divided by.  Each shard keeps in memory-mapped levels
(anonymous maps: nothing lies on the machine's disk) Elias-Fano sequences of its words, of the
pointers to their contexts, and of the contexts, as places in the shard's own vocabulary relative to
their word; and 16-bit codes of the logarithms of p(b) and of c(a b) + k p(b).  A query finds its
word, reads the two pointers, and searches the successor of its context within that range; only the
chunks that a query falls into are decoded.

Texts are read twice (word counts; pairs) and never shuffled: blocks of documents send each shard the
pairs they hold, packed, once for training and query, and shards return sums for the documents they
met.  A block has its learning documents first, so one number tells which pairs teach.
"""

from __future__ import annotations

import mmap
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tesserspark.llm.common import materialize

KAPPA, BLOCK_TOKENS, BLOCK_DOCS, SHARD_TOKENS = 64.0, 1_000_000, 60_000, 4_000_000
#: A word with more than this part of a shard's tokens is dealt over several shards; so there are at most HOT_PART words a shard.
HOT_PART = 4
#: A shard is built and queried in this many slices of its words, one after another, to hold less at once.
SLICES = 8
_hash = partial(xxhash.xxh64_intdigest, seed=42)
#: No word has white space, so these are no words.
START, END = _hash(b" start"), _hash(b" end")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing; a row without doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _mapped(a: np.ndarray) -> np.ndarray:
    """A copy of the array in a memory map of its own."""
    if not a.size:
        return a
    out = np.frombuffer(mmap.mmap(-1, a.nbytes), a.dtype).reshape(a.shape)
    out[:] = a
    return out


class EliasFano:
    """Non-decreasing integers in two memory maps: low bytes, and high parts in unary.

    The number of low bits is a whole number of bytes, so the unary part has at most 3 bits a value.
    """

    CHUNK = 4096

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.bytes = max(1, -(-max(0, (top // max(1, n)).bit_length()) // 8))
        shift = np.uint64(8 * self.bytes) if self.bytes < 8 else None
        high = (values >> shift).astype(np.int64) if shift is not None else np.zeros(n, np.int64)
        ones = high + np.arange(n)
        bits = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        bits[ones] = n > 0
        self.samples = np.append(ones[:: self.CHUNK], len(bits))  # where each chunk begins
        low = values.view(np.uint8).reshape(n, 8)[:, : self.bytes] if n else np.zeros((0, self.bytes), np.uint8)
        self.low = _mapped(np.ascontiguousarray(low))
        self.high = _mapped(np.packbits(bits, bitorder="little"))
        self.first = values[:: self.CHUNK].copy()

    def chunk(self, k: int) -> np.ndarray:
        """Values k * CHUNK and on."""
        lo, hi = int(self.samples[k]), int(self.samples[k + 1])
        bits = np.unpackbits(self.high[lo // 8 : hi // 8 + 1], bitorder="little")[lo % 8 : lo % 8 + hi - lo]
        at = np.flatnonzero(bits) + lo
        start = k * self.CHUNK
        part = np.zeros((len(at), 8), np.uint8)
        part[:, : self.bytes] = self.low[start : start + len(at)]
        high = (at - np.arange(start, start + len(at))).astype(np.uint64)
        low = part.view(np.uint64).reshape(-1)
        return low | (high << np.uint64(8 * self.bytes)) if self.bytes < 8 else low

    def _by_chunk(self, which: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of an ascending sequence of chunk numbers."""
        edges = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1], [True])))
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield int(which[lo]), slice(lo, hi)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending places."""
        out = np.zeros(len(places), np.uint64)
        for k, run in self._by_chunk(places // self.CHUNK) if len(places) else ():
            out[run] = self.chunk(k)[places[run] - k * self.CHUNK]
        return out

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending queries, over strictly ascending values: the place of the first value not below each, and whether it is equal."""
        place, equal = np.full(len(queries), self.n), np.zeros(len(queries), bool)
        if not self.n or not len(queries):
            return place, equal
        for k, run in self._by_chunk(np.maximum(np.searchsorted(self.first, queries, "right") - 1, 0)):
            v, q = self.chunk(k), queries[run]
            p = np.searchsorted(v, q, "left")
            place[run] = p + k * self.CHUNK
            equal[run] = v[np.minimum(p, len(v) - 1)] == q
        return place, equal


class Codes:
    """Numbers as 16-bit codes in even steps between the least and the greatest: none is off by more than ``error``."""

    TOP = (1 << 16) - 1

    def __init__(self, values: np.ndarray):
        self.low = float(values.min()) if len(values) else 0.0
        self.step = (float(values.max()) - self.low) / self.TOP if len(values) else 0.0
        self.codes = _mapped(np.rint((values - self.low) / self.step).astype(np.uint16) if self.step > 0 else np.zeros(len(values), np.uint16))
        self.error = self.step / 2

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.low + self.step * self.codes[places]


class Trie:
    """Pairs of some words, from ascending distinct (word, context) with counts.

    ``words`` are all known words, ascending, with how often they occur (``total``); some may have no
    pair here, as theirs lie in other shards.
    """

    def __init__(self, words: np.ndarray, total: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray, kappa: float, norm: float):
        self.kappa, self.norm, self.total = kappa, norm, total
        place = np.searchsorted(words, word)
        vocabulary = np.unique(context)
        self.width = np.uint64(max(1, len(vocabulary)))
        self.words = EliasFano(words)
        self.vocabulary = EliasFano(vocabulary)
        self.pointers = EliasFano(np.searchsorted(place, np.arange(len(words) + 1)))
        self.contexts = EliasFano(place.astype(np.uint64) * self.width + np.searchsorted(vocabulary, context).astype(np.uint64))
        p = (total + 1.0) / norm
        self.lower = Codes(np.log10(p))
        self.joint = Codes(np.log10(count + kappa * p[place]))

    def query(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending (word, context): how often the word occurs, and log10 of c(context word) + k p(word)."""
        if not len(word):
            return np.zeros(0, np.int64), np.zeros(0)
        new = np.concatenate(([True], word[1:] != word[:-1]))
        run = np.cumsum(new) - 1
        at, known = self.words.successor(word[new])
        total = np.zeros(len(at), np.int64)
        log = np.full(len(at), np.log10(1 / self.norm))
        total[known] = self.total[at[known]]
        log[known] = self.lower.at(at[known])
        begin, end = self.pointers.at(at[known]), self.pointers.at(at[known] + 1)
        log = log[run] + np.log10(self.kappa)
        # the contexts as places in the vocabulary; those that stand nowhere in it were never seen
        order = np.argsort(context, kind="stable")
        rank, there = np.zeros(len(word), np.uint64), np.zeros(len(word), bool)
        rank[order], there[order] = self.vocabulary.successor(context[order])
        able = np.flatnonzero(there & known[run])
        place, equal = self.contexts.successor(at[run[able]].astype(np.uint64) * self.width + rank[able])
        which = (np.cumsum(known) - 1)[run[able]]
        equal &= (place >= begin[which]) & (place < end[which])  # within the word's contexts
        log[able[equal]] = self.joint.at(place[equal])
        return total[run], log


def _tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _word_counts(batches: Iterator[pa.RecordBatch], flush: int = 700_000) -> Iterator[pa.RecordBatch]:
    """(word, n) of the training rows of each task: columns text, held."""
    held: Counter = Counter()

    def emit(c: Counter) -> pa.RecordBatch:
        keys = np.fromiter((_hash(w) for w in c), np.uint64, len(c)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    documents = 0
    for batch in batches:
        for text, out in zip(batch.column(0), batch.column(1).to_pylist()):
            if not out:
                held.update(_tokens(text.as_py()))
                documents += 1
                if len(held) > flush:
                    yield emit(held)
                    held = Counter()
    if held:
        yield emit(held)
    if documents:
        ends = np.array([END, START], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array([documents] * 2, pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash and count of every training token, and of the start mark, which is none."""
    rows = docs.select(F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held"))
    return rows.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ipc(array: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("k", array.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([array], names=["k"]))
    return sink.getvalue().to_pybytes()


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(data, t, n, at))
        at += int(n) * np.dtype(t).itemsize
    return out


_PAIRS = (np.uint64, np.uint32, np.uint64, np.uint16, np.uint8, np.int64)  # words, their runs, contexts, documents, frequencies, how many documents teach
_SUMS = (np.uint16, np.float64, np.uint32, np.float64)  # documents, sums of log10(c + 1), known tokens, log10 of the bigrams


def _blocks(shards: int, parts: dict[int, int]):
    """Of each block of documents: a row of its keys (shard -1 - block), and a row of packed pairs for each shard.  Columns key, held, text."""
    hot = np.array(sorted(parts), np.uint64)
    spread = np.array([parts[int(h)] for h in hot], np.uint64)

    def shard_of(word: np.ndarray, context: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(word), np.uint64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
            is_hot = hot[at] == word
            salt[is_hot] = (context[is_hot] >> np.uint64(17)) % spread[at[is_hot]]
        x = (word ^ (salt * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        keys, flags, hashes, sizes, tokens = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, flags, hashes, sizes, tokens, count
            block = task << 24 | count
            count += 1
            n = np.array(sizes)
            teaches = ~np.array(flags, bool)
            first = np.argsort(~teaches, kind="stable")  # documents that teach come first
            number = np.empty(len(n), np.uint16)
            number[first] = np.arange(len(n))
            word = np.concatenate(hashes)  # each document's words, then the end
            context = np.concatenate((np.array([START], np.uint64), word[:-1]))
            context[np.cumsum(n)[:-1]] = START
            doc = np.repeat(number, n)
            order = np.lexsort((doc, context, word))
            word, context, doc = word[order], context[order], doc[order]
            at = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1]))))
            freq = np.diff(np.append(at, len(word)))
            times = -(-freq // 255)  # a frequency beyond a byte is told in several rows
            at = np.repeat(at, times)
            left = np.repeat(freq, times) - 255 * (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times))
            word, context, doc, freq = word[at], context[at], doc[at], np.minimum(left, 255).astype(np.uint8)
            shard = shard_of(word, context)
            order = np.argsort(shard, kind="stable")
            shard, word, context, doc, freq = shard[order], word[order], context[order], doc[order], freq[order]
            cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
            head = pa.concat_arrays([k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys]).take(pa.array(first))
            taught = np.array([teaches.sum()], np.int64)
            out = [(-1 - block, block, _pack(np.frombuffer(_ipc(head), np.uint8), n[first].astype(np.int64), taught))]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                w = word[lo:hi]
                at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                out.append((int(shard[lo]), block, _pack(w[at], np.diff(np.append(at, hi - lo)).astype(np.uint32), context[lo:hi], doc[lo:hi], freq[lo:hi], taught)))
            keys, flags, hashes, sizes, tokens = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["shard", "block", "data"])

        for batch in batches:
            held = batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2)):
                w = _tokens(text.as_py())
                h = np.empty(len(w) + 1, np.uint64)
                h[:-1] = np.fromiter(map(_hash, w), np.uint64, len(w))
                h[-1] = END
                keys.append(batch.column(0).slice(k, 1))
                flags.append(held[k])
                hashes.append(h)
                sizes.append(len(h))
                tokens += len(h)
                if tokens >= BLOCK_TOKENS or len(sizes) >= BLOCK_DOCS:
                    yield flush()
        if sizes:
            yield flush()

    return run


def _shard(totals: dict[int, int], kappa: float, norm: float):
    """Builds the trie of each of a task's shards from its training pairs and answers all its pairs.

    Returns for each block the sums of the documents it met (kind 0), and rows of keys as they came (kind 1).
    """
    hot = np.array(sorted(totals), np.uint64)
    often = np.array([totals[int(h)] for h in hot], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, pa.Buffer]]] = {}
        for batch in batches:
            for shard, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if shard < 0:
                    yield rows(1, [block], [data.as_py()])
                else:
                    held.setdefault(shard, []).append((block, data.as_buffer()))
        while held:
            _, found = held.popitem()
            yield rows(0, [block for block, _ in found], sums_of([_unpack(data, *_PAIRS) for _, data in found]))

    def rows(kind: int, blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["kind", "block", "data"])

    def sums_of(parts: list[list[np.ndarray]]) -> list[bytes]:
        # sums have a place for each document of a block that was met here, and no other
        met = [np.unique(p[3]) for p in parts]
        base = np.cumsum([0, *map(len, met)])
        sums = np.zeros((3, base[-1]))
        slices = [(p[0] * _MIX >> np.uint64(40)) % np.uint64(SLICES) for p in parts]
        for piece in range(SLICES):
            of = [np.repeat(x == np.uint64(piece), p[1]) for x, p in zip(slices, parts)]
            word = np.concatenate([np.repeat(p[0], p[1])[m] for p, m in zip(parts, of)])
            context = np.concatenate([p[2][m] for p, m in zip(parts, of)])
            freq = np.concatenate([p[4][m] for p, m in zip(parts, of)]).astype(np.int64)
            teaches = np.concatenate([p[3][m] < p[5][0] for p, m in zip(parts, of)])
            doc = np.concatenate([np.searchsorted(d, p[3][m]) + b for p, m, d, b in zip(parts, of, met, base)])
            del of
            order = np.lexsort((context, word))
            answered(word[order], context[order], freq[order], teaches[order], doc[order], sums)
        return [_pack(d, sums[0, lo:hi], np.rint(sums[1, lo:hi]).astype(np.uint32), sums[2, lo:hi]) for d, lo, hi in zip(met, base[:-1], base[1:])]

    def answered(word, context, freq, teaches, doc, sums) -> None:
        """Adds what ascending (word, context) contribute to the sums of their documents."""
        if not len(word):
            return
        b, a, f = word[teaches], context[teaches], freq[teaches]
        at = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])))) if len(b) else np.zeros(0, np.int64)
        count = np.add.reduceat(f, at) if len(at) else np.zeros(0, np.int64)
        b, a = b[at], a[at]
        new = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
        words, total = b[new], np.add.reduceat(count, new) if len(new) else np.zeros(0, np.int64)
        if len(hot):  # words that are dealt over shards: their count is known beforehand, their pairs may all lie elsewhere
            here = np.intersect1d(hot, word)
            words, total = np.concatenate([here, words]), np.concatenate([often[np.searchsorted(hot, here)], total])
            words, one = np.unique(words, return_index=True)
            total = total[one]
        trie = Trie(words, total, b, a, count, kappa, norm)
        c, log = trie.query(word, context)
        log -= np.where(word != np.uint64(END), np.log10(c + kappa), 0.0)  # each occurrence of a word is once a context; the end is none
        for k, x in enumerate((np.log10(c + 1.0), (c > 0).astype(float), log)):
            sums[k] += np.bincount(doc, freq * x, sums.shape[1])

    return run


def _finished(start: float, train_tokens: int, norm: float):
    """Sums of a block over its shards, by document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].combine_chunks()
        packed, sizes, taught = _unpack(data[kinds.index(1)].as_buffer(), np.uint8, np.int64, np.int64)
        keys = pa.ipc.open_stream(packed.tobytes()).read_all()["k"]
        n = len(sizes)
        total = np.zeros((3, n))
        for kind, row in zip(kinds, data):
            if kind == 0:
                some, *values = _unpack(row.as_buffer(), *_SUMS)
                total[:, some] += values
        return pa.table(
            {
                "doc_id": keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys,
                "held_out": pa.array(np.arange(n) >= taught[0]),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.rint(total[1]).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, train_tokens)),
                "base_score": pa.array(total[0] - sizes * np.log10(norm)),
                "score": pa.array(total[2] - start),
            }
        )

    return run


def score_texts(docs: DataFrame, kappa: float = KAPPA, shard_tokens: int = SHARD_TOKENS, hot_part: float = HOT_PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null and blank texts have one token, the end.  A row without doc_id is not held out.  If every
    row is held out nothing is known and N and V are 0.  Texts of any length are scored whole.
    Repeated rows each count and each get a result; an empty table gives no rows; other columns are
    ignored.  ``base_score`` is exact; ``score`` is off by half a step of the 16-bit codes a token at
    most, and the same in every run but for the order of addition.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs), "words")
    start, end = (int(np.array([x], np.uint64).view(np.int64)[0]) for x in (START, END))
    tokens = counts.where(F.col("word") != start)
    whole = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word") == end, F.col("n"))), F.lit(0))).first()
    train_tokens, distinct, documents = map(int, whole)
    norm = float(train_tokens + distinct + 1)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-train_tokens // shard_tokens))
    # at most hot_part words a shard, since each has that part of the tokens of one
    frequent = tokens.where(F.col("n") * F.lit(float(shards * hot_part)) > F.lit(float(train_tokens))).collect()
    totals = {r["word"] % (1 << 64): r["n"] for r in frequent}
    parts = {w: max(1, int(-(-n * shards * hot_part // train_tokens))) for w, n in totals.items()}
    rows = docs.select(F.col("doc_id").alias("key"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocks(shards, parts), "shard long, block long, data binary")
    dealt = blocks.repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int"))  # each shard a task of its own
    answers = materialize(dealt.mapInArrow(_shard(totals, kappa, norm), "kind int, block long, data binary"), "answers")
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return answers.groupBy("block").applyInArrow(_finished(float(np.log10(documents + kappa)), train_tokens, norm), schema)
