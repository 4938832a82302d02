"""Byte-level BPE by ranks (operator 3): distinct words are merged in Spark, documents are put together from them.

The merges of a word are a fold of Spark's higher-order functions over its
array of bytes, by a constant map of ranked pairs. The most frequent distinct
words of a row sample are merged once and sent along, a table of bounded size
that changes the speed only; every other word is merged in the row of the lot
of documents it stands in, once per lot. Decoding concatenates the byte strings of the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, keyed_texts, stored
from markerloom.llm.pretokens import gather_flat, in_groups, position_weights, split_words
from markerloom.llm.tokens import vocabulary_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct words that are sent along at most, the most frequent of a sample of the documents.
FREQUENT_WORDS = 500_000
SAMPLED = 0.1
#: Words that a task counts at once; a bound of memory.
COUNTED_TOGETHER = 50_000
#: Frequent words are merged in so many lots.
MERGED_LOTS = 64
#: Longer words are never sent along; so the table has a size bound.
FREQUENT_BYTES = 64
#: The fold takes the square of a word's length; longer words are merged with a heap by the same ranks.
FOLD_BYTES = 200
DOCS_PER_LOT = 500
#: Characters of a lot, unless one text has more; larger lots take more memory and repeat hardly fewer words.
CHARS_PER_LOT = 1 << 19
#: Above every rank: the pair gives no token.
UNJOINED = 1 << 20
LOTS = "doc_ids array<long>, n_words array<int>, number binary, sizes binary, known binary, rare array<array<int>>"
ENCODED = "doc_id long, n_tokens long, ids binary"


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def pairs_of(path: str) -> dict[tuple[int, int], int]:
    """Every way to join two tokens into a third: their ids, and the id (which is the rank) of the whole."""
    ranks = read_ranks(path)
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left, right] = rank
    return found


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair_table(path: str) -> list[int]:
    """All pairs with their ranks, every pair at one of its two places (-1: nothing there): left id, right id, rank, 20 bits each."""
    pairs = pairs_of(path)
    for bits in range(max(4, (2 * len(pairs)).bit_length()), 31):
        size = 1 << bits
        held: list[tuple[int, int] | None] = [None] * size
        if all(_settle(held, pair, size) for pair in pairs):
            return [-1 if p is None else (p[0] << 20 | p[1]) << 20 | pairs[p] for p in held]
    raise ValueError("no table found for the pairs")


def _sums(left, right):
    """Two numbers of a pair, for numbers and for columns alike; their last bits are its two places in the table."""
    return left * 31 + right, left * 517 + right * 13


def _settle(held: list, pair: tuple[int, int], size: int) -> bool:
    """Puts a pair at one of its places; what stood there moves to its other one."""
    at = _sums(*pair)[0] % size
    for _ in range(500):
        held[at], pair = pair, held[at]
        if pair is None:
            return True
        one, two = _sums(*pair)
        at = two % size if at == one % size else one % size
    return False


class Merges:
    """The merges as Spark expressions over one constant, the rank map of pairs.

    The constant is an uncorrelated scalar subquery: as a plain literal of this
    length it would be printed with every plan, and read anew entry by entry in
    every task.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        ranks, pairs = read_ranks(path), pairs_of(path)
        table = pair_table(path)
        self.size = len(table)
        single = [ranks[bytes([b])] for b in range(256)]
        first = [pairs.get((left, right)) for left in single for right in single]
        schema = "pairs array<bigint>, bytes array<int>, first array<int>"
        self.table = spark.createDataFrame([(table, single, first)], schema).select(F.struct("*")).scalar()

    def applied(self, rows: DataFrame, words: str | Column, *kept: str) -> DataFrame:
        """The kept columns of ``rows``, and ``merged``: the ids of every word of an array of byte arrays."""
        named = rows.select(*kept, (F.col(words) if isinstance(words, str) else words).alias("_words"), self.table.alias("_table"))
        merged = _let(F.col("_table"), lambda table: F.transform("_words", lambda word: self._ids(table, word)))
        return named.select(*kept, merged.alias("merged"))

    def _rank(self, table: Column, left: Column, right: Column) -> Column:
        """Rank of the pair, ``UNJOINED`` if nothing joins it."""
        key = F.shiftleft(left, 20).bitwiseOR(right)
        one, two = (F.get(table["pairs"], at.bitwiseAND(F.lit(self.size - 1)).cast("int")) for at in _sums(left, right))
        rank = F.lit((1 << 20) - 1).cast("long")
        found = F.when(F.shiftright(one, 20) == key, one.bitwiseAND(rank))
        return found.when(F.shiftright(two, 20) == key, two.bitwiseAND(rank)).otherwise(F.lit(UNJOINED).cast("long"))

    def _ids(self, table: Column, word: Column) -> Column:
        """Ids of a word given as an array of byte values: the lowest pair is joined again and again, the leftmost of equals first.

        A part is one number: the rank of the pair that it begins, then its id.
        """
        low, high = F.lit((1 << 20) - 1).cast("long"), F.lit(-1 << 20).cast("long")
        first = F.transform(
            word,
            lambda b, i: F.shiftleft(F.coalesce(F.get(table["first"], b * 256 + F.get(word, i + 1)), F.lit(UNJOINED)).cast("long"), 20)
            .bitwiseOR(F.get(table["bytes"], b)),
        )

        def join(parts: Column, _: Column) -> Column:
            # Rank and place in one number, so that the least is the lowest pair, the leftmost of equals.
            placed = F.transform(parts, lambda part, i: part.bitwiseAND(high).bitwiseOR(i))
            return _let(
                F.array_min(placed),
                lambda least: F.when(least >= UNJOINED << 20, parts).otherwise(
                    self._joined(table, parts, F.shiftright(least, 20), least.bitwiseAND(low).cast("int"), low)
                ),
            )

        rounds = F.slice(word, F.lit(2), F.size(word))
        merged = F.aggregate(
            rounds, first, join, lambda parts: F.transform(parts, lambda part: part.bitwiseAND(low).cast("int"))
        )
        return F.when(F.size(word) > 0, merged).otherwise(word)

    def _joined(self, table: Column, parts: Column, whole: Column, at: Column, low: Column) -> Column:
        """Parts with those at ``at`` and after it made one, and the pairs with both neighbours renewed."""
        right, left = F.get(parts, at + 2), F.get(parts, at - 1)
        # Without a neighbour the rank is looked up for a null and so not found.
        one = F.shiftleft(self._rank(table, whole, right.bitwiseAND(low)), 20).bitwiseOR(whole)
        before = _let(
            left.bitwiseAND(low), lambda id_: F.array(F.shiftleft(self._rank(table, id_, whole), 20).bitwiseOR(id_), one)
        )
        changed = F.when(at > 0, before).otherwise(F.array(one))
        return F.flatten(
            F.array(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), changed, F.slice(parts, at + 3, F.size(parts)))
        )


def merge_long(word: bytes, path: str) -> list[int]:
    """The same merges for a long word, by a heap of pairs: lowest rank first, the leftmost of equals."""
    ranks, pairs = read_ranks(path), pairs_of(path)
    ids: list[int | None] = [ranks[bytes([b])] for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    waiting = [(pairs[a, b], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (a, b) in pairs]
    heapq.heapify(waiting)
    while waiting:
        rank, i, a, b = heapq.heappop(waiting)
        j = after[i] if ids[i] is not None else len(ids)
        if j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j] = rank, None
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(ids) and (pair := (ids[left], ids[right])) in pairs:
                heapq.heappush(waiting, (pairs[pair], left, *pair))
    return [x for x in ids if x is not None]


def word_counts(texts: DataFrame, path: str) -> DataFrame:
    """``word, n``: how often each distinct short word that is no token itself occurs in the texts."""
    schema = "word string, n long"
    target = arrow_schema(texts.sparkSession, schema)

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=target)

    def run(batches: Batches) -> Batches:
        ranks = read_ranks(path)
        held: Counter = Counter()
        for batch in batches:
            lot = batch.column(0).to_pylist()
            for begin, end in in_groups(lot, CHARS_PER_LOT):
                words, number, _ = split_words(lot[begin:end])
                for word, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                    whole = word.encode()
                    if len(whole) <= FREQUENT_BYTES and whole not in ranks:
                        held[word] += n
                if len(held) > COUNTED_TOGETHER:
                    yield emit(held)
                    held.clear()
        yield emit(held)

    return texts.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class KnownWords:
    """Words with their ids in a few arrays, by the hash of their bytes: about 35 bytes for a word, not 200 as in a dictionary."""

    hashes: np.ndarray  # ascending
    raw: np.ndarray  # bytes of all words, one after another
    begins: np.ndarray  # of each word in ``raw``, and the end
    ids: np.ndarray
    firsts: np.ndarray  # of each word in ``ids``, and the end

    @classmethod
    def of(cls, raw: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> KnownWords:
        # Of words with the same hash one is kept; the others are merged like any word that is not here.
        hashes, kept = np.unique(_hashes(raw, lengths), return_index=True)
        raw, lengths = gather_flat(raw, lengths, kept)
        ids, sizes = gather_flat(ids, sizes, kept)
        small = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
        return cls(hashes, raw, _ends(lengths).astype(np.uint32), ids.astype(small), _ends(sizes).astype(np.uint32))

    def find(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each word here, -1 for those that are not."""
        out = np.full(len(lengths), -1, dtype=np.int64)
        own = np.flatnonzero(lengths <= np.diff(self.begins).max(initial=0))
        if not len(own):
            return out
        hashes = _hashes(*gather_flat(raw, lengths, own))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        alike = (self.hashes[at] == hashes) & (self.begins[at + 1] - self.begins[at] == lengths[own])
        here, there = own[alike], at[alike]
        # A hash may be shared by chance, so all bytes are compared.
        ours, sizes = gather_flat(raw, lengths, here)
        same = ours == _pieces(self.raw, self.begins, there)[0]
        if not same.all():
            equal = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
            here, there = here[equal], there[equal]
        out[here] = there
        return out

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words, one after another, and how many each has."""
        return _pieces(self.ids, self.firsts, number)


def _small(number: np.ndarray, words: int) -> np.ndarray:
    """Numbers below ``words`` in two bytes each if they fit, else in four; all lots of a task are in memory at once."""
    return number.astype(np.uint16 if words <= 1 << 16 else np.int32)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _pieces(flat: np.ndarray, begins: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the numbered pieces of ``flat``; also the length of each."""
    first = begins[number].astype(np.int64)
    lengths = begins[number + 1].astype(np.int64) - first
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total, dtype=np.int64) + np.repeat(first - (ends - lengths), lengths)], lengths


def _hashes(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; no word is empty."""
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    firsts = np.cumsum(lengths) - lengths
    offset = np.arange(len(raw)) - np.repeat(firsts, lengths)
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * position_weights(1 << max(6, int(lengths.max()).bit_length()))[offset]
    mixed ^= mixed >> np.uint64(31)
    return np.add.reduceat(mixed, firsts) * np.uint64(0x94D049BB133111EB)


def _bytes_of(words: pa.StringArray | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words one after another, and the length of each."""
    if not len(words):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def frequent_words(texts: DataFrame, path: str, limit: int = FREQUENT_WORDS, fraction: float = SAMPLED) -> KnownWords:
    """All tokens, and frequent words that are none, with their ids: of these at most ``limit``, of ``FREQUENT_BYTES`` bytes each.

    Counted in a row sample. Counts fall into classes of a factor 2 ** 0.125;
    whole classes are taken from the top while they fit, so nothing is sorted.
    """
    tokens = read_ranks(path)
    raw, lengths = _bytes_of(pa.array(tokens.keys(), pa.binary()))
    ids = np.fromiter(tokens.values(), dtype=np.uint32, count=len(tokens))
    merged = _merged_words(texts, path, limit, fraction) if limit > 0 else None
    if merged is None:
        return KnownWords.of(raw, lengths, ids, np.ones(len(tokens), dtype=np.int64))
    words = merged["words"].combine_chunks().flatten().cast(pa.string())
    found = merged["merged"].combine_chunks().flatten()
    more_raw, more_lengths = _bytes_of(words)
    return KnownWords.of(
        np.concatenate([raw, more_raw]),
        np.concatenate([lengths, more_lengths]),
        np.concatenate([ids, found.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)]),
        np.concatenate([np.ones(len(tokens), dtype=np.int64), found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)]),
    )


def _merged_words(texts: DataFrame, path: str, limit: int, fraction: float) -> pa.Table | None:
    """``words, merged``: lots of frequent words and their ids; None if there are no words."""
    spark = texts.sparkSession
    level = F.floor(F.log2("n") * 8)
    counts = stored(word_counts(texts.sample(fraction, seed=1), path).select("word", level.alias("level")), "bpe_words")
    least, taken = None, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        taken += row["count"]
        if taken > limit:
            break
        least = row["level"]
    if least is None:
        return None
    # As many partitions as lots: small as the words are, merging them is the work.
    top = counts.filter(F.col("level") >= least).withColumn("lot", F.pmod(F.xxhash64("word"), F.lit(MERGED_LOTS)))
    lots = top.repartition(MERGED_LOTS, "lot").groupBy("lot").agg(F.collect_list("word").alias("words"))
    bytes_of = F.transform("words", lambda word: _byte_values(F.encode(word, "UTF-8")))
    return Merges(spark, path).applied(lots, bytes_of, "words").toArrow()


def _byte_values(binary: Column) -> Column:
    """A binary as an array of numbers."""
    digits = F.hex(binary)
    return F.transform(
        F.sequence(F.lit(0), F.octet_length(binary) - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    )


def _lots(texts: DataFrame, path: str, frequent) -> DataFrame:
    """Rows of a few hundred documents each: their words by number, the ids of known words, the bytes of the others."""
    target = arrow_schema(texts.sparkSession, LOTS)

    def known_ids(words: Sequence[str], known: KnownWords) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of the words that need no fold, how many each has, and the bytes of the others."""
        ranks = read_ranks(path)
        raw, lengths = _bytes_of(pa.array(words, pa.string()))
        number = known.find(raw, lengths)
        here = number >= 0
        ids, own = known.ids_of(number[here])
        sizes = np.zeros(len(words), dtype=np.int64)
        sizes[here] = own
        rare, other = [], {}
        for i in np.flatnonzero(~here).tolist():
            whole = words[i].encode()
            rank = ranks.get(whole)
            if rank is not None:
                other[i] = [rank]
            elif len(whole) > FOLD_BYTES:
                other[i] = merge_long(whole, path)
            else:
                rare.append(i)
        if other:
            at, more = np.fromiter(other, dtype=np.int64, count=len(other)), [*other.values()]
            own = np.fromiter(map(len, more), dtype=np.int64, count=len(more))
            ids = np.insert(ids.astype(np.uint32), np.repeat((np.cumsum(sizes) - sizes)[at], own), np.concatenate(more).astype(np.uint32))
            sizes[at] = own
        values, counts = gather_flat(raw, lengths, np.asarray(rare, dtype=np.int64))
        bytes_of = pa.ListArray.from_arrays(pa.array(_ends(counts).astype(np.int32)), pa.array(values.astype(np.int32)))
        return ids.astype("<u4"), sizes, pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), bytes_of)

    def run(batches: Batches) -> Batches:
        table = frequent.value
        for batch in batches:
            for first in range(0, batch.num_rows, DOCS_PER_LOT):
                lot = batch.slice(first, DOCS_PER_LOT)
                docs, whole = lot.column(0).to_pylist(), lot.column(1).to_pylist()
                for begin, end in in_groups(whole, CHARS_PER_LOT):
                    words, number, counts = split_words(whole[begin:end])
                    ids, sizes, rare = known_ids(words, table)
                    columns = [[docs[begin:end]], [counts.tolist()], [_small(number, len(words)).tobytes()], [sizes.astype(np.int32).tobytes()], [ids.tobytes()]]
                    made = [pa.array(c, type=f.type) for c, f in zip(columns, target, strict=False)]
                    yield pa.RecordBatch.from_arrays([*made, rare.cast(target.field("rare").type)], schema=target)

    return texts.mapInArrow(run, LOTS)


def _assembled(lots: DataFrame) -> DataFrame:
    target = arrow_schema(lots.sparkSession, ENCODED)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, n_words, number, sizes, known, merged = (batch.column(c)[i] for c in range(6))
                sizes = np.frombuffer(sizes.as_py(), dtype=np.int32).astype(np.int64)
                flat = np.frombuffer(known.as_py(), dtype=np.uint32)
                lists = merged.values
                if lists is not None and len(lists):
                    rare = np.flatnonzero(sizes == 0)
                    own = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    place = np.repeat((np.cumsum(sizes) - sizes)[rare], own)
                    flat = np.insert(flat, place, lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32))
                    sizes[rare] = own
                ids, lengths = gather_flat(flat, sizes, np.frombuffer(number.as_py(), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int32))
                words = np.concatenate([[0], np.cumsum(n_words.values.to_numpy(zero_copy_only=False))]).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])[words]
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [docs.values.cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return lots.mapInArrow(run, ENCODED)


def encode(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ranks: str | None = None,
    frequent: int = FREQUENT_WORDS,
    sampled: float = SAMPLED,
) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids of whole texts as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; null keys and repeated rows stay; words of
    any length are merged to the end; no documents give no rows. ``frequent``
    and ``sampled`` change the speed only.
    """
    path = ranks or vocabulary_path(RANKS)
    texts = keyed_texts(documents, key, text)
    table = texts.sparkSession.sparkContext.broadcast(frequent_words(texts, path, frequent, sampled))
    lots = _lots(texts, path, table)
    merges = Merges(texts.sparkSession, path)
    return _assembled(merges.applied(lots, "rare", "doc_ids", "n_words", "number", "sizes", "known"))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds ``decoded``: the byte strings of a row's ``ids``, joined. An id outside the vocabulary is an error."""
    path = ranks or vocabulary_path(RANKS)
    schema = "doc_id long, n_tokens long, ids binary, decoded binary"
    target = arrow_schema(encoded.sparkSession, schema)

    def run(batches: Batches) -> Batches:
        ranks_of = read_ranks(path)
        pieces = [b""] * (max(ranks_of.values()) + 1)
        for piece, rank in ranks_of.items():
            pieces[rank] = piece
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                lot = batch.slice(begin, 1000)
                texts = [b"".join(map(pieces.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in lot.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*lot.columns, pa.array(texts, pa.binary())], schema=target)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, schema)


