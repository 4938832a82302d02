"""SimHash near-duplicates by an inverted index of byte positions (operator 8).

Two 64-bit fingerprints that differ in at most three bits agree in at least
five of their eight bytes, at the same positions. A list for a single
positional byte would hold 1/256 of all fingerprints, so a posting here is
three positional bytes: of any five positions at least three lie in the same
half, and the eight triples inside the halves therefore meet every such pair.
Pairs in a list are counted by equal positional bytes, those with five or more
are verified bit by bit, and each list gives back a spanning set of its links only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, by_text, fresh_name, keyed_texts, stored
from markerloom.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 64
NEAR_BITS = 3
BYTES = 8
LEAST_EQUAL_BYTES = BYTES - NEAR_BITS
TRIPLES = tuple(t for half in (range(4), range(4, 8)) for t in combinations(half, 3))
#: A list with more members is split by two further positions, as linked pairs agree in two of the other five.
LIST_SIZE = 1024
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """64 bits, each the majority over the hashes of all shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    counts, total = np.zeros(BITS, dtype=np.int64), len(words) - width + 1
    for lot in range(0, total, 1 << 16):
        stop = min(total, lot + (1 << 16))
        pairs = zip(begins[lot:stop].tolist(), ends[lot + width - 1 : stop + width - 1].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), dtype="<u8", count=stop - lot)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tie, fp``: a hash of the text, and the fingerprint as a signed long. One row per row."""

    def work(keys: list[int | None], texts: list[str]) -> Iterable[dict[str, Any]]:
        import xxhash

        found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        ties = np.array([xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts], dtype=np.uint64).view(np.int64)
        yield {"doc_id": keys, "tie": ties, "fp": found}

    return by_text(keyed_texts(documents, key, text), "doc_id long, tie long, fp long", work)


def posting_keys(fp: Column) -> Column:
    """The eight postings of a fingerprint: number of the triple, then its three bytes."""
    byte = lambda i: F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))
    key = lambda n, t: F.lit(n << 24).cast("long") + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2])
    return F.array(*(key(n, t) for n, t in enumerate(TRIPLES)))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are linked: equal positional bytes are counted first, then the differing bits."""
    differ = a[:, None] ^ b[None, :]
    equal = np.zeros(differ.shape, dtype=np.uint8)
    for position in range(BYTES):
        equal += ((differ >> np.uint64(8 * position)) & np.uint64(255)) == 0
    near = equal >= LEAST_EQUAL_BYTES
    near[near] = np.bitwise_count(differ[near]) <= NEAR_BITS
    return near


class _Forest:
    """Joins members of one list; only joins that connect something new are kept."""

    def __init__(self, size: int) -> None:
        self.up, self.kept = list(range(size)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.kept.append((i, j))


def links_in_list(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all linked members (distinct fingerprints) of one list, at most one less than there are members."""
    forest = _Forest(len(members))
    groups: Iterator[np.ndarray] = iter([np.arange(len(members))])
    if len(members) > LIST_SIZE:
        groups = _split(members)
    for group in groups:
        for i in range(0, len(group), LIST_SIZE):
            left = group[i : i + LIST_SIZE]
            for j in range(i, len(group), LIST_SIZE):
                right = group[j : j + LIST_SIZE]
                rows, columns = np.nonzero(_near(members[left], members[right]))
                for a, b in zip(left[rows].tolist(), right[columns].tolist(), strict=True):
                    if a < b:
                        forest.join(a, b)
    return forest.kept


def _split(members: np.ndarray) -> Iterator[np.ndarray]:
    """Members by every two of the positions, for those lists in which not all agree."""
    parts = members.view(np.uint8).reshape(-1, BYTES).astype(np.int64)
    same = (parts == parts[0]).all(axis=0)
    fixed = np.flatnonzero(same)[:3]
    for one, two in combinations([p for p in range(BYTES) if p not in fixed], 2):
        value = parts[:, one] * 256 + parts[:, two]
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        yield from (g for g in np.split(order, cuts) if len(g) > 1)


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all that are near, as signed longs."""
    postings = fps.select("fp").distinct().select(F.explode(posting_keys(F.col("fp"))).alias("posting"), "fp")
    target = arrow_schema(fps.sparkSession, "a long, b long")

    def emit(found: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(whole[:, 0]), pa.array(whole[:, 1])], schema=target)

    def run(batches: Batches) -> Batches:
        held_keys, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            members = np.concatenate([held, batch.column(1).to_numpy()])
            # The last list may go on in the next batch.
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield emit(list(_of_lists(keys[:last], members[:last])))
            held_keys, held = keys[last:], members[last:]
        yield emit(list(_of_lists(held_keys, held)))

    return postings.repartition("posting").sortWithinPartitions("posting").mapInArrow(run, "a long, b long")


def _of_lists(keys: np.ndarray, members: np.ndarray) -> Iterator[np.ndarray]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    for i in np.flatnonzero(ends - begins > 1).tolist():
        own = members[begins[i] : ends[i]]
        found = links_in_list(own.view(np.uint64))
        if found:
            yield own[np.array(found)]


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tie, fp, component_id``: the smallest ``doc_id`` that links of near fingerprints reach.

    One row per row. Texts without words have fingerprint 0 and are linked like
    others; null keys are passed over for the smallest id (null if a component
    has no other); equal rows and exact copies share a fingerprint, so they cost
    one posting; no documents give no rows.
    """
    marked = stored(fingerprints(documents, key, text), "fingerprints")
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(links(own))
    rooted = own.join(stars, own["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each component: the smallest key, then the least text hash; rows without a key come last.

    All columns are kept. Rows that repeat both key and text count as one.
    """
    return keep_best(documents, near_duplicates(documents, key, text), key, text)


def keep_best(documents: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The best row of each ``root`` of ``found``, which has ``doc_id, tie, root`` of every row of ``documents``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("_doc"), F.col("best.tie").alias("_tie"))
    # The hash is Spark's own of the same bytes, with the seed that the fingerprints' hash has.
    tie = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    own = fresh_name(documents, "kept_tie")
    doc, text_tie = (fresh_name(documents, n) for n in ("kept_doc", "kept_text"))
    marked, best = documents.withColumn(own, tie), best.toDF(doc, text_tie)
    on = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text_tie))
    return marked.join(best, on, "left_semi").dropDuplicates([key, own]).drop(own)
