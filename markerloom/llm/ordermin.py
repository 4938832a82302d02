"""Order MinHash fingerprints of whole texts (operator 4), in DataFrame functions alone.

The k-mers of a text are runs of ``SHINGLE`` words; a k-mer that occurs again
is a new one, told apart by its occurrence number. One hash deals them to
``SKETCHES`` bins and orders them there. Of each bin the ``TUPLE`` smallest are
taken, put back into text order and hashed together, so a signature changes
when chosen k-mers change and also when they trade places. The likeness of two
fingerprints is the share of equal signatures among the bins that either fills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerloom.llm.common import keyed_texts

SHINGLE, TUPLE = 3, 2
#: Bits of a packed number that hold the place in the text; the hash has the rest.
PLACE_BITS = 28
BIN_BITS = 6
ROWS_PER_BUCKET = 500
MOST_BUCKETS = 1 << 16

_PLACE = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """Runs without ASCII white space; empty for a text without any."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def _hash_part(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _placed(hashed: Column, place: Column) -> Column:
    """Hash in the high bits, place in the low ones: sorts by hash, then place, as a plain number."""
    return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)


def with_kmers(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds packed hash and place of all k-mers, sorted by both."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    kmer = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE)))
    return df.withColumn(out, F.sort_array(F.transform(places, lambda i: _placed(kmer(i), i.cast("long")))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of ``text`` as an array of signatures, one per bin that is filled."""
    names = [f"_{out}_{step}" for step in ("words", "kmers", "marks", "chosen")]
    words, kmers, marks, chosen = names
    df = with_kmers(df.withColumn(words, words_of(F.col(text))), words, kmers)
    first = F.filter(
        F.sequence(F.lit(0), F.size(kmers) - 1),
        lambda i: (i == 0) | (_hash_part(F.get(kmers, i)) != _hash_part(F.get(kmers, i - 1))),
    )
    df = df.withColumn(marks, F.when(F.size(kmers) > 0, first).otherwise(F.array().cast("array<int>")))
    numbered = lambda i, begin: _placed(
        F.xxhash64(_hash_part(F.get(kmers, i)), i - begin), F.get(kmers, i).bitwiseAND(F.lit(_PLACE))
    )
    runs = F.transform(
        marks,
        lambda begin, j: F.transform(
            F.sequence(begin, F.coalesce(F.get(marks, j + 1), F.size(kmers)) - 1), lambda i: numbered(i, begin)
        ),
    )
    df = df.withColumn(chosen, F.sort_array(F.flatten(runs)))
    # Sorted as signed numbers, so bins come in a fixed order; the smallest of each stand first.
    smallest = F.filter(chosen, lambda x, i: (i < TUPLE) | (_bin(F.get(chosen, i - TUPLE)) != _bin(x)))
    df = df.withColumn(chosen, smallest)
    heads = F.filter(
        F.sequence(F.lit(0), F.size(chosen) - 1), lambda i: (i == 0) | (_bin(F.get(chosen, i)) != _bin(F.get(chosen, i - 1)))
    )
    signatures = F.transform(heads, lambda i: _signature(chosen, i))
    return df.withColumn(out, F.when(F.size(chosen) > 0, signatures).otherwise(F.array().cast("array<bigint>"))).drop(*names)


def _bin(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - BIN_BITS)


def _signature(chosen: str, head: Column) -> Column:
    """Bin in the high bits, then the hash of the bin's chosen k-mers in text order."""
    own = _bin(F.get(chosen, head))
    members = F.filter(F.slice(chosen, head + 1, TUPLE), lambda x: _bin(x) == own)
    by_place = F.transform(members, lambda x: F.shiftleft(x, 64 - PLACE_BITS).bitwiseOR(_hash_part(x)))
    ordered = F.transform(F.sort_array(by_place), lambda x: x.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1)))
    return F.shiftleft(own, 64 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(ordered), BIN_BITS))


def as_text(fingerprint: Column) -> Column:
    """The signatures as one hex text."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among the bins that either text fills; 1 for two texts without words."""
    filled = F.size(F.array_union(F.transform(a, _bin), F.transform(b, _bin)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _slots(texts: DataFrame) -> Column:
    """Order-preserving number of a narrow range of keys; falls as the key falls, nulls lowest.

    About ``ROWS_PER_BUCKET`` rows share one if keys are spread evenly, and
    there are at most ``MOST_BUCKETS``. Rows without a key are dealt by their text's hash.
    """
    seen = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    count = min(MOST_BUCKETS, max(1, seen["n"] // ROWS_PER_BUCKET))
    width = max(1.0, (high - low + 1) / count)
    ranged = F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)).cast("long")
    untold = -(F.shiftright("tie", 58) + 33)
    return F.when(F.col("doc_id").isNull(), untold).otherwise(ranged)


def with_next(texts: DataFrame, carried: list[str], computed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``next``, a struct of the ``carried`` columns of the next row by falling ``doc_id``, after the last the first.

    ``texts`` has ``doc_id, text`` and what is carried, or ``computed`` adds it. Ties are ordered by the
    text's hash, then the text; rows equal in both can follow each other in any
    order, as they are alike. Rows are ordered inside narrow key ranges, and
    the first row of each range serves the last one of the range before it.
    These first rows are found before ``computed`` is applied, so that only
    theirs is done twice.
    """
    computed = computed or (lambda df: df)
    tied = texts.withColumn("tie", F.xxhash64("text"))
    tied = tied.withColumn("slot", _slots(tied))
    order = [F.desc("doc_id"), F.asc("tie"), F.asc("text")]
    inside = Window.partitionBy("slot").orderBy(*order)
    moved = computed(tied).withColumn("next", F.lead(F.struct(*carried)).over(inside))
    rank = F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("falling"), "tie", "text")
    heads = tied.groupBy("slot").agg(F.min_by(F.struct(*texts.columns), rank).alias("head"))
    firsts = computed(heads.select("slot", "head.*")).select("slot", F.struct(*carried).alias("first"))
    all_slots = Window.orderBy(F.desc("slot"))
    follows = (
        tied.groupBy("slot").agg(F.lit(1).alias("_one"))
        .select("slot", F.lead("slot").over(all_slots).alias("after"), F.max("slot").over(Window.partitionBy()).alias("top"))
        .select(F.col("slot").alias("from"), F.coalesce("after", "top").alias("slot"))
    )
    bounds = firsts.join(follows, "slot").select(F.col("from").alias("slot"), "first")
    joined = moved.join(bounds, "slot", "left")
    return joined.withColumn("next", F.coalesce("next", "first")).drop("first", "slot", "tie")


def compare_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document are.

    Edited: the last third of the characters replaced by as many first ones of
    the next document. Columns ``doc_id, n_chars, edited, fingerprint,
    edited_fingerprint`` (arrays of signatures), ``near_edited, near_next``.
    Null and empty texts have no signatures and are fully alike to each other; a text of
    fewer than ``SHINGLE`` words is one k-mer; repeated rows stay; a single
    document follows itself; no documents give no rows.
    """
    near = with_next(keyed_texts(documents, key, text), ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", "fingerprint"))
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    near = near.select(
        "doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint")
    )
    both = with_fingerprint(near, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
