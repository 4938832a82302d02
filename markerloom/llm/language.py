"""Languages of texts by hyperdimensional profiles (operator 11).

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code
point. Three letters in a row are bound into one vector: the first is shifted
twice, the second once, and all three are multiplied. Bundling, the sum of the
vectors of all its n-grams, makes the profile of a text, and the sum over all
texts of a language makes the language's prototype. A text gets the language
whose prototype has the largest cosine with its own profile.

All sums are sums of whole numbers and so do not depend on how rows are dealt.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache, lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, by_text, keyed_texts, stored
from markerloom.llm.pretokens import in_groups

DIMENSIONS, SEED = 1024, 11
GRAM = 3
UNKNOWN = "und"
#: Prototypes are held by every task; more different values than this are an error.
MOST_LANGUAGES = 2000
#: Up to so many possible n-grams of a lot are counted by place, beyond it by sorting.
PLACES = 1 << 22
#: Cells of a table of texts by n-grams that are held at once.
CELLS = 4_000_000
#: Partial sums that one task of the first summing step adds up.
SUMS_TOGETHER = 256
PREDICTED = "doc_id long, lang_pred string, score double"
SUMS = "lang string, part int, profile binary"

LETTER, MARK = 1, 2


@cache
def symbols() -> np.ndarray:
    """What every code point is: a letter, a mark that belongs to letters, or neither (0)."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            table[point] = LETTER if kind == "L" else MARK
    return table


@lru_cache(maxsize=1 << 14)
def letter_vector(point: int) -> np.ndarray:
    """The signs of a letter; those of the gap between words have code point 0."""
    return np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as rows of code points."""
    points, place = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(p)) for p in points])
    place = place.reshape(grams.shape)
    bound = letters[place[:, -1]]
    for back in range(1, GRAM):
        bound = bound * np.roll(letters, back, axis=1)[place[:, -1 - back]]
    return bound


class Lot:
    """The n-grams of some texts: ``grams`` (code points), and for every occurrence its number and its text.

    Texts are lower-cased. Letters and marks count, all else is a gap, and a
    run of gaps is one. Every n-gram has a letter or mark in its middle, so none
    reaches across a gap or from one text into another.
    """

    def __init__(self, texts: list[str]) -> None:
        lower = [t.lower() for t in texts]
        points = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        kind = symbols()[points]
        solid = kind > 0
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])[solid[1:]]
        self.has_letter = np.zeros(len(texts), dtype=bool)
        self.has_letter[owner[kind[solid] == LETTER]] = True
        kept = solid.copy()
        kept[1:] |= solid[:-1]  # the first gap after a word
        kept[0] = True
        line = np.where(solid, points, 0)[kept]
        middle = np.flatnonzero(line)
        self.owner = owner
        self.grams, self.number = self._distinct(line, middle)

    @staticmethod
    def _distinct(line: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(middle):
            return np.zeros((0, GRAM), dtype=np.int64), np.zeros(0, dtype=np.int64)
        alphabet = np.flatnonzero(np.bincount(line))
        place = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
        place[alphabet] = np.arange(len(alphabet))
        short, size = place[line], len(alphabet)
        code = (short[middle - 1] * size + short[middle]) * size + short[middle + 1]
        if size**GRAM <= PLACES:
            found = np.flatnonzero(np.bincount(code, minlength=1))
            numbers = np.zeros(int(found[-1]) + 1, dtype=np.int64)
            numbers[found] = np.arange(len(found))
            number = numbers[code]
        else:
            found, number = np.unique(code, return_inverse=True)
        grams = np.stack([alphabet[found // (size * size)], alphabet[found // size % size], alphabet[found % size]], axis=1)
        return grams, number

    def profiles(self, group: np.ndarray, groups: int) -> np.ndarray:
        """Sums of n-gram vectors of the texts of each group; ``group`` is that of every text, -1 for none."""
        out = np.zeros((groups, DIMENSIONS))
        own = group[self.owner]
        used, number = own >= 0, self.number
        if not used.all():
            own, number = own[used], number[used]
        width = max(1, CELLS // max(1, groups))
        for begin in range(0, len(self.grams), width):
            vectors = self.grams[begin : begin + width]
            inside = (number >= begin) & (number < begin + len(vectors)) if len(self.grams) > width else slice(None)
            cells = own[inside] * len(vectors) + (number[inside] - begin)
            counts = np.bincount(cells, minlength=groups * len(vectors)).reshape(groups, len(vectors))
            # Whole numbers below 2^24 are exact in single precision, whatever the order of the sum.
            exact = np.float32 if counts.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
            out += counts.astype(exact) @ gram_vectors(vectors).astype(exact)
        return out


def _language_sums(rows: DataFrame) -> DataFrame:
    """``lang, part, profile``: sums of the texts that a task has read, one row per language that it met."""
    target = arrow_schema(rows.sparkSession, SUMS)

    def run(batches: Batches) -> Batches:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                lot = batch.slice(begin, 500)
                langs, texts = lot.column(0).to_pylist(), lot.column(1).to_pylist()
                for a, b in in_groups(texts):
                    names = sorted(set(langs[a:b]))
                    group = np.array([names.index(x) for x in langs[a:b]])
                    for name, profile in zip(names, Lot(texts[a:b]).profiles(group, len(names)), strict=True):
                        held[name] = held.get(name, 0) + profile
        for name, profile in held.items():
            yield pa.RecordBatch.from_pylist([{"lang": name, "part": part, "profile": profile.astype("<f8").tobytes()}], schema=target)

    return rows.mapInArrow(run, SUMS)


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, dtype="<f8") for p in frame["profile"])
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "part": frame["part"].iloc[:1], "profile": [total.tobytes()]})


def prototypes(documents: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of every language: the bundle of all texts that ``learn`` marks and that have a language.

    Each task sends one vector per language; these are summed in two steps, so
    that no task adds up more than a bounded share of them. What reaches the
    driver is one vector per language. Languages without any letter are left out.
    """
    chosen = documents.filter(learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    named = chosen.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    sums = _language_sums(named).groupBy("lang", F.floor(F.col("part") / SUMS_TOGETHER)).applyInPandas(lambda f: _added(f), SUMS)
    whole = stored(sums.groupBy("lang").applyInPandas(lambda f: _added(f), SUMS), "prototypes")
    if whole.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = {r["lang"]: np.frombuffer(r["profile"], dtype="<f8") for r in whole.collect()}
    return {name: profile for name, profile in sorted(found.items()) if profile.any()}


def predict(documents: DataFrame, known: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the language of the nearest prototype, and the cosine with it (below 0: 0).

    ``und`` and 0 for null texts, texts without a letter, and without any
    prototype. Equal cosines go to the smaller name. Null keys and repeated rows
    stay; texts of any length are read whole; no documents give no rows.
    """
    names = sorted(known)
    matrix = np.stack([known[n] / np.linalg.norm(known[n]) for n in names]) if names else np.zeros((0, DIMENSIONS))

    def work(keys: list[int | None], texts: list[str]) -> Iterable[dict[str, Any]]:
        for a, b in in_groups(texts):
            langs, scores = [UNKNOWN] * (b - a), np.zeros(b - a)
            if names:
                lot = Lot(texts[a:b])
                profiles = lot.profiles(np.arange(b - a), b - a)
                length = np.linalg.norm(profiles, axis=1)
                cosines = np.round(profiles @ matrix.T / np.where(length > 0, length, 1.0)[:, None], 9)
                best = cosines.argmax(axis=1)
                for i in np.flatnonzero(lot.has_letter & (length > 0)).tolist():
                    langs[i], scores[i] = names[best[i]], min(1.0, max(0.0, cosines[i, best[i]]))
            yield {"doc_id": keys[a:b], "lang_pred": langs, "score": scores}

    return by_text(keyed_texts(documents, key, text), PREDICTED, work, rows=200)


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from: every fourth by the checksum of the key. A null key is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
