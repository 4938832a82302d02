"""Splits texts into the pieces that byte-level BPE merges work on, in vectorised form.

The pattern is that of the public rank files: contractions, runs of letters,
of digits and of other signs, each with one leading space, and white space.
A token starts only where the character class changes or at a few spots around
white space and apostrophes, so all starts of many texts come from array
operations. Distinct words are found by a 64-bit hash that is then compared
character by character, so the result is exact.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: What the pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters handled at once; bounds the memory of the arrays below.
CHARS_AT_ONCE = 1_500_000


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = DIGIT
    table[list(WHITE_SPACE)] = SPACE
    return table


def _code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters one after another, and where each text begins (with the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return points, ends


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """True where a word begins. ``text_starts`` has the total as its last entry."""
    n = len(points)
    starts = np.zeros(n, dtype=bool)
    if not n:
        return starts
    kind = classes()[points]
    opens = np.zeros(n + 1, dtype=bool)
    opens[text_starts] = True
    blank = points == 0x20
    change = kind[1:] != kind[:-1]
    space = kind == SPACE
    # A class change starts a word, unless one plain blank joins the word after it.
    starts[1:] = change & ~(blank[:-1] & ~space[1:])
    # The last white-space character before other text stands apart from those before it.
    starts[:-1] |= space[:-1] & ~space[1:] & ~opens[1:-1]
    starts |= opens[:-1]
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        alone = opens[marks]
        before = np.where(alone, 0, points[marks - 1])
        joined = ~alone & ((kind[marks - 1] == OTHER) | (before == 0x20))
        nexts = text_starts[np.searchsorted(text_starts, marks, side="right")]
        for mark, end in zip(marks[~joined].tolist(), nexts[~joined].tolist(), strict=True):
            after = points[mark + 1 : min(mark + 3, end)]
            found = next((c for c in CONTRACTIONS if len(after) >= len(c) and all(after[i] == ord(x) for i, x in enumerate(c))), None)
            if found:
                starts[mark + 1] = False
                stop = mark + 1 + len(found)
                if len(found) == 2:
                    starts[mark + 2] = False
                if stop < n:
                    starts[stop] = True
    return starts


def blank_word_starts(points: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of characters that are not ASCII white space."""
    solid = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    edges = np.zeros(len(points) + 1, dtype=bool)
    edges[text_starts] = True
    before = np.zeros(len(points), dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(points), dtype=bool)
    after[:-1] = solid[1:]
    begins = np.flatnonzero(solid & (~before | edges[:-1]))
    ends = np.flatnonzero(solid & (~after | edges[1:])) + 1
    return begins, ends


@cache
def position_weights(size: int) -> np.ndarray:
    """Odd 64-bit factors for the positions in a word."""
    x = (np.arange(1, size + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def distinct(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one word for each distinct word, and for every word its number among them."""
    lengths = (ends - begins).astype(np.int32)
    if not len(begins):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(lengths, dtype=np.int64) - lengths
    total = int(firsts[-1]) + int(lengths[-1])
    offset = np.arange(total, dtype=np.int32) - np.repeat(firsts.astype(np.int32), lengths)
    # The characters of all words in a row; words without gaps are the text itself.
    chars = points if total == len(points) else points[offset + np.repeat(begins.astype(np.int32), lengths)]
    mixed = (chars + np.uint32(1)) * position_weights(1 << max(6, int(lengths.max()).bit_length()))[offset]
    mixed ^= mixed >> np.uint64(31)
    hashed = np.add.reduceat(mixed, firsts) * np.uint64(0x94D049BB133111EB)
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    alike = first[number]
    if np.array_equal(lengths[alike], lengths):
        offset += np.repeat(firsts[alike].astype(np.int32), lengths)
        if np.array_equal(chars[offset], chars):
            return first, number
    seen: dict[bytes, int] = {}  # two words share a hash: compare by content
    order, number = [], np.empty(len(begins), dtype=np.int64)
    for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        key = points[b:e].tobytes()
        if key not in seen:
            seen[key] = len(order)
            order.append(i)
        number[i] = seen[key]
    return np.asarray(order, dtype=np.int64), number


def in_groups(texts: Sequence[str], limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` characters together, or one text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def split_words(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of every word among them, and how many words each text has."""
    joined = "".join(texts)
    points, text_starts = _code_points(texts)
    begins = np.flatnonzero(word_starts(points, text_starts))
    ends = np.append(begins[1:], len(points))
    first, number = distinct(points, begins, ends)
    words = [joined[b:e] for b, e in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
    counts = np.diff(np.searchsorted(begins, text_starts))
    return words, number, counts


def split_blank_words(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``split_words``, for runs without ASCII white space."""
    joined = "".join(texts)
    points, text_starts = _code_points(texts)
    begins, ends = blank_word_starts(points, text_starts)
    first, number = distinct(points, begins, ends)
    words = [joined[b:e] for b, e in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
    counts = np.diff(np.searchsorted(begins, text_starts))
    return words, number, counts


class WordCache:
    """Results for words, computed in lots and kept in two generations of bounded size.

    Longer words than ``LONGEST`` are computed each time, so that bytes are bounded, too.
    """

    LONGEST = 64

    def __init__(self, compute: Callable[[list[str]], list], size: int = 250_000) -> None:
        self.compute, self.size = compute, size
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def get(self, words: list[str]) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = []
        for i, found in enumerate(out):
            if found is None:
                kept = old.get(words[i])
                if kept is None:
                    missing.append(i)
                else:
                    out[i] = young[words[i]] = kept
        if missing:
            for i, made in zip(missing, self.compute([words[i] for i in missing]), strict=True):
                out[i] = made
                if len(words[i]) <= self.LONGEST:
                    young[words[i]] = made
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


def gather(parts: Sequence[np.ndarray], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins ``parts[i] for i in number``; also the length of each."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.concatenate(parts) if len(parts) else np.zeros(0, dtype=np.uint32)
    return gather_flat(flat, sizes, number)


def gather_flat(flat: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    firsts = np.cumsum(sizes) - sizes
    lengths = sizes[number]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(firsts[number] - (ends - lengths), lengths)
    return flat[index], lengths
