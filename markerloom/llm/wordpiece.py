"""Word-piece counts by a longest-match automaton (operator 10).

A word's pieces are the longest vocabulary entry at its beginning, then the
longest continuing entry, and so on. The trie of all entries has failure links:
where no edge goes on, the entries already certain are popped and the rest of
what was read stands at the link's end. Only how many are popped is stored, so
a word is read once, letter by letter, and no piece is built. The bare word mark
is an entry, too: where no longer one begins the word, it is the first piece and
continuing entries spell the whole word.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from markerloom.llm.common import by_text, keyed_texts
from markerloom.llm.pretokens import WordCache, in_groups, split_blank_words
from markerloom.llm.tokens import vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Fixed value: marks pieces at the beginning of a word in the vocabulary file.
WORD_BEGIN = "▁"
COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Entries that begin a word and entries that continue one; control, unknown and byte entries are left out.

    The empty beginning entry stands for the bare word mark. Byte entries are no text: with them
    no word would be outside the vocabulary, and ``n_unknown`` counts just these words.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, go_on = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(WORD_BEGIN):
            begin.add(piece[1:])
        else:
            go_on.add(piece)
    usable = lambda entries: sorted(x for x in entries if WORD_BEGIN not in x)
    return usable(begin), usable(go_on)


class LongestMatch:
    """The automaton. Node 0 is the beginning of a word, node 1 the place after a piece."""

    BEGIN, AFTER = 0, 1

    def __init__(self, begin: Sequence[str], go_on: Sequence[str]) -> None:
        self.edges: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, entries in ((self.BEGIN, begin), (self.AFTER, go_on)):
            for entry in entries:
                node = root
                for letter in entry:
                    following = self.edges[node].get(letter)
                    if following is None:
                        following = self.edges[node][letter] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    node = following
                whole[node] = True
        self.link: list[int] = [-1] * len(self.edges)
        self.popped: list[int] = [0] * len(self.edges)
        if "" in begin:
            self.link[self.BEGIN], self.popped[self.BEGIN] = self.AFTER, 1
        waiting = deque([self.BEGIN, self.AFTER])
        while waiting:
            parent = waiting.popleft()
            for letter, node in self.edges[parent].items():
                if whole[node]:
                    self.link[node], self.popped[node] = self.AFTER, 1
                else:
                    at, count = self.link[parent], self.popped[parent]
                    while at >= 0 and letter not in self.edges[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.edges[at][letter], count
                waiting.append(node)

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if the vocabulary cannot spell it; 0 for the empty word."""
        edges, link, popped = self.edges, self.link, self.popped
        node, pieces = self.BEGIN, 0
        for letter in word:
            following = edges[node].get(letter)
            while following is None:
                pieces += popped[node]
                node = link[node]
                if node < 0:
                    return -1
                following = edges[node].get(letter)
            node = following
        while node > self.AFTER:
            pieces += popped[node]
            node = link[node]
        return pieces if node >= 0 else -1


class TextCounter:
    def __init__(self, path: str) -> None:
        self.automaton = LongestMatch(*read_pieces(path))
        self.words = WordCache(lambda words: [self.automaton.count(w) for w in words])

    def count(self, texts: Sequence[str]) -> list[tuple[int, int, int]]:
        """Words, tokens and words outside the vocabulary of every text; such a word is one token."""
        out: list[tuple[int, int, int]] = []
        for begin, end in in_groups(texts):
            words, number, n_words = split_blank_words(texts[begin:end])
            pieces = np.array(self.words.get(words), dtype=np.int64)
            unknown = pieces < 0
            sums = [np.concatenate([[0], np.cumsum(x[number])]) for x in (np.where(unknown, 1, pieces), unknown.astype(np.int64))]
            bounds = np.concatenate([[0], np.cumsum(n_words)])
            tokens, missed = (np.diff(s[bounds]).tolist() for s in sums)
            out += zip(n_words.tolist(), tokens, missed, strict=True)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    """One per Python worker."""
    return TextCounter(path)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", pieces: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every text; words are runs without ASCII white space.

    Null and empty texts count nothing; null keys and repeated rows stay; a word
    of any length takes time in proportion; no documents give no rows.
    """
    path = pieces or vocabulary_path(PIECES)

    def work(keys: list[int | None], texts: list[str]) -> Iterable[dict[str, Any]]:
        found = counter(path).count(texts)
        yield {"doc_id": keys, "n_words": [x[0] for x in found], "n_tokens": [x[1] for x in found], "n_unknown": [x[2] for x in found]}

    return by_text(keyed_texts(documents, key, text), COUNTS, work)
