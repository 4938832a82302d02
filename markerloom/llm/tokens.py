"""Token ids of whole texts by a public vocabulary file, each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from markerloom.llm.pretokens import WordCache, gather, in_groups, split_words

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: visible ones for themselves, the others from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextEncoder:
    """The ``tokenizers`` library's merges on distinct words.

    Byte-level BPE never merges across words, so the ids of a text are those of
    its words one after another. Words are found here, by the same pattern, and
    go to the library's model directly, which takes half the time of a call with
    its own search for words. The file's added tokens are cut out before and
    give their own ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` does.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        stated = json.loads(self.tokenizer.to_str())
        if stated["normalizer"] is not None or {k: (stated["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
            raise ValueError("only plain byte-level files are supported")
        self.letters = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})
        self.words = WordCache(self._encode)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.added = {t.content: np.array([i], dtype=np.uint32) for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        return [np.array([t.id for t in merge(w.encode().decode("latin-1").translate(letters))], dtype=np.uint32) for w in words]

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        whole = [bool(self.cut and self.cut.search(t)) for t in texts]
        if not any(whole):
            yield from self._encode_plain(texts)
            return
        # Odd pieces of a cut text are added tokens.
        pieces = [self.cut.split(t) if w else [t] for t, w in zip(texts, whole, strict=True)]
        plain = self._encode_plain([x for p in pieces for x in p[::2]])
        for p in pieces:
            yield np.concatenate([self.added[x] if i % 2 else next(plain) for i, x in enumerate(p)])

    def _encode_plain(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        for begin, end in in_groups(texts):
            words, number, counts = split_words(texts[begin:end])
            ids, sizes = gather(self.words.get(words), number)
            bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            for i in range(end - begin):
                yield ids[bounds[i] : bounds[i + 1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One per Python worker."""
    return TextEncoder(path)
