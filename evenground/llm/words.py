"""Whole-text token ids of a lower-casing word BPE, encoded word by word and remembered.

The tokenizer splits a text into words before it merges, so a word's ids don't depend on its neighbours. Words of plain
Latin text are split here and looked up; the missing ones of a batch go to the tokenizers library together, and each
word's ids end where the end-of-word mark is. Any text with other characters goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Words that one Python worker remembers; then it starts afresh.
REMEMBERED = 1_000_000
#: Characters on which this module's splitting and the library's might differ.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e -±´-¸º»¿-ɏ‐-‧‰-›₠-₿]|<\|")
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, number in self.library.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text, as the library gives them without special tokens added."""
        plain = [not _OTHER.search(t) for t in texts]
        split = [_WORD.findall(t.lower()) if p else () for t, p in zip(texts, plain, strict=True)]
        wanted = set().union(*split)
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known.clear()
        self._learn([w for w in wanted if w not in self.known])
        whole = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) if p else np.array(next(whole).ids, "<u4").tobytes() for words, p in zip(split, plain, strict=True)]

    def _learn(self, words: list[str]) -> None:
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                data, places = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.known.update((w, data[a:b]) for w, a, b in zip(part, places, places[1:], strict=False))
            else:  # e.g. a mark that joins its neighbour
                for word in part:
                    self.known[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    return WordEncoder(path)
