"""Token ids by a public tokenizer's library, with a memo of chunks.

The vocabulary ``word_bpe_49k.json`` drops white space and never makes a token across it, so a text's ids are the ids of
its chunks between spaces and line breaks, one after the other. Each worker keeps the ids of chunks it has met and hands
the library only new ones, in batches. The memo is emptied when it reaches ``MEMO_CHUNKS`` chunks, which bounds a
worker's memory and changes no result.

Where it changes no id, a text is put in small letters first and its commas and full stops are set off, so that fewer
chunks are new: in texts of Latin-1 letters without ``<|``, which might become a special token.
"""

from __future__ import annotations

import os
import re
from functools import cache
from unicodedata import normalize

import numpy as np

MEMO_CHUNKS = 500_000
LONGEST_KEPT = 64
VOCABULARY = "word_bpe_49k.json"
#: Marks that are neither letters nor digits. Fixed values.
SIGNS = ".,;:!?*%#$&()-"
#: A sign that follows anything but a letter or digit may be one token with it.
JOINED_SIGN = re.compile(r"(?<![a-z0-9à-öø-ÿ])[.,] ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ends_word(path: str) -> np.ndarray:
    """For each id whether its token ends a word."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        out[i] = token.endswith("</w>")
    return out


def _chunks(text: str | None) -> list[str]:
    text = (text or "").replace("\n", " ")
    if "<|" not in text and _latin(text):
        text = text.lower()
        if not JOINED_SIGN.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _stays_letters(word: str) -> bool:
    """Whether normalising and small letters leave nothing but letters, with which no sign can join."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers, or their counts.

    New chunks of letters alone are encoded many at a time in one text, and cut where a token ends a word; where there are
    more word ends than words (a letter whose small form is no letter), one by one. Letters with signs after them are
    the ids of the letters and then those of the signs, which never join. Other chunks are encoded one by one.
    """

    def __init__(self, path: str, counts: bool = False):
        self.library, self.ends, self.counts = _tokenizer(path), _ends_word(path), counts
        self.memo: dict = {}
        self.signs: dict = {}

    def _each(self, chunks: list[str]) -> list:
        found = self.library.encode_batch_fast(chunks, add_special_tokens=False)
        return [len(e.ids) for e in found] if self.counts else [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list:
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        if self.counts:
            return np.diff(ends, prepend=0).tolist()
        held, ends = ids.tobytes(), (4 * ends).tolist()
        return [held[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: set[str]) -> None:
        """Put chunks into the memo that aren't in it."""
        memo, plain = self.memo, list(filter(str.isalpha, new))
        rest = new.difference(plain)
        cut = [(c, c.rstrip(SIGNS)) for c in rest]
        signed = [(c, word) for c, word in cut if _stays_letters(word)]
        plain += {word for _, word in signed}.difference(memo, plain)
        for i in range(0, len(plain), 4096):
            memo.update(zip(plain[i : i + 4096], self._letters(plain[i : i + 4096])))
        for c, word in signed:
            sign = c[len(word) :]
            if sign not in self.signs:
                if len(self.signs) > MEMO_CHUNKS:
                    self.signs.clear()
                self.signs[sign] = self._each([sign])[0]
            memo[c] = memo[word] + self.signs[sign]
        other = list(rest.difference(c for c, _ in signed))
        memo.update(zip(other, self._each(other)))

    def _parts(self, texts: list[str | None]) -> list[list]:
        """For each text the entries of its chunks."""
        cut = [_chunks(t) for t in texts]
        if len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
        memo = self.memo
        new = set().union(*cut).difference(memo)
        self._learn(new)
        out = [[memo[c] for c in chunks] for chunks in cut]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del memo[c]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return list(map(b"".join, self._parts(texts)))

    def n_tokens(self, texts: list[str | None]) -> list[int]:
        return list(map(sum, self._parts(texts)))
