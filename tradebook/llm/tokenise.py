"""Whole texts to ids of the public word BPE, each distinct word encoded by the tokenizers library once per worker.

White space separates pre-tokens of this vocabulary and is dropped, so the ids
of a text are those of its white-space chunks in a row.  ``Words`` keeps the ids
of chunks it has met in a memory of bounded size.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

_MARKS = b".,!#$%&*|:;?-"  # a letter before a run of these is always a border of pre-tokens
_SPECIAL = b"<|"
MOST_WORDS, MOST_CHUNKS = 300_000, 150_000  # kept per worker, about


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ends_in_letter(chunk: bytes) -> bool:
    last = chunk[-4:].decode("utf-8", "ignore")[-1:].lower()[-1:]  # some letters gain a mark when made small
    return last.isalpha()


def _cut(chunk: bytes) -> tuple[bytes, bytes]:
    """A chunk without the marks at its end, and these; nothing is cut where no letter stands before them."""
    bare = chunk.rstrip(_MARKS)
    if len(bare) == len(chunk) or not bare or not (97 <= bare[-1] <= 122 or _ends_in_letter(bare)):
        return chunk, b""
    return bare, chunk[len(bare) :]


def _is_small(word: str) -> bool:
    """True for letters that neither normalising nor making small would change."""
    return word.isalpha() and (word.isascii() or word == word.lower() and unicodedata.is_normalized("NFC", word))


class Memory(dict):
    """Two generations: what is asked for again moves to the younger, so words in use stay when the older one goes."""

    old: dict = {}

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.old[key]
        return value

    def lacks(self, keys: Iterable[bytes]) -> set[bytes]:
        return {k for k in keys if k not in self and k not in self.old}

    def age(self, most: int) -> None:
        """Drop the older generation once the younger holds half of ``most``."""
        if len(self) > most // 2:
            self.old = dict(self)
            self.clear()


class Words:
    """Ids of chunks as little-endian 32-bit integers, kept in a memory of bounded size."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        # the same vocabulary and merges for words of small letters, which its normaliser and its pattern leave as they are
        self.small = Tokenizer.from_file(path)
        self.small.no_truncation()
        self.small.normalizer = None
        self.small.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._bare = Memory()  # chunks without the marks at their ends
        self._chunks = Memory()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        """Encode new chunks together: the library is far faster on many words in one string."""
        whole = [c for c in new if c.isalpha()]  # A-Z alone
        cut = [(c, *_cut(c)) for c in new.difference(whole)]
        bare = self._bare.lacks(set(whole).union([b for _, b, _ in cut], [m for _, _, m in cut]))
        small = [b for b in bare if b.isalpha()]
        rest = [(b, b.decode()) for b in bare.difference(small)]
        small += [b for b, w in rest if _is_small(w)]
        other = [b for b, w in rest if not _is_small(w)]
        for at in range(0, len(small), 200):
            part = small[at : at + 200]
            found = self.small.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) == len(part) and ends[-1] == 4 * len(ids):  # one end of word for each word
                raw, stops = ids.tobytes(), ends.tolist()
                self._bare.update(zip(part, [raw[a:e] for a, e in zip([0, *stops], stops)]))  # noqa: B905
            else:
                other += part
        self._bare.update(zip(other, self._whole([b.decode() for b in other]), strict=True))
        known = self._bare
        self._chunks.update([(c, known[c]) for c in whole])
        self._chunks.update([(c, known[b] + known[m]) for c, b, m in cut])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        self._chunks.age(MOST_CHUNKS)
        self._bare.age(MOST_WORDS)
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        chunks = [None if _SPECIAL in r else r.lower().split() for r in raw]  # A-Z only; the vocabulary is in small letters
        self._learn(self._chunks.lacks(set().union(*[c for c in chunks if c])))
        get = self._chunks.__getitem__
        return [
            self._whole([r.decode()])[0] if c is None else b"".join(map(get, c)) for r, c in zip(raw, chunks, strict=True)
        ]


@lru_cache(2)
def words(path: str) -> Words:
    """The worker's own memory for a vocabulary."""
    return Words(path)
