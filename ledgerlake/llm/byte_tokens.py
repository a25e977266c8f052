"""Byte-level BPE ids of whole texts, with the tokenizers library and a memory of words it has seen.

The pattern of a byte-level BPE starts a new piece at a blank or line feed that stands between two other characters, and
between letters and the punctuation after them. Texts are therefore cut at single blanks and line feeds; every different word
is encoded once while a worker remembers it, and a text's ids are the joined ids of its words. Words are told apart by 64-bit
hashes of their bytes. Texts with other white space, with runs of it or with it at an end, and texts that hold the string of a
special token are encoded whole, as the library does it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa

from ledgerlake.llm.common import quiet_threads, tokenizer_file
from ledgerlake.llm.word_memory import WordValues, plain_texts
from ledgerlake.llm.words import Words, chunks

_WORD_AND_TAIL = re.compile(r"([^\W\d_]+)([^\w\s]+)\Z").match
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_FEED = 198  #: the id of "\n", a piece of its own between words


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. Remembers up to `keep` words, some 200 bytes each."""

    def __init__(self, file: str | None = None, keep: int = 800_000):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file or tokenizer_file("byte_bpe_50k.json"))
        self.special = tuple(str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.feed = np.array([_FEED], "<u4").tobytes()
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that spell themselves
        others = [b for b in range(256) if b not in set(printed)]
        self.spelling = {b: b for b in printed} | {b: 256 + k for k, b in enumerate(others)}
        self.blank = chr(self.spelling[32])
        self.bases: dict[str, bytes] = {}  #: words without the punctuation after them
        self.tails: dict[str, bytes] = {}
        probe = ["Straße", "of", "queaciónñ", "Éleque"]
        self.spells = [self._spelt(w) for w in probe] == self.whole([" " + w for w in probe])
        self.cuts = self.whole(["\n"])[0] == self.feed and self.whole(["a,\nb c."])[0] == b"".join(self.whole(["a", ",", "\n", "b", " c", "."]))
        self.words = WordValues(self._learn, keep)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelt(self, word: str) -> bytes:
        """Ids of a Latin word that stands after a blank: one piece, which the model takes in its spelling of bytes."""
        piece = self.blank + (word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling))
        t = self.tokenizer.model.tokenize(piece)
        return pack("<%dI" % len(t), *[x.id for x in t])

    def _parted(self, words: list[str]) -> list[bytes]:
        """Ids of words (a blank may stand before one), many to a call, parted by line feeds."""
        out = []
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            raw = self.whole(["\n".join(part)])[0]
            ends = np.flatnonzero(np.frombuffer(raw, dtype="<u4") == _FEED).tolist()
            low = 0
            for high in [*ends, len(raw) // 4]:
                out.append(raw[4 * low : 4 * high])
                low = high + 1
        return out

    def _learn(self, words: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of each word after a blank; of one that stands first in its line, those of a line feed and the word."""
        if len(self.bases) > 300_000:
            self.bases.clear()
        if len(self.tails) > 10_000:
            self.tails.clear()
        bases = self.bases
        out: list[bytes | None] = [None] * len(words)
        tailed, other = [], []
        for i, (w, first) in enumerate(words):
            if not first and self.spells and (m := _WORD_AND_TAIL(w)) is not None and _PLAIN(m[1]):
                tailed.append((i, *m.groups()))
            elif not first and self.spells and _PLAIN(w):
                if (ids := bases.get(w)) is None:
                    ids = bases[w] = self._spelt(w)
                out[i] = ids
            else:
                other.append(i)
        for i, base, tail in tailed:
            if (ids := bases.get(base)) is None:
                ids = bases[base] = self._spelt(base)
            if (end := self.tails.get(tail)) is None:
                end = self.tails[tail] = self.whole([tail])[0]
            out[i] = ids + end
        for i, ids in zip(other, self._parted([w if first else " " + w for w, first in (words[i] for i in other)]), strict=True) if other else ():
            out[i] = self.feed + ids if words[i][1] else ids
        return out

    def _chunk(self, w: Words) -> list[bytes]:
        out = [b""] * w.texts
        cut = plain_texts(w, self.special) if self.cuts else np.zeros(w.texts, dtype=bool)
        size = np.diff(w.offsets)
        rest = np.flatnonzero(~cut & (size > 0)).tolist()
        for low in range(0, len(rest), 100):
            part = rest[low : low + 100]
            for i, ids in zip(part, self.whole([w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().decode() for i in part]), strict=True):
                out[i] = ids
        number, bounds = self.words.of(w, cut)
        get, bounds = self.words.values.__getitem__, bounds.tolist()
        for i in np.flatnonzero(cut).tolist():
            out[i] = b"".join(map(get, number[bounds[i] : bounds[i + 1]].tolist()))[4:]
        return out

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text in a column of strings; null counts as empty."""
        for w in chunks(column):
            yield from self._chunk(w)


@cache
def shared_encoder(file: str | None = None) -> Encoder:
    """One encoder for all tasks that a Python worker runs, so later ones find words that earlier ones met."""
    return Encoder(file)
