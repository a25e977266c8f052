"""What a worker remembers of words: a hash table of 64-bit word keys that looks up many at once, with a bounded size."""

from __future__ import annotations

import numpy as np

from ledgerlake.llm.words import Words

_ODD = np.zeros(256, dtype=bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", *(b"\xe2\x80" + bytes([k]) for k in range(0x80, 0x8B)))


class Memory:
    """Numbers 0, 1, 2, ... for keys, in the order in which they came; forgets everything when it would hold more than `keep` keys."""

    def __init__(self, keep: int):
        self.keep = keep
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Forget all; room: for so many keys at least (a chunk of texts may have more words than `keep`)."""
        self.size = 0
        self.bits = max(8, int(np.ceil(np.log2(2 * max(self.keep, room)))))
        self.key = np.zeros(1 << self.bits, dtype=np.uint64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = self._slot(keys)
        out = self.at[slot]
        left = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[left] = self.at[slot]
            go = (out[left] >= 0) & (self.key[slot] != keys[left])
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number different keys that it doesn't hold, in turn."""
        number = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.at[slot] < 0)
            self.at[slot[free]] = number[free]  # of several keys for one slot the last one stays
            won = free[self.at[slot[free]] == number[free]]
            self.key[slot[won]] = keys[won]
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            keys, number, slot = keys[lost], number[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)


def plain_texts(w: Words, but: tuple[bytes, ...] = ()) -> np.ndarray:
    """Which texts have words parted by single blanks or line feeds only, no other white space, and none of the strings `but`."""
    n = np.bincount(w.text, minlength=w.texts)
    inside = np.bincount(w.text, weights=w.end - w.start, minlength=w.texts)
    plain = (n > 0) & (np.diff(w.offsets) - inside == n - 1)
    data = w.data[: w.offsets[-1]]
    odd = [np.flatnonzero(_ODD[data])]
    raw = data.tobytes()
    for s in (*_LEADS, *but):
        at = raw.find(s)
        while at >= 0:
            odd.append(np.array([at]))
            at = raw.find(s, at + 1)
    odd = np.concatenate(odd)
    if len(odd):
        plain[np.searchsorted(w.offsets, odd, side="right") - 1] = False
    return plain


class WordValues:
    """Remembered values of words; `learn` gives those of new words: a list for [(word, whether it stands first in its line)].

    heads: whether a text's first word counts as one that stands first in a line.
    """

    FIRST = np.uint64(0xD1B54A32D192ED03)

    def __init__(self, learn, keep: int, heads: bool = True):
        self.learn, self.memory, self.values, self.heads = learn, Memory(keep), [], heads

    def of(self, w: Words, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of values, bounds): those of the marked texts' words in turn, and where each text's words begin and end in them."""
        at = np.flatnonzero(texts[w.text])
        sub = w._replace(start=w.start[at], end=w.end[at], text=w.text[at])
        head, first = sub.start == w.offsets[sub.text], w.data[sub.start - 1] == 10
        first = first | head if self.heads else first & ~head
        with np.errstate(over="ignore"):
            keys = sub.hashes() ^ np.where(first, self.FIRST, np.uint64(0))
        bounds = np.searchsorted(sub.text, np.arange(w.texts + 1))
        number = self.memory.find(keys)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            if self.memory.size + len(new) > self.memory.keep:
                missing = np.arange(len(keys))
                new, where = np.unique(keys, return_index=True)
                self.memory.clear(len(new))
                self.values.clear()
            where = missing[where]
            raw = w.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(sub.start[where].tolist(), sub.end[where].tolist(), strict=True)]
            self.values += self.learn(list(zip(words, first[where].tolist(), strict=True)))
            self.memory.add(new)
            number[missing] = self.memory.find(keys[missing])
        return number, bounds
