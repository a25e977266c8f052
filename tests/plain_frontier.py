"""The ordered frontier's rules, a block at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

REFETCHES = 3
MOST_BUFFERED = 1000


@dataclass
class Frontier:
    """The state of one chain, and what each event does to it. Events give (kind, number, hash, from, to) rows."""

    expected: int
    last_hash: str | None = None
    buffer: dict[int, tuple[str | None, str | None]] = field(default_factory=dict)
    most: int = MOST_BUFFERED
    refetched: int = 0

    def _release(self) -> Iterator[tuple]:
        while self.expected in self.buffer:
            own, parent = self.buffer.pop(self.expected)
            if self.last_hash is not None and parent is not None and parent.lower() != self.last_hash.lower():
                n = self.expected
                for k in [k for k in self.buffer if k >= n]:
                    del self.buffer[k]
                self.last_hash = None  # the rollback decides what comes before
                yield "reorg", n, own, None, None
                return
            yield "block", self.expected, own, None, None
            self.last_hash, self.expected, self.refetched = own, self.expected + 1, 0

    def _jump(self, target: int, reason: str) -> Iterator[tuple]:
        yield reason, None, None, self.expected, target - 1
        self.expected, self.last_hash, self.refetched = target, None, 0
        for k in [k for k in self.buffer if k < target]:
            del self.buffer[k]

    def block(self, number: int, own: str | None, parent: str | None) -> Iterator[tuple]:
        """A block arrives; late ones are dropped, early ones wait."""
        if number < self.expected:
            return
        self.buffer.setdefault(number, (own, parent))
        yield from self._release()
        if len(self.buffer) > self.most:
            yield from self._jump(min(self.buffer), "overflow")
            yield from self._release()

    def progress(self, range_end: int) -> Iterator[tuple]:
        """A marker that everything up to range_end holds nothing more."""
        if range_end + 1 > self.expected:
            self.expected, self.last_hash, self.refetched = range_end + 1, None, 0
            for k in [k for k in self.buffer if k < self.expected]:
                del self.buffer[k]
            yield from self._release()

    def stalled(self) -> Iterator[tuple]:
        """Nothing has come for too long: ask for the gap, then skip it."""
        target = min(self.buffer) if self.buffer else self.expected + 1
        if self.refetched < REFETCHES:
            self.refetched += 1
            yield "refetch", None, None, self.expected, target - 1
            return
        yield from self._jump(target, "bypass")
        yield from self._release()
