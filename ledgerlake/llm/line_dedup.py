"""Line dedup (operator 4): an exact set-similarity join of lines.

A line's tokens are its different words, told apart by 62-bit hashes. A line that holds words is removed if an earlier line (by
document id, then place) has a Jaccard similarity of 0.8 or more to it, whether that earlier line stays or not.

1. Word frequencies over all texts; words of 16 or more uses, up to `max_ranked` of them, are ranked by frequency. Tokens of a
   line stand in the order of rarity: unranked words by their hash, then the ranked ones. Any order keeps the join exact.
2. One pass over the texts writes a row for each line: its place, a hash of its set, a bitmap of 128 bits, and its packed
   tokens. Every later step reads these rows, the texts only when lines are cut out.
3. Prefix filter: a set of n tokens is posted under its first n - ceil(0.8 n) + 1 tokens, equal sets once in a task. Sets of
   one to three tokens are similar to equal ones only (3 of 4 is 0.75, but 4 of 5 is 0.8) and need no postings.
4. Sets under the same token stand in the order of their sizes. A set meets those up to 1.25 times its size, as long as the
   token is among its own first n - ceil(8 n / 9) + 1, which suffices for the smaller set of a similar pair; the overlap that
   positions still allow and the bitmaps (differing bits need differing tokens) decide who is a candidate.
5. Sets that have a candidate under a token are joined with their tokens and meet under it again, where candidates are verified
   inside the task until a set has found an earlier similar one. Pairs are never written out.
6. Lines whose set has an earlier equal or similar one go.

Scale: a token with more than `block` postings is dealt in tiles of that size; only sets that are candidates (found by a
fixed-size Bloom filter) are fetched for verification; removals reach documents by an equi-join. Nothing is capped.
Verification unpacks and compares a bounded number of tokens at once.
Texts are read in chunks of some megabytes; no words are remembered between them.

Defined results: null and empty texts have one line without words, which stays; rows with equal id and text are the same
document and get equal results; lines at one place of different texts with equal ids are ordered by a hash; null ids come first;
an empty table gives an empty result; other columns are passed through by apply(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.candidates import bloom, in_groups, may_hold
from ledgerlake.llm.common import giving_back, map_arrow, mix64, pick, saved, table
from ledgerlake.llm.word_memory import Memory
from ledgerlake.llm.words import Words, chunks, tally

EQUAL_ONLY = 3  #: sets of so many tokens at most have no similar ones but equal ones
MIN_USES = 16
MAX_RANKED = 1 << 17
BLOCK = 20_000
VERIFIED_ROWS = 20_000  #: rows with their tokens that a task holds at once, or one group
PAIRS_AT_ONCE = 20_000
TOKENS_AT_ONCE = 1 << 17  #: tokens that verification unpacks or compares at once; a larger set is handled alone
RANKED = 1 << 62
HIGH = np.uint64(0xFFFFFFFF00000000)
WIDE = 512  #: bits of the bitmaps that verification compares before it counts shared tokens

#: rest and rank: the line's tokens, ascending, as packed little-endian numbers: hashes of 64 bits, then the lower 16 bits of
#: ranks, of which the first `low` are below 2^16. top: the rank of the prefix's last token, or -1. text_hash tells texts with
#: equal ids apart.
LINES = "doc long, text_hash long, line int, set long, n int, b0 long, b1 long, top int, low int, rest binary, rank binary"
#: token: a hash of the token and a tile; shape: the size of the set and the token's place in it (32 bits each).
POSTINGS = "token long, set long, doc long, line int, shape long, b0 long, b1 long"
_NULL_DOC = -(1 << 63)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (a hash), n: the uses of every word."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            word, n = tally(w.hashes() >> np.uint64(2) for w in chunks(batch.column("text")))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"]) if len(word) else None

        return f

    return map_arrow(pick(docs, "text"), "word long, n long", make).groupBy("word").agg(F.sum("n").alias("n"))


def known_words(docs: DataFrame, max_ranked: int = MAX_RANKED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most max_ranked frequent words, the rarest first, and their uses; and a filter of all words used twice or more."""
    if max_ranked > MAX_RANKED:
        raise ValueError(f"max_ranked is {MAX_RANKED} at most")
    again = saved(word_counts(docs).where("n > 1"), "words")
    often = again.where(F.col("n") >= MIN_USES)
    sizes = {r.b: r.c for r in often.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("c")).collect()}
    total, least = 0, 62
    for b in sorted(sizes, reverse=True):
        if (total := total + sizes[b]) > max_ranked:
            break
        least = b
    top = often.where(F.col("n") >= (1 << least)).toArrow()
    word, n = (top.column(c).to_numpy() for c in ("word", "n"))
    order = np.lexsort((word, n))
    return word[order].view(np.uint64), n[order], bloom(again, "word")


class Ranks:
    """Token keys of word hashes: RANKED and the rank, or the hash."""

    def __init__(self, ranked: np.ndarray):
        self.memory = Memory(max(1, len(ranked)))
        self.memory.add(ranked << np.uint64(2))

    def keys(self, words: np.ndarray) -> np.ndarray:
        rank = self.memory.find(words << np.uint64(2))
        return np.where(rank >= 0, rank.astype(np.uint64) + np.uint64(RANKED), words)


def sets_of(w: Words, ranks: Ranks) -> dict[str, np.ndarray]:
    """The lines of a chunk that hold words: text, line, n, set (hash), b0, b1; and key: their different tokens, ascending."""
    line = w.lines()
    count = w.line_counts()
    row = (np.cumsum(count) - count)[w.text] + line  # every line of the chunk has a number
    key = ranks.keys(w.hashes() >> np.uint64(2))
    order = np.argsort(key)
    if len(row) and row[-1] < 1 << 16:
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # numpy deals out 16-bit integers without comparing
    else:
        order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row, at = key[new], row[new], order[new]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[first, len(row)])
    out = {"text": w.text[at[first]], "line": line[at[first]], "n": n, "key": key}
    with np.errstate(over="ignore"):
        mixed = mix64(key)
        out["set"] = mix64(np.add.reduceat(mixed, first) + n.astype(np.uint64)) if len(first) else mixed
        place = mixed >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        for k in (0, 1):
            out[f"b{k}"] = np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), first) if len(first) else mixed
    return out


def _packed(flat: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """flat's numbers by row (ascending), as one binary value a row."""
    at = (np.searchsorted(row, np.arange(n + 1)) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])


def lines_of(docs: DataFrame, ranked: np.ndarray) -> DataFrame:
    """A row for each line that holds words."""
    held = docs.sparkSession.sparkContext.broadcast(ranked)  # at most MAX_RANKED words
    rows = pick(docs, "doc_id", "text").select(doc_key().alias("doc"), "text", text_key().alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, names = Ranks(held.value), [x.split()[0] for x in LINES.split(", ")]
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            for w in chunks(batch.column("text")):
                s = sets_of(w, ranks)
                if not len(s["n"]):
                    continue
                own, at = np.repeat(np.arange(len(s["n"])), s["n"]), s["text"] + w.first
                often = s["key"] >= np.uint64(RANKED)
                rank = s["key"][often] - np.uint64(RANKED)
                low = np.bincount(own[often][rank < 1 << 16], minlength=len(s["n"]))
                last = s["key"][np.cumsum(s["n"]) - s["n"] + _prefix(s["n"]) - 1]
                top = np.where(last >= np.uint64(RANKED), (last - np.uint64(RANKED)).astype(np.int64), -1)
                packed = [_packed(s["key"][~often], own[~often], len(s["n"])), _packed(rank.astype(np.uint16), own[often], len(s["n"]))]
                cols = [doc[at], text_hash[at], s["line"].astype(np.int32), s["set"].view(np.int64), s["n"].astype(np.int32), s["b0"].view(np.int64), s["b1"].view(np.int64), top.astype(np.int32), low.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *packed], names)

    return rows.mapInArrow(giving_back(run), LINES)


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_DOC))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each row's begin) of a column of packed numbers."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].copy().view(kind) if data is not None else np.zeros(0, dtype=kind)
    return flat, (at - at[0]) // np.dtype(kind).itemsize


def tokens_of(batch: pa.RecordBatch, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row, place) of the tokens of lines, in the order of rarity. most: how many of each line."""
    rest, rest_at = _unpacked(batch.column("rest"), np.uint64)
    rank, rank_at = _unpacked(batch.column("rank"), np.uint16)
    low, a, b = batch.column("low").to_numpy(), np.diff(rest_at), np.diff(rank_at)
    if most is not None:
        a = np.minimum(a, most)
        b = np.minimum(b, most - a)
    n = a + b
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    key, ranked = np.empty(len(row), dtype=np.uint64), place >= a[row]
    key[~ranked] = rest[rest_at[row[~ranked]] + place[~ranked]]
    own = row[ranked]
    k = place[ranked] - a[own]
    key[ranked] = rank[rank_at[own] + k].astype(np.uint64) + ((k >= low[own]).astype(np.uint64) << np.uint64(16)) + np.uint64(RANKED)
    return key, row, place


def _prefix(n: np.ndarray) -> np.ndarray:
    return n + 1 - -(-4 * n // 5)


def _short_prefix(n: np.ndarray) -> np.ndarray:
    return n + 1 - -(-8 * n // 9)


def _mixed(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(key) & HIGH


def posted_tokens(batch: pa.RecordBatch, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row, place) of the prefixes of a batch of lines; equal sets once. Words used once have no other line and are left out."""
    n = batch.column("n").to_numpy()
    doc, line, own = (batch.column(c).to_numpy() for c in ("doc", "line", "set"))
    order = np.lexsort((line, doc, own))
    once = np.zeros(len(n), dtype=bool)
    once[order] = np.r_[True, own[order][1:] != own[order][:-1]]
    key, row, place = tokens_of(batch, np.where(once & (n > EQUAL_ONLY), _prefix(n), 0))
    keep = key >= np.uint64(RANKED)
    keep[~keep] = may_hold(again, key[~keep].view(np.int64))
    return key[keep], row[keep], place[keep]


def popular(lines: DataFrame, again, often: int, block: int = BLOCK) -> dict[int, int]:
    """Postings of each ranked token (by its 32-bit hash) that has more than `block` of them; at most MAX_RANKED rows.

    often: the least rank of words that have as many uses. Few sets are posted under such words.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            key, _, _ = posted_tokens(batch, again.value)
            token, n = np.unique(_mixed(key[key >= np.uint64(RANKED + often)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"]) if len(n) else None

        return f

    some = lines.where(F.col("top") >= often).select("doc", "line", "set", "n", "low", "rest", "rank")
    sums = map_arrow(some, "token long, n long", make).groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in sums.where(F.col("n") > block).collect()}


def postings(lines: DataFrame, again, uses: dict[int, int], block: int = BLOCK) -> DataFrame:
    """Rows of lines' sets under the tokens of their prefixes."""
    held = lines.sparkSession.sparkContext.broadcast(uses)  # at most MAX_RANKED tokens

    def make():
        uses = held.value
        hot = np.array(sorted(uses), dtype=np.int64)
        tiles_of_hot = np.array([-(-uses[t] // block) for t in hot.tolist()], dtype=np.int64)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            key, row, place = posted_tokens(batch, again.value)
            token = _mixed(key)
            token, own = token.view(np.int64), batch.column("set").to_numpy()
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                times = np.where(hot[at] == token, tiles_of_hot[at], 1)
                c = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, place, token, tiles = (np.repeat(v, times) for v in (row, place, token, times))
                b = (own[row].view(np.uint64) % tiles.astype(np.uint64)).astype(np.int64)
                token = token + np.where(tiles > 1, np.maximum(b, c) * tiles + np.minimum(b, c) + 1, 0)  # a tile for each pair of blocks
            if not len(row):
                return None
            shape = batch.column("n").to_numpy().astype(np.int64)[row] << 32 | place
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([pa.array(token), *(batch.column(c).take(take) for c in ("set", "doc", "line")), pa.array(shape), *(batch.column(c).take(take) for c in ("b0", "b1"))], [x.split()[0] for x in POSTINGS.split(", ")])

        return f

    return map_arrow(lines, POSTINGS, make)


def _earliest(group: np.ndarray, own: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The rows without those whose set an earlier row of the group has, as several tasks may have posted a set."""
    with np.errstate(over="ignore"):
        key = mix64(own.view(np.uint64) + mix64(group.astype(np.uint64)))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    at = at[np.lexsort((line[at], doc[at], own[at], group[at]))]
    again = at[1:][(group[at][1:] == group[at][:-1]) & (own[at][1:] == own[at][:-1])]
    keep = np.ones(len(own), dtype=bool)
    keep[again] = False
    return np.flatnonzero(keep)


class _Group:
    """Sets under the same tokens, by group and then size, each set once in a group at its earliest place."""

    def __init__(self, t: pa.Table, group: np.ndarray):
        own, doc, line, shape = (t.column(c).to_numpy() for c in ("set", "doc", "line", "shape"))
        keep = _earliest(group, own, doc, line)
        self.rows = keep = keep[np.argsort(group[keep] << 32 | shape[keep] >> 32)]  #: their rows in t
        self.own, self.doc, self.line, self.group = own[keep], doc[keep], line[keep], group[keep]
        self.size, self.place = shape[keep] >> 32, shape[keep] & 0xFFFFFFFF
        self.bits = np.stack([t.column(b).to_numpy()[keep].view(np.uint64) for b in ("b0", "b1")], axis=1)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y) of the pairs that may be similar, y the earlier line, a distance in the order at a time."""
        n, size, place, bits = len(self.own), self.size, self.place, self.bits
        left, d = np.flatnonzero(place < _short_prefix(size)), 1
        while True:
            left = left[left + d < n]
            other = left + d
            left = left[(self.group[left] == self.group[other]) & (5 * size[left] >= 4 * size[other])]
            if not len(left):
                return
            a, b = left, left + d
            total = size[a] + size[b]
            need = -(-4 * total // 9)  # shared tokens
            ok = np.minimum(size[a] - place[a], size[b] - place[b]) + np.minimum(place[a], place[b]) >= need
            a, b, most = a[ok], b[ok], (total - 2 * need)[ok]
            ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= most
            a, b = a[ok], b[ok]
            doc, line, own = self.doc, self.line, self.own
            later = (doc[a] > doc[b]) | (doc[a] == doc[b]) & ((line[a] > line[b]) | (line[a] == line[b]) & (own[a] > own[b]))
            if len(a):
                yield np.where(later, a, b), np.where(later, b, a)
            d += 1


def _with_candidates(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
    """The postings whose set has a candidate under their token."""
    g = _Group(t, group)
    hit = np.zeros(len(g.own), dtype=bool)
    for x, y in g.candidates():
        hit[x] = hit[y] = True
    at = pa.array(g.rows[hit])
    return pa.RecordBatch.from_arrays([c.combine_chunks().take(at) for c in t.columns], t.column_names) if len(at) else None


def _slices(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(low, high) of runs of numbers that add up to `most` at most; a larger number is a run of its own."""
    end, low = np.cumsum(n), 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(end, end[low] - n[low] + most, side="right")))
        yield low, high
        low = high


class _Sets:
    """The token sets of some rows of a table, findable by ascending numbers of a row and the upper bits of a token.

    n: the sizes of the sets. 16 bytes a token are held, and 64 a set; they are unpacked a bounded number at a time.
    """

    def __init__(self, t: pa.Table, rows: np.ndarray, n: np.ndarray):
        t = t.select(["low", "rest", "rank"])
        self.shift = 62 - len(rows).bit_length()  # a token's number lies below 2^(shift + 1)
        self.first = np.r_[0, np.cumsum(n)]
        self.token, self.known = np.empty(self.first[-1], dtype=np.uint64), np.empty(self.first[-1], dtype=np.int64)
        self.bits = np.empty((len(rows), WIDE // 64), dtype=np.uint64)
        for low, high in _slices(n + WIDE // 8, TOKENS_AT_ONCE):
            token, row, _ = tokens_of(t.take(pa.array(rows[low:high])).combine_chunks().to_batches()[0])
            own = slice(self.first[low], self.first[high])
            self.token[own], self.known[own] = token, self._number(row + low, token)
            bits = np.zeros((high - low, WIDE), dtype=bool)
            bits[row, (token % np.uint64(WIDE)).astype(np.int64)] = True
            self.bits[low:high] = np.packbits(bits, axis=1).view(np.uint64)

    def _number(self, row: np.ndarray, token: np.ndarray) -> np.ndarray:
        ranked = token >= np.uint64(RANKED)
        upper = np.where(ranked, token - np.uint64(RANKED) + np.uint64(1 << self.shift), token >> np.uint64(62 - self.shift))
        return (row << self.shift + 1) + upper.astype(np.int64)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of the number of tokens that only one of the sets a and b has, for each pair."""
        return np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many tokens the sets a and b have in common, for each pair."""
        n = self.first[a + 1] - self.first[a]
        parts = [self._shared(a[low:high], b[low:high], n[low:high]) for low, high in _slices(n, TOKENS_AT_ONCE)]
        return np.concatenate([np.zeros(0, dtype=np.int64), *parts])

    def _shared(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        pair = np.repeat(np.arange(len(a)), n)
        wanted = np.arange(len(pair)) + np.repeat(self.first[a] - np.cumsum(n) + n, n)
        token = self.token[wanted]
        number = self._number(b[pair], token)
        at = np.searchsorted(self.known, number)
        same = np.zeros(len(pair), dtype=bool)
        left = np.arange(len(pair))
        while len(left):  # tokens of a set whose upper bits are equal stand together
            left = left[at[left] < len(self.known)]
            left = left[self.known[at[left]] == number[left]]
            equal = self.token[at[left]] == token[left]
            same[left[equal]] = True
            left = left[~equal]
            at[left] += 1
        return np.bincount(pair[same], minlength=len(a))


def _late(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
    """The sets that are similar to an earlier one of their group. A set that has been found isn't compared again."""
    g = _Group(t, group)
    sets, found = _Sets(t, g.rows, g.size), np.zeros(len(g.own), dtype=bool)
    for x, y in g.candidates():
        x, y = x[~found[x]], y[~found[x]]
        for low in range(0, len(x), PAIRS_AT_ONCE):
            i, j = x[low : low + PAIRS_AT_ONCE], y[low : low + PAIRS_AT_ONCE]
            total = g.size[i] + g.size[j]
            need = -(-4 * total // 9)
            ok = sets.differing(i, j) <= total - 2 * need
            i, j, need = i[ok], j[ok], need[ok]
            found[i[sets.shared(i, j) >= need]] = True
    late = np.unique(g.own[found])
    return pa.RecordBatch.from_arrays([pa.array(late)], ["set"]) if len(late) else None


def late_sets(lines: DataFrame, again_: np.ndarray, often: int, *, block: int = BLOCK) -> DataFrame:
    """set: the token sets that have an earlier similar one. often: the least rank of words with more than `block` uses."""
    again = lines.sparkSession.sparkContext.broadcast(again_)  # of a fixed size
    posted = postings(lines, again, popular(lines, again, often, block), block)
    some = saved(in_groups(posted, ["token"], [], _with_candidates, POSTINGS), "candidates")
    held = lines.sparkSession.sparkContext.broadcast(bloom(some.select("set").distinct(), "set"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            sets = batch.column("set").to_numpy()
            at = np.flatnonzero(may_hold(held.value, sets))
            at = at[np.unique(sets[at], return_index=True)[1]]
            return batch.take(pa.array(at)) if len(at) else None

        return f

    tokens = map_arrow(lines.select("set", "low", "rest", "rank"), "set long, low int, rest binary, rank binary", make).dropDuplicates(["set"])
    return in_groups(some.join(tokens, "set").select(*some.columns, "low", "rest", "rank"), ["token"], [], _late, "set long", batch_rows=VERIFIED_ROWS).distinct()


def removed_lines(docs: DataFrame, *, max_ranked: int = MAX_RANKED, block: int = BLOCK) -> DataFrame:
    """doc, text_hash, removed array<int>: the places of the lines that go, for each different document that loses any."""
    ranked, uses, again = known_words(docs, max_ranked)
    rows = saved(lines_of(docs, ranked), "lines")
    late = saved(late_sets(rows, again, int(np.searchsorted(uses, block, side="right")), block=block), "late-sets")
    again_sets = rows.groupBy("set").agg(F.count("*").alias("n")).where("n > 1").select("set", F.lit(False).alias("late"))
    marked = again_sets.unionByName(late.withColumn("late", F.lit(True))).groupBy("set").agg(F.max("late").alias("late"))
    lines = saved(rows.select("doc", "text_hash", "line", "set").join(marked, "set"), "marked-lines")
    lines = lines.select("doc", "text_hash", "set", "late", F.struct("doc", "line", "text_hash").alias("place"))
    first = lines.where("NOT late").groupBy("set").agg(F.min("place").alias("first"))
    gone = lines.where("late").select("doc", "text_hash", "place").unionByName(lines.where("NOT late").join(first, "set").where("place <> first").select("doc", "text_hash", "place"))
    return gone.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("place.line")).alias("removed"))


def _with_removed(docs: DataFrame, **options) -> tuple[DataFrame, Column]:
    """docs under names of their own (c0, c1, ...), joined with what goes from them; and the list of places."""
    gone = saved(removed_lines(docs, **options), "removed-lines")
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    keyed = own.withColumn("own_doc", F.coalesce(at["doc_id"].cast("long"), F.lit(_NULL_DOC))).withColumn("own_text", F.xxhash64(F.coalesce(at["text"], F.lit(""))))
    joined = keyed.join(gone, (F.col("own_doc") == F.col("doc")) & (F.col("own_text") == F.col("text_hash")), "left")
    return joined, at


def removals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, removed array<int>: a row for each document, with the places of the lines that go."""
    joined, at = _with_removed(pick(docs, "doc_id", "text"), **options)
    text = F.coalesce(at["text"], F.lit(""))
    n = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(at["doc_id"].cast("long").alias("doc_id"), n.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """docs with the removed lines cut out of text; a null text stays null."""
    joined, at = _with_removed(docs, **options)
    left = F.concat_ws("\n", F.filter(F.split(at["text"], "\n"), lambda x, i: ~F.array_contains("removed", i)))
    cut = F.when(F.col("removed").isNull(), at["text"]).otherwise(left)
    return joined.select(*[(cut if c == "text" else at[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = removals(table(spark, sf_dir, "documents"))
    return gone.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", "removed").alias("removed_lines"))
