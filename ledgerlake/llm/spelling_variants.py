"""Spelling variant grouping (operator 12): words one edit apart, joined by asymmetric chunks.

Of two words that one insertion, deletion or replacement parts, the lesser one (by length, then by code points) gives two
disjoint chunks: its first half and, behind it, as many code points again. One edit spoils one chunk at most, so the other
stands whole in the greater word, shifted by one place at most. The greater word gives its positional grams of the same size
(those places that a chunk can meet), and an equi-join on (size, place, gram) finds every pair; of several meetings of one pair
only the first in a fixed order counts, so no pairs are gathered to drop repeats. Pairs are verified by their edit distance.

Words are the distinct spellings of the runs of letters of all texts, with their counts: each task counts a chunk of text at a
time and sends one row for each distinct word of it, so a frequent word is a few rows a task before the shuffle. A run may
first lose a code point (`noise`), by the crc32 of `<doc_id>:<run>`.

A word's form is its near word of largest count, if that is large enough; roots follow forms to their end. A form's count is at
least `ratio` times the word's, so ways have no cycles and their length is bounded by the logarithm of the largest count; a few
rounds of doubling reach all ends.

Bounds: a chunk holds `CHUNK` bytes of text, or one longer text. Nothing is broadcast by this module.

Defined results: null and empty texts have no words; repeated rows count again; a null doc_id counts as the empty decimal; runs
of any length take part; words with equal counts: the smallest in code-point order is the form; an empty table gives an empty
one; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import giving_back, pick, saved, table
from ledgerlake.llm.words import as_strings, hash_spans

CHUNK = 8 << 20
SHORTEST = 7  #: code points; a chunk has three at least


@cache
def _crc_table() -> np.ndarray:
    """What crc32's register becomes for each low byte: eight steps of its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


def crc32_on(start: np.ndarray, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """crc32 of spans of data, each carried on from a crc32 of what stands before it."""
    step, crc = _crc_table(), ~start.astype(np.uint32)
    size, at = high - low, 0
    left = np.flatnonzero(size > 0)
    while len(left):
        c = crc[left]
        crc[left] = step[(c ^ data[low[left] + at]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        at += 1
        left = left[size[left] > at]
    return ~crc


def runs(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of [A-Za-z\\u00C0-\\u00FF] begin and end in n bytes of UTF-8: those code points are ASCII letters and what has 0xC3 as its first byte."""
    b = data[:n]
    letter = ((b | 0x20) >= 97) & ((b | 0x20) <= 122) & (b < 128)
    lead = b == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def counted(column: pa.Array, ids: list[int | None], noise: int, shortest: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, counts) of texts, a chunk at a time; noise 0: runs stay as they are."""
    column, n = as_strings(column), len(column)
    if not n:
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if column.buffers()[2] is None or raw[-1] == raw[0]:
        return
    whole = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(raw, raw[first] + CHUNK, side="right")) - 1)
        offsets = raw[first : end + 1] - raw[first] + np.arange(end - first + 1)  # one byte between texts, so that no run goes on into the next
        data = np.zeros(int(offsets[-1]) + 16, dtype=np.uint8)
        inside = np.ones(int(offsets[-1]), dtype=bool)
        inside[offsets[1:] - 1] = False
        data[: offsets[-1]][inside] = whole[raw[first] : raw[end]]
        yield _count(data, offsets, ids[first:end], noise, shortest)
        first = end


def _count(data: np.ndarray, offsets: np.ndarray, ids: list[int | None], noise: int, shortest: int) -> tuple[list[str], np.ndarray]:
    low, high = runs(data, int(offsets[-1]))
    enough = high - low >= shortest
    low, high = low[enough], high[enough]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    points = heads[high] - heads[low]
    enough = points >= shortest
    low, high, points = low[enough], high[enough], points[enough]
    data[(data >= 65) & (data <= 90)] |= 0x20
    if not noise:
        return _distinct(data, low, high)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    h = crc32_on(before[np.searchsorted(offsets, low, side="right") - 1], data, low, high)
    hit = h % noise == 0
    at = heads[low[hit]] + h[hit] % points[hit]  # the code point to delete, counted over the chunk
    lost = np.searchsorted(heads, at, side="right") - 1
    shorter = []
    for a, b, p in zip(low[hit].tolist(), high[hit].tolist(), lost.tolist(), strict=True):
        shorter.append(data[a:p].tobytes() + data[p + (2 if data[p] == 0xC3 else 1) : b].tobytes())
    words, n = _distinct(data, low[~hit], high[~hit])
    shorter = [x for x in (w.decode() for w in shorter) if len(x) >= shortest]
    return words + shorter, np.concatenate([n, np.ones(len(shorter), dtype=np.int64)])


def _distinct(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list[str], np.ndarray]:
    _, where, n = np.unique(hash_spans(data, low, high), return_index=True, return_counts=True)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(low[where].tolist(), high[where].tolist(), strict=True)], n


def vocabulary(docs: DataFrame, *, noise: int = 31, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """word, n: the distinct words of at least `shortest` code points with at least `least` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in counted(batch.column("text"), batch.column("doc_id").to_pylist(), noise, shortest):
                for i in range(0, len(words), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 16)], pa.string()), pa.array(n[i : i + (1 << 16)], pa.int64())], ["word", "n"])

    rows = pick(docs, "doc_id", "text").where("text IS NOT NULL").mapInArrow(giving_back(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _size(length: Column) -> Column:
    """Code points of the chunks of a word of that length: half of them."""
    return F.floor(length / 2).cast("int")


#: The meetings of a chunk with a gram, in the order in which they count: (which chunk, shift).
MEETINGS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each pair of words (word, n) that one edit parts, once, the lesser word first."""
    key = lambda size, k, shift, gram: F.xxhash64(size, F.lit(k), F.lit(shift), gram)
    chunk = lambda word, size, k, shift=0: F.col(word).substr((size if k else F.lit(0)) + 1 + shift, size)
    size = F.col("size")
    chunks = [F.struct(F.lit(i).alias("m"), key(size, k, s, chunk("word", size, k)).alias("key")) for i, (k, s) in enumerate(MEETINGS)]
    lesser = words.withColumn("size", _size(F.length("word"))).select(F.col("word").alias("a"), F.col("n").alias("n_a"), "size", F.inline(F.array(*chunks)))
    sizes = F.array_distinct(F.array(_size(F.length("word")), _size(F.length("word") - 1)))  # the lesser word is as long or one shorter
    grams = [key(size, k, s, chunk("word", size, k, s)) for k, s in MEETINGS]
    greater = words.withColumn("size", F.explode(sizes)).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(*grams)).alias("key"))
    first = F.coalesce(*[F.when(chunk("a", size, k) == chunk("b", size, k, s), F.lit(i)) for i, (k, s) in enumerate(MEETINGS)])
    la, lb = F.length("a"), F.length("b")
    ordered = (lb - la == 1) | (la == lb) & (F.col("a") < F.col("b"))
    pairs = lesser.join(greater, "key").where(ordered & (F.levenshtein("a", "b", 1) == 1) & (first == F.col("m")))
    return pairs.select("a", "b", "n_a", "n_b")


def variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = saved(words, "words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near")))))
    best = both.groupBy("word").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = saved(found.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    top = found.agg(F.max("n").alias("n")).head().n or 1
    ways = saved(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways")
    longest = log10(max(top, 10)) / log10(max(ratio, 2)) + 1  # no way has more steps
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = saved(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ways")
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE crc(i, c) AS MATERIALIZED (
  SELECT i, list_reduce([i] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM (SELECT unnest(range(256)) AS i)),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY 1, 2),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM l),
y AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || [('0x' || substr(bytes, k, 2))::BIGINT FOR k IN range(1, len(bytes), 2)], lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]))) AS h FROM x, steps),
z AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM y),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM z WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near.near, (-o.n, near.near)) AS form, max(o.n) AS form_n FROM near JOIN w o ON near.near = o.word GROUP BY near.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
way(word, last) AS (SELECT word, word FROM f UNION SELECT way.word, f.form FROM way JOIN f ON way.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.last AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON f.word = way.word JOIN f e ON e.word = way.last WHERE e.form IS NULL
"""
