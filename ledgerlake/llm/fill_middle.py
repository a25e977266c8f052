"""Fill-in-middle transformation (operator 11): texts cut at unit borders and laid out as prefix, suffix and middle.

A unit is a run of ASCII letters or one other code point. Units are found without a loop over characters: a chunk of texts is
viewed as 64-bit words, arithmetic on whole words sets the high bit of each byte that ends a unit, bit counts a word give a
cumulative table, and the byte where unit k ends is found by a search of that table for the word and by prefix sums of the
word's eight marks for the place in it. Code points are counted by the same tables over the bytes that begin one.

Where a text is cut, and in which form it goes, depends on the SHA-256 of `<seed>:<doc_id>` alone, so a row that is computed
again, anywhere, is the same.

Bounds: a chunk holds `CHUNK` bytes of text, or one longer text.

Defined results: null counts as empty, and an empty text is plain; a text that holds one of the marks is plain, so every output
can be taken apart again; a null doc_id counts as the empty decimal; repeated rows each get their own row; an empty table gives
an empty one; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import map_arrow, pick, table
from ledgerlake.llm.words import as_strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 4 << 20
_HIGH, _ONES, _LOW7 = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F)
_FOLD, _FROM_A, _PAST_Z = np.uint64(0x2020202020202020), np.uint64(0x1F1F1F1F1F1F1F1F), np.uint64(0x0505050505050505)
_1, _7, _8, _56 = (np.uint64(k) for k in (1, 7, 8, 56))


@dataclass(frozen=True)
class Rates:
    """How texts are dealt out: of 100, `changed` are cut, and of 100 cut ones `suffix_first` put the suffix before the prefix."""

    changed: int = 90
    suffix_first: int = 20
    seed: int = 1


def _next_byte(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark replaced by that of the byte behind it; behind the last byte there is none."""
    out = marks >> _8
    out[:-1] |= marks[1:] << _56
    return out


class Marks:
    """Marked bytes (the high bit of each) of a chunk of words, with counts up to each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])  # marks before word i

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before each place are marked."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        part = self.marks[word] & ((_1 << (byte * _8)) - _1)
        return self.upto[word] + np.bitwise_count(part)

    def place(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte of the chunk, counted from 1."""
        word = np.searchsorted(self.upto, k, side="left") - 1  # the last word with fewer than k marks before it
        want = (k - self.upto[word]).astype(np.uint64)
        sums = (self.marks[word] >> _7) * _ONES  # byte b holds the marks of bytes 0 to b
        short = ((sums | _HIGH) - want * _ONES) & _HIGH  # the high bit stays where a byte's sum has reached the wanted one
        return word * 8 + (8 - np.bitwise_count(short))


def unit_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """(bytes that end a unit, bytes that begin a code point) of texts that lie one behind another in data, whose size is a multiple of 8 and exceeds the last offset."""
    w = data.view(np.uint64)
    low = (w | _FOLD) & _LOW7
    letter = ((low + _FROM_A) ^ (low + _PAST_Z)) & ~w & _HIGH
    inner = w & ~(w << _1) & _HIGH  # 10xxxxxx: not the first byte of a code point
    ends = ~_next_byte(inner) & ~(letter & _next_byte(letter)) & _HIGH
    last = (offsets[1:] - 1)[np.diff(offsets) > 0]  # a text's last unit ends with it
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * _8))
    return Marks(ends), Marks(~inner & _HIGH)


def dealt(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers under 2^32 of a document."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


def laid_out(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def cut_texts(column: pa.Array, ids: list[int | None], rates: Rates) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """For each text: its units, form, code points of prefix and middle, and the output."""
    column, n = as_strings(column), len(column)
    if not n:
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and raw[-1] > raw[0] else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(raw, raw[first] + CHUNK, side="right")) - 1)
        offsets = raw[first : end + 1] - raw[first]
        data = np.zeros((int(offsets[-1]) + 16) // 8 * 8, dtype=np.uint8)
        data[: offsets[-1]] = whole[raw[first] : raw[end]]
        yield from _cut(data, offsets, ids[first:end], rates)
        first = end


def _cut(data: np.ndarray, offsets: np.ndarray, ids: list[int | None], rates: Rates) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    ends, heads = unit_marks(data, offsets)
    before = ends.before(offsets)
    units = np.diff(before)
    h = np.array([dealt(i, rates.seed) for i in ids], dtype=np.int64)
    cuts = np.sort(h[:, :2] % (units + 1)[:, None], axis=1)
    at = np.repeat(offsets[:-1, None], 2, axis=1)
    some = cuts > 0
    at[some] = ends.place((before[:-1, None] + cuts)[some]) + 1
    points = heads.before(np.concatenate([offsets[:-1], at[:, 0], at[:, 1]]))
    a, b, c = points.reshape(3, -1)
    raw = data.tobytes()
    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = raw[low:high]
        if not text or h[i, 2] % 100 >= rates.changed or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
            yield int(units[i]), "plain", None, None, text
            continue
        form = "spm" if h[i, 3] % 100 < rates.suffix_first else "psm"
        x, y = int(at[i, 0]), int(at[i, 1])
        yield int(units[i]), form, int(b[i] - a[i]), int(c[i] - b[i]), laid_out(form, raw[low:x], raw[x:y], raw[y:high])


def transformed(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:  # noqa: B008  (frozen)
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output of every whole text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = list(zip(*cut_texts(batch.column("text"), batch.column("doc_id").to_pylist(), rates), strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[:4], arrays[4].cast(pa.string())], names)

        return f

    return map_arrow(pick(docs, "doc_id", "text"), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", make)


def restored(form: Column, output: Column) -> Column:
    """The text of an output. A text that was cut holds no mark, and none can arise where a part and a mark meet, so marks part it."""
    psm, spm = F.split(output, f"^{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.split(output, f"^{SUFFIX}|{PREFIX}|{MIDDLE}", -1)  # an empty string before the first mark
    part = lambda parts, k: F.try_element_at(parts, F.lit(k))
    joined = F.when(form == "psm", F.concat(part(psm, 2), part(psm, 4), part(psm, 3)))
    return joined.when(form == "spm", F.concat(part(spm, 3), part(spm, 4), part(spm, 2))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS x FROM d),
f AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, CASE WHEN a > 0 THEN array_to_string(u[1:a], '') ELSE '' END AS p, CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS m, CASE WHEN n > b THEN array_to_string(u[b + 1:n], '') ELSE '' END AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""
