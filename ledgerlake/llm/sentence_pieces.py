"""SentencePiece encoding and decoding (operator 5) of a merge-type (BPE) model.

The encoding of a text's prefix ends in exactly one token, and two neighbours in an encoding are exactly a pair that merging
leaves as it is. So one pass over the text with an automaton of all pieces stores, for each prefix, the one match that ends
there and is compatible with the stored last token of the prefix before it; the ids are then read off backwards from the end.
No merge queue is kept for a text.

A text is cut where no piece reaches across (before blanks, at line feeds, and between characters that no piece has side by
side); words are encoded once and remembered by 64-bit hashes of their bytes, up to `keep` of them, whose loss only costs time.
Texts with runs of blanks, blanks at an end or other white space are encoded by themselves. Characters that no piece has become byte tokens.

Defined results: null counts as empty, and an empty text has no ids and decodes to an empty text; U+2581 in a text counts as a
blank, as in the library; bytes that form no character decode to U+FFFD each; repeated rows each get their own row.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.common import map_arrow, pick, table, texts_of, tokenizer_file
from ledgerlake.llm.word_memory import WordValues, plain_texts
from ledgerlake.llm.words import chunks

SPACE = "▁"
codecs.register_error("ledgerlake-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The vocabulary of a model and the pair tests on it."""

    def __init__(self, file: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=file)  # read for its pieces and scores only
        n = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: library.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        self.beside = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False)}
        if any(pair[1] == SPACE != pair[0] for pair in self.beside):
            raise ValueError("this model has pieces that hold a blank after another character")
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}
        self.bytes_of = [bytes([int(t[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]

    def merged(self, text: str) -> list[str]:
        """text by definition: join the neighbours whose joint piece has the best score, the leftmost first, while there are any."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, piece: str) -> bool:
        """Merging the piece's own characters gives the piece."""
        if (r := self.single.get(piece)) is None:
            r = self.single[piece] = self.merged(piece) == [piece]
        return r

    def compatible(self, a: str, b: str) -> bool:
        """Merging the characters of both pieces gives just the two."""
        if (r := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return r

    def split(self, part: str) -> list[str]:
        """part, cut between characters that no piece has side by side."""
        beside, out, low = self.beside, [], 0
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in beside:
                out.append(part[low:i])
                low = i
        out.append(part[low:])
        return out

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part by the table of its prefixes' last tokens."""
        n = len(part)
        if n == 1 or (part in self.id and self.stands(part)):
            return [self.id[part]] if part in self.id else [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        last: list[str | None] = [None] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, piece in self.automaton.iter(part):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(piece)
            if start == 0:
                if self.stands(piece):
                    last[end] = piece
            else:
                before = last[start]
                if before is None:  # a character without a piece stands there
                    before = last[start] = part[start - 1]
                ok = pairs.get((before, piece))
                if compatible(before, piece) if ok is None else ok:
                    last[end] = piece
        out: list[int] = []
        while n:
            piece = last[n] or part[n - 1]
            if piece in self.id:
                out.append(self.id[piece])
            else:
                out.extend(self.byte[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            n -= len(piece)
        return out[::-1]

    def raw(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "ledgerlake-each-byte")


class Codec:
    """Encodes and decodes texts, remembering words: up to `keep` of them, some 300 bytes each."""

    def __init__(self, file: str | None = None, keep: int = 600_000):
        self.pieces = Pieces(file or tokenizer_file("piece_bpe_32k.model"))
        self.keep = keep
        self.small: dict[str, list[int]] = {}
        self.cuts = not any("\n" in pair for pair in self.pieces.beside)  # no piece reaches across a line feed
        self.words = WordValues(self._learn, keep, heads=False)

    def _ids(self, part: str) -> list[int]:
        out: list[int] = []
        small = self.small
        for p in self.pieces.split(part):
            if (ids := small.get(p)) is None:
                if len(small) > self.keep:
                    small.clear()
                ids = small[p] = self.pieces.encode_part(p)
            out += ids
        return out

    def _learn(self, words: list[tuple[str, bool]]) -> list[tuple[bytes, bytes]]:
        """A word's decimal ids, a comma before each, and the text they decode to: with the blank or line feed before the word."""
        out = []
        for w, first in words:
            ids = self._ids("\n" + w if first else SPACE + w)
            out.append((("," + ",".join(map(str, ids))).encode(), self.pieces.raw(ids).encode("utf-8", "surrogatepass")))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self._ids(part)]

    def decode(self, ids: list[int]) -> str:
        text = self.pieces.raw(ids)
        return text[1:] if text.startswith(" ") else text

    @staticmethod
    def parts(text: str) -> list[str]:
        """The normalised text (a blank before it, blanks as U+2581), cut before each run of blanks."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            out, low, t = [], 0, SPACE + text.replace(" ", SPACE)
            for i in range(1, len(t)):
                if t[i] == SPACE != t[i - 1]:
                    out.append(t[low:i])
                    low = i
            return [*out, t[low:]]
        return [SPACE + x for x in text.split(" ")]

    def _digest(self, text: str) -> tuple[int, str, str]:
        ids = self.encode(text)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

    def digests(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        """For each text: its number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of what the ids decode to."""
        sha = hashlib.sha256
        for w in chunks(column):
            cut = plain_texts(w, (SPACE.encode(),)) if self.cuts else np.zeros(w.texts, dtype=bool)
            number, bounds = self.words.of(w, cut)
            get, bounds = self.words.values.__getitem__, bounds.tolist()
            for i, plain in enumerate(cut.tolist()):
                if not plain:
                    yield self._digest(w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().decode())
                    continue
                found = list(map(get, number[bounds[i] : bounds[i + 1]].tolist()))
                ids, raw = b"".join([x for x, _ in found]), b"".join([x for _, x in found])
                yield ids.count(b","), sha(memoryview(ids)[1:]).hexdigest(), sha(raw.removeprefix(b" ")).hexdigest()

    def digest(self, text: str) -> tuple[int, str, str]:
        return next(self.digests(pa.array([text], pa.string())))


@cache
def shared_codec(file: str | None = None) -> Codec:
    """One codec for all tasks that a Python worker runs, so later ones find words that earlier ones met."""
    return Codec(file)


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def make():
        codec = shared_codec(file)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, text = zip(*codec.digests(batch.column("text")), strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return map_arrow(pick(docs, "doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encoded(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every whole text."""

    def make():
        codec = shared_codec(file)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [codec.encode(t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

        return f

    return map_arrow(pick(docs, "doc_id", "text"), "doc_id long, ids array<int>, decoded string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
