"""Personal data (operator 13): base patterns, and bootstrapped extraction by the words beside what they find.

Four patterns give the base spans: addresses of mail (email), of machines (ip), numbers of cards (card) and of phones (phone).
They are the seeds. The words beside a seed are lexical patterns: the one or two words before it, or the one or two behind it.
Candidates are strings of an identifier's shape that no base span touches (numbers of 7 digits or more without a plus sign or
with a wrong check digit, mail addresses spelt with (at) or without a dot, addresses of eight groups). Patterns and instances
(a kind and a normalised value) form a graph, whose edges are counted over all texts. In each round

- a pattern's confidence is the score of the instances beside it, summed over its occurrences, over all occurrences of its words
  in all texts (whatever stands there) and `doubt` more; it needs `support` different instances that count;
- a candidate's score is the noisy-or of the confident patterns beside it; those of high scores count as instances from then on,
  so they can bring forth patterns that the seeds didn't.

Candidates whose score reaches `accepted`, or whose value is a seed's, become spans wherever they occur. Scores are whole
thousandths, so sums don't depend on how rows are dealt out.

Scale: spans and edges are found in one pass over the texts and written; edges are counted before they are shuffled by pattern,
so a frequent word is a few rows a task. The occurrences of words are counted in a second pass, a chunk of bytes at a time. The
words to count are sent to the tasks while there are at most `most_sent` of them (8 bytes each); beyond that every task counts
all its words, and an equi-join picks; both ways give the same counts. Words are told apart by 64-bit hashes.

Bounds: a chunk holds `CHUNK` bytes of text, or one longer text. Words are looked for within `REACH` characters of a span; one that
reaches beyond is no pattern. Numbers of more than 25 digits are looked at 25 digits at a time.

Defined results: null counts as empty, and has no spans; repeated rows each get their own row; an empty table gives an empty
one; a span is told by code points, its end excluded; spans of different kinds may overlap; equal (kind, start, end) come once;
columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import giving_back, map_arrow, mix64, pick, saved, table, texts_of
from ledgerlake.llm.words import as_strings, hash_spans

KINDS = ("email", "ip", "card", "phone")
CHUNK = 4 << 20
REACH = 160
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # an address begins where a run of digits does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = re.compile(r"@|\x20?[\[(][aA][tT][\])]\x20?")
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(][dD][oO][tT][\])]\x20?)[A-Za-z0-9-]+)*")
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,24}+(?![0-9A-Za-z])")
GROUPS = re.compile(r"(?<![0-9A-Za-z:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7}+(?![0-9A-Za-z:])")
WORD = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
ANY = re.compile("[0-9@]|[\\[(][aA][tT][\\])]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value: int  #: a 64-bit hash of the kind and the normalised value


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(map(int, number[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])) % 10 == 0


def _span(kind: int, start: int, end: int, value: str) -> Span:
    return Span(start, kind, end, xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) - (1 << 63))


def _addresses(text: str, separators: Iterator[tuple[int, int]], domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of a local part, a separator and a domain. A local part holds no separator and is taken whole, so each character is looked at once."""
    last = 0
    for low, high in separators:
        if low >= last:
            start = last + len(text[last:low].rstrip(LOCAL))
            found = domain.match(text, high) if start < low else None
            if found:
                yield start, found.end()
            last = found.end() if found else high


def _ats(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The base spans in their order."""
    out = [_span(0, a, b, text[a:b].lower()) for a, b in _addresses(text, _ats(text), DOMAIN)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append(_span(1, m.start(), m.end(), ".".join(p or "0" for p in parts)))
    for m in CARD.finditer(text):
        number = digits(m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            out.append(_span(2, m.start(), m.end(), number))
    for m in PHONE.finditer(text):
        number = digits(m[0])
        if 9 <= len(number) <= 15:
            out.append(_span(3, m.start(), m.end(), number))
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Strings of an identifier's shape that no base span touches; one may be a candidate of several kinds."""
    out = []
    for a, b in _addresses(text, (m.span() for m in AT.finditer(text)), LOOSE_DOMAIN):
        out.append(_span(0, a, b, re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", AT.sub("@", text[a:b].lower()))))
    out += [_span(1, m.start(), m.end(), m[0].lower()) for m in GROUPS.finditer(text)]
    for m in NUMBER.finditer(text):
        number = digits(m[0])
        out += [_span(2, m.start(), m.end(), number)] if 12 <= len(number) <= 19 else []
        out += [_span(3, m.start(), m.end(), number)] if len(number) <= 15 else []
    taken, free, k = sorted((s.start, s.end) for s in base), [], 0
    reach = [0]
    for _, b in taken:
        reach.append(max(reach[-1], b))
    for s in sorted(out):
        while k < len(taken) and taken[k][0] < s.end:
            k += 1
        j = k
        while j and taken[j - 1][0] >= s.end:
            j -= 1
        if reach[j] <= s.start:
            free.append(s)
    return free


def beside(text: str, s: Span) -> tuple[list[bytes], list[bytes]]:
    """Up to two words before a span, the nearest first, and up to two behind it."""
    low, high = max(0, s.start - REACH), min(len(text), s.end + REACH)
    inside = lambda i: 0 <= i < len(text) and WORD.match(text, i) is not None
    before, behind = [], []
    if not (inside(s.start) and inside(s.start - 1)):
        found = [m for m in WORD.finditer(text, low, s.start)][-2:]
        before = [m for m in found if m.start() > low or not inside(low - 1)]
    if not (inside(s.end - 1) and inside(s.end)):
        for m in WORD.finditer(text, s.end, high):
            if len(behind) == 2 or (m.end() == high and inside(high)):
                break
            behind.append(m)
    plain = lambda m: m[0].encode("utf-8", "surrogatepass").lower()
    return [plain(m) for m in reversed(before)], [plain(m) for m in behind]


def word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words) + bytes(16), dtype=np.uint8)
    return hash_spans(data, ends - np.array([len(w) for w in words], dtype=np.int64), ends)


def joint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring words."""
    with np.errstate(over="ignore"):
        return mix64(first * _STEP + second)


def _grams(texts: list[tuple[str, list[Span]]]) -> list[list[tuple[int, int]]]:
    """(side, gram) of each span: side 0 before it, 1 behind it."""
    words, plan = [], []
    for text, spans in texts:
        for s in spans:
            sides = beside(text, s)
            plan.append([len(x) for x in sides])
            words += [w for x in sides for w in x]
    h, out, k = word_hashes(words), [], 0
    pairs = joint(h[:-1], h[1:]).view(np.int64).tolist() if len(h) > 1 else []
    swapped = joint(h[1:], h[:-1]).view(np.int64).tolist() if len(h) > 1 else []
    single = h.view(np.int64).tolist()
    for counts in plan:
        got = []
        for side, n in enumerate(counts):
            if n:
                got.append((side, single[k]))
            if n == 2:
                got.append((side, pairs[k] if side else swapped[k]))  # words before a span come nearest first
            k += n
        out.append(got)
    return out


SPANS = "array<struct<start:long,kind:int,end:long,value:long>>"
EDGE = "array<struct<kind:int,value:long,seed:boolean,side:int,gram:long>>"


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, candidates (spans), edges of every whole text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))
    edge = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.int64()), ("seed", pa.bool_()), ("side", pa.int32()), ("gram", pa.int64())]))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more, edges, several = [], [], [], []
            for text in texts_of(batch):
                own = base_spans(text) if ANY.search(text) else []
                other = candidates(text, own) if ANY.search(text) else []
                base.append([s._asdict() for s in own])
                more.append([s._asdict() for s in other])
                several.append((text, own + other))
            grams = iter(_grams(several))
            for (_, spans), own in zip(several, base, strict=True):
                edges.append([{"kind": s.kind, "value": s.value, "seed": i < len(own), "side": side, "gram": g} for i, s in enumerate(spans) for side, g in next(grams)])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(more, span), pa.array(edges, edge)], ["doc_id", "base", "candidates", "edges"])

        return f

    return map_arrow(pick(docs, "doc_id", "text"), f"doc_id long, base {SPANS}, candidates {SPANS}, edges {EDGE}", make)


def text_grams(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of all words and pairs of neighbouring words of texts, a chunk at a time."""
    column, n = as_strings(column), len(column)
    if not n or column.buffers()[2] is None:
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(raw, raw[first] + CHUNK, side="right")) - 1)
        offsets = raw[first : end + 1] - raw[first] + np.arange(end - first + 1)  # one byte between texts
        size = int(offsets[-1])
        data, inside = np.zeros(size + 16, dtype=np.uint8), np.ones(size, dtype=bool)
        inside[offsets[1:] - 1] = False
        data[:size][inside] = whole[raw[first] : raw[end]]
        data[(data >= 65) & (data <= 90)] |= 0x20
        b = data[:size]
        part = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
        edge = np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        h = hash_spans(data, low, high)
        text = np.searchsorted(offsets, low, side="right")
        same = text[1:] == text[:-1]
        yield np.concatenate([h, joint(h[:-1][same], h[1:][same])]) if len(h) else h
        first = end


def gram_counts(docs: DataFrame, grams: DataFrame, most_sent: int) -> DataFrame:
    """gram, occurrences: how often the words or pairs of words `grams` stand in all texts."""
    wanted = None
    if grams.count() <= most_sent:
        got = grams.select("gram").toArrow().column("gram").to_numpy()  # at most most_sent numbers of 8 bytes
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(got.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            for h in text_grams(batch.column("text")):
                h = h.view(np.int64)
                if known is not None:
                    if not len(known):
                        continue
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[known[at] == h]
                if len(h):
                    g, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["gram", "n"])

    counts = pick(docs, "text").where("text IS NOT NULL").mapInArrow(giving_back(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("occurrences"))
    return counts if wanted is not None else counts.join(grams.select("gram"), "gram", "left_semi")


def accepted_values(edges: DataFrame, occurrences: DataFrame, *, rounds: int, support: int, confident: int, accepted: int, doubt: int) -> DataFrame:
    """kind, value of candidates that count as identifiers. edges: kind, value, seed, side, gram, n."""
    pattern, instance = ["kind", "side", "gram"], ["kind", "value"]
    seeds = edges.where("seed").select(*instance).distinct().withColumn("score", F.lit(1000).cast("long"))
    scores = seeds
    for _ in range(rounds):
        scored = edges.join(scores, instance, "left").withColumn("score", F.coalesce("score", F.lit(0)))
        by_value = scored.groupBy(*pattern, "value").agg(F.sum("n").alias("n"), F.max("score").alias("score"))
        patterns = by_value.groupBy(*pattern).agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count_if(F.col("score") >= accepted).alias("instances"))
        patterns = patterns.where(F.col("instances") >= support).join(occurrences, "gram")
        confidence = F.least(F.floor(F.col("hits") / (F.col("occurrences") + doubt)), F.lit(999)).cast("long")
        patterns = patterns.select(*pattern, confidence.alias("confidence")).where(F.col("confidence") >= confident)
        doubts = F.floor(F.log(1 - F.col("confidence") / 1000) * 1000).cast("long")  # in whole thousandths, so that their sum is the same in any order
        new = by_value.select(*pattern, "value").join(patterns, pattern).groupBy(*instance).agg(F.floor(1000 - 1000 * F.exp(F.sum(doubts) / 1000)).cast("long").alias("score"))
        scores = saved(new.unionByName(seeds).groupBy(*instance).agg(F.max("score").alias("score")), "scores")
    return scores.where(F.col("score") >= accepted).select(*instance)


def personal_data(docs: DataFrame, *, rounds: int = 3, support: int = 5, confident: int = 700, accepted: int = 800, doubt: int = 2, most_sent: int = 1_000_000) -> DataFrame:
    """doc_id, base, spans (array of start, kind, end) of every whole text; base ones are among the spans."""
    found = saved(found_spans(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    edges = found.select(F.inline("edges")).groupBy("kind", "value", "seed", "side", "gram").agg(F.count("*").alias("n"))
    pattern = ["kind", "side", "gram"]
    often = edges.select(*pattern, "value").distinct().groupBy(*pattern).agg(F.count("*").alias("values")).where(F.col("values") >= support)
    edges = saved(edges.join(often.select(*pattern), pattern, "left_semi"), "edges")
    grams = saved(edges.select("gram").distinct(), "grams")
    occurrences = saved(gram_counts(docs, grams, most_sent), "occurrences")
    known = accepted_values(edges, occurrences, rounds=rounds, support=support, confident=confident, accepted=accepted, doubt=doubt)
    # values of seeds that stand beside no frequent words count as well
    values = known.unionByName(found.select(F.inline("base")).select("kind", "value")).distinct()
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = found.select("row", F.inline("candidates")).join(values, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    rows = found.select("row", "doc_id", plain("base").alias("base")).join(more, "row", "left")
    return rows.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.expr("array()"))))).alias("spans"))


def told(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
