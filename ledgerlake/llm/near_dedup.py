"""MinHash near-dedup (operator 6): consistent weighted sampling of TF-IDF shingles, banded and verified.

A text's shingles are its runs of five words. A shingle weighs (1 + ln tf) * idf, idf = 1 + ln(N / df) / (4 ln(N / floor)), between
1 and 1.25, and weights are rounded to powers of e^(1/32). df is the exact number of documents, all copies counted; shingles of
fewer documents than the floor count as the floor, which is 1 or 2^-20 of all (document, shingle) pairs, so that at most 2^20
shingles lie above it and the share of documents it stands for is the same at every size. They are found in two passes: counts
in 2^22 hash buckets, then exact counts of the shingles in buckets that reach the floor.

Improved consistent weighted sampling draws BANDS x ROWS samples of a text, so that two texts share a sample with the
probability of their weighted Jaccard similarity. Its random numbers come from a fixed table by weight and shingle hash. Texts
that share a band and at least AGREE samples of all are candidates; a pair is linked if its weighted Jaccard similarity is 0.8
or more. Linked texts form classes (connected components); exact copies share their text's class.

Every text first meets its earliest candidate in each band, in an order that differs from band to band; classes follow from
the links found, and candidates of different classes meet again in another order. The candidates that still lie in different
classes then meet all of each other inside the tasks that hold their band's bucket, so no link between classes is lost, and
pairs are never written out.

Scale: buckets of more than `block` texts are compared in tiles of that size. Shingles and weights of candidates, found by a
Bloom filter of fixed size, are written once and joined by text hash. Class ids come from aggregates and equi-joins.

Defined results: a text of fewer than five words has one shingle of all its words, texts without words are alike only if equal,
null counts as empty; repeated rows share a class; documents without id are classified too, and a class of only such has a
null id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.candidates import bloom, compare, components, in_groups, may_hold
from ledgerlake.llm.common import giving_back, map_arrow, mix64, pick, saved, table, texts_of
from ledgerlake.llm.words import Words, chunks, tally

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
AGREE = 17
BUCKET_BITS = 22
PART_BITS = 14  #: buckets of document counts travel in runs of this many bits
MOST_KNOWN = 1 << 20  #: shingles whose df can lie above the floor
IDF_RANGE = 0.25
FINE = 32  #: weights are powers of e^(1/FINE)
LEVELS = 128
BLOCK = 5_000
TURNS = 2  #: meetings in one order each, before all candidates of different classes meet
TABLE_BITS = 14
_FACTORS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def text_hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def text_hashes(w: Words) -> np.ndarray:
    """text_hash of a chunk's texts."""
    raw, at = memoryview(w.data), w.offsets.tolist()
    return np.array([int.from_bytes(xxhash.xxh3_64_digest(raw[a:b]), "big", signed=True) for a, b in zip(at, at[1:], strict=False)], dtype=np.int64)


def shingled(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, tf) of a chunk: the different shingles of each text, ascending."""
    h, n = w.hashes(), len(w.start)
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS):
            out += h[k : k + len(out)] * _FACTORS[k]
        whole = w.text[: len(out)] == w.text[WORDS - 1 :] if len(out) else np.zeros(0, dtype=bool)
        shingle, text = mix64(out[whole]), w.text[: len(out)][whole]
        words = np.bincount(w.text, minlength=w.texts)
        few = np.flatnonzero((words > 0) & (words < WORDS))
        if len(few):
            first = np.searchsorted(w.text, few)
            short = np.array([mix64(np.sum(h[a : a + m] * _FACTORS[:m], dtype=np.uint64)[None])[0] for a, m in zip(first.tolist(), words[few].tolist(), strict=True)], dtype=np.uint64)
            shingle, text = np.concatenate([shingle, short]), np.concatenate([text, few])
    if w.texts < 1 << 16:
        order = np.argsort(shingle)
        order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, dtype=np.int64)
    return shingle[new], text[new], np.diff(np.r_[new, len(text)]).astype(np.int64)


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype("<u2" if counts.max() < 1 << 16 else "<i8").tobytes()


def bucket_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and for each hash bucket the documents times different shingles in it."""
    runs, width = 1 << (BUCKET_BITS - PART_BITS), 1 << PART_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(runs * width, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for w in chunks(batch.column("text")):
                bucket, times = np.unique(_bucket(shingled(w)[0]), return_counts=True)
                seen[bucket] += times
        if n:
            parts = [_packed(seen[k * width : (k + 1) * width]) for k in range(runs)]
            yield pa.RecordBatch.from_arrays([pa.array(range(runs), pa.int32()), pa.array(parts), pa.array([n] + [0] * (runs - 1), pa.int64())], ["run", "counts", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        for batch in batches:
            for k, raw, n in zip(batch.column("run").to_pylist(), batch.column("counts").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * width else "<i8").astype(np.int64)
                docs[k] = docs.get(k, 0) + n
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(v)]), pa.array([docs[k]], pa.int64())], ["run", "counts", "n"])

    schema = "run int, counts binary, n long"
    sums = pick(docs, "text").mapInArrow(giving_back(run), schema).repartition("run").mapInArrow(giving_back(added), schema)
    out, n = np.zeros(runs * width, dtype=np.int64), 0
    for r in sums.collect():  # as many bytes as the table has, whatever the corpus
        out[r.run * width : (r.run + 1) * width] = np.frombuffer(r.counts, dtype="<u2" if len(r.counts) == 2 * width else "<i8")
        n += r.n
    return n, out


class Idf:
    """idf of shingles: those known with their df, ascending; all others have the floor's."""

    def __init__(self, n: int, floor: float, shingle: np.ndarray, df: np.ndarray):
        low = np.log(max(1.0, n / floor))
        scale = IDF_RANGE / low if low > 0 else 0.0
        self.shingle = shingle
        self.idf = 1 + scale * np.log(np.maximum(1.0, n / np.maximum(df, floor)))
        self.rest = 1 + IDF_RANGE if low > 0 else 1.0

    def levels(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weights as levels: w = e^(level / FINE)."""
        idf = np.full(len(shingle), self.rest)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            idf = np.where(self.shingle[at] == shingle, self.idf[at], idf)
        return np.clip(np.rint(FINE * np.log((1 + np.log(tf)) * idf)), 0, LEVELS - 1).astype(np.uint8)


def document_frequencies(docs: DataFrame) -> Idf:
    n, counts = bucket_counts(docs)
    floor = max(1.0, float(counts.sum()) / MOST_KNOWN)
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(counts >= floor))  # 2^BUCKET_BITS bits

    def make():
        some = np.unpackbits(held.value).astype(bool)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = []
            for w in chunks(batch.column("text")):
                s = shingled(w)[0]
                found.append(s[some[_bucket(s)]])
            s, n = tally(found)
            return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"]) if len(s) else None

        return f

    known = map_arrow(pick(docs, "text"), "shingle long, n long", make).groupBy("shingle").agg(F.sum("n").alias("df")).where(F.col("df") >= floor)
    got = known.toArrow()  # at most MOST_KNOWN rows: their df are parts of the sum of all counts
    shingle, df = got.column("shingle").to_numpy().view(np.uint64), got.column("df").to_numpy()
    order = np.argsort(shingle)
    return Idf(n, floor, shingle[order], df[order])


class Sampler:
    """Improved consistent weighted sampling of weights that are powers of e^(1/FINE)."""

    def __init__(self):
        k, size = BANDS * ROWS, 1 << TABLE_BITS
        draw = np.random.default_rng(20_240_101)
        r, c, beta = draw.gamma(2.0, 1.0, size) + 1e-6, draw.gamma(2.0, 1.0, size) + 1e-30, draw.random(size)
        t = np.floor(np.arange(LEVELS)[:, None] / FINE / r + beta)
        a = (np.log(c) - r * (t - beta + 1)).reshape(-1)
        rank = np.empty(len(a), dtype=np.int64)
        rank[np.argsort(a, kind="stable")] = np.arange(len(a))
        self.code = rank << 32  #: by level and slot: its place among all, to be compared with those of other shingles
        self.t = t.reshape(-1).astype(np.int64)
        self.factors = (draw.integers(1 << 62, size=k, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def sample(self, shingles: np.ndarray, levels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64-bit hashes of the samples, a row for each text. shingles: those of all texts in turn; sizes: how many each text has, over 0."""
        starts = np.cumsum(sizes) - sizes
        base, place = levels.astype(np.int64) << TABLE_BITS, np.arange(len(shingles))
        out = np.zeros((len(sizes), len(self.factors)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(self.factors):
                at = ((shingles * factor) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                at += base
                i = np.minimum.reduceat(self.code[at] | place, starts) & 0xFFFFFFFF
                out[:, k] = shingles[i] ^ (self.t[at[i]].view(np.uint64) * factor)
        return mix64(out)


@cache
def shared_sampler() -> Sampler:
    return Sampler()


SIGNATURES = "text_hash long, bands array<long>, samples binary"


def signatures(docs: DataFrame, idf) -> DataFrame:
    """text_hash, bands, samples (16 bits each) of every different text that has words. idf: broadcast."""

    def make():
        sampler, seen = shared_sampler(), set()
        place = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)

        def signed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own, (shingle, text, tf) = text_hashes(w), shingled(w)
            new = np.array([h not in seen and not seen.add(h) for h in own.tolist()], dtype=bool)
            keep = new[text]
            shingle, text, tf = shingle[keep], text[keep], tf[keep]
            levels = idf.value.levels(shingle, tf)
            ids, first, sizes = np.unique(text, return_index=True, return_counts=True)
            samples = [np.zeros((0, BANDS * ROWS), dtype=np.uint64)]
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(first, first[low] + 30_000)))
                part = slice(first[low], first[high] if high < len(ids) else len(text))
                samples.append(sampler.sample(shingle[part], levels[part], sizes[low:high]))
                low = high
            if len(seen) > 1_000_000:
                seen.clear()
            s = np.concatenate(samples)
            bands = np.repeat(place[None, :], len(ids), axis=0)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    bands = mix64(bands + s[:, k::ROWS])
            return own[ids], bands.view(np.int64), (s >> np.uint64(48)).astype("<u2")

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            own, bands, samples = (np.concatenate(x) for x in zip(*map(signed, chunks(batch.column("text"))), strict=True))
            if not len(own):
                return None
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(own), lists, pa.array([x.tobytes() for x in samples], pa.binary())], ["text_hash", "bands", "samples"])

        return f

    return map_arrow(pick(docs, "text"), SIGNATURES, make).dropDuplicates(["text_hash"])


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    raw = np.frombuffer(b"".join(t.column("samples").to_pylist()), dtype="<u2").reshape(t.num_rows, BANDS * ROWS)
    return {"samples": raw} | ({"label": t.column("label").to_numpy()} if "label" in t.column_names else {})


def _agreeing(col: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)
    for low in range(0, len(x), 100_000):
        part = slice(low, low + 100_000)
        out[part] = (col["samples"][x[part]] == col["samples"][y[part]]).sum(axis=1) >= AGREE
    return out


def _apart(col: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = col["label"][x] != col["label"][y]
    at = np.flatnonzero(out)
    out[at] = _agreeing(col, y[at], x[at])
    return out


def bucketed(signed: DataFrame, block: int = BLOCK, turn: int = 0) -> DataFrame:
    """A row for each text and band, dealt in tiles where a band's bucket has more than block texts. place: an order of each band's own."""
    rows = signed.select("*", F.explode("bands").alias("band")).drop("bands").withColumn("place", F.xxhash64("text_hash", "band", F.lit(turn)))
    big = saved(rows.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > block), "big-buckets")
    if big.isEmpty():
        return rows.withColumn("tile", F.lit(0).cast("long"))
    rows = rows.join(big, "band", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("long"))
    rows = rows.withColumn("own", F.pmod("text_hash", "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return rows.withColumn("tile", F.greatest("own", "other") * F.col("tiles") + F.least("own", "other")).drop("n", "tiles", "own", "other")


VECTORS = "text_hash long, shingles binary, levels binary"


def vectors(docs: DataFrame, ids: DataFrame, idf) -> DataFrame:
    """Shingles and weights of the texts whose hashes are in ids (text_hash)."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(ids, "text_hash"))

    def make():
        seen: set[int] = set()

        def of(w: Words) -> Iterator[tuple[int, bytes, bytes]]:
            own = text_hashes(w)
            some = np.array([h not in seen and not seen.add(h) for h in own.tolist()], dtype=bool) & may_hold(held.value, own)
            keep = some[w.text]
            shingle, text, tf = shingled(w._replace(start=w.start[keep], end=w.end[keep], text=w.text[keep]))
            levels = idf.value.levels(shingle, tf)
            at = np.searchsorted(text, np.arange(w.texts + 1)).tolist()
            for k in np.flatnonzero(some).tolist():
                yield int(own[k]), shingle[at[k] : at[k + 1]].tobytes(), levels[at[k] : at[k + 1]].tobytes()
            if len(seen) > 1_000_000:
                seen.clear()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = [x for w in chunks(batch.column("text")) for x in of(w)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["text_hash", "shingles", "levels"]) if rows else None

        return f

    return map_arrow(pick(docs, "text"), VECTORS, make).dropDuplicates(["text_hash"]).join(ids, "text_hash", "left_semi")


_WEIGHTS = np.exp(np.arange(256) / FINE)


def vector(shingles: bytes, levels: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles, dtype=np.uint64), _WEIGHTS[np.frombuffer(levels, dtype=np.uint8)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending shingles, weights)."""
    if not (len(a[0]) and len(b[0])):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """x, y of the pairs (of text hashes) that are similar. known: their vectors."""
    x = known.select(F.col("text_hash").alias("x"), F.col("shingles").alias("sx"), F.col("levels").alias("lx"))
    y = known.select(F.col("text_hash").alias("y"), F.col("shingles").alias("sy"), F.col("levels").alias("ly"))
    both = pairs.select("x", "y").join(x, "x").join(y, "y")

    def verify():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sx", "lx", "sy", "ly")), strict=True)
            return batch.select(["x", "y"]).filter(pa.array([similarity(vector(sx, lx), vector(sy, ly)) >= SIMILARITY for sx, lx, sy, ly in rows], pa.bool_()))

        return f

    return map_arrow(both.select("x", "y", "sx", "lx", "sy", "ly"), "x long, y long", verify)


def last_links(signed: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """x, y: links between texts of different labels that are candidates, found inside the tasks. signed: with label and bands."""
    keys = ["band", "tile"]
    rows = bucketed(signed.withColumn("all", F.col("bands")), block, TURNS)

    def meeting(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        _, at, _ = compare_rows(t, group)
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pa.array(at)) for c in ("band", "tile", "text_hash")], ["band", "tile", "text_hash"]) if len(at) else None

    some = in_groups(rows.select("band", "tile", "text_hash", "label", "samples", "all"), keys, ["text_hash"], meeting, "band long, tile long, text_hash long")
    some = saved(some, "bucket-members")
    full = some.join(known, "text_hash").join(signed.select("text_hash", "label", "samples", F.col("bands").alias("all")), "text_hash")

    def verify(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        pairs, _, label = compare_rows(t, group)
        own, shingles, levels = t.column("text_hash").to_numpy(), t.column("shingles").to_pylist(), t.column("levels").to_pylist()
        got, parent = [], {}

        def find(v: int) -> int:
            while (u := parent.get(v, v)) != v:
                parent[v] = v = parent.get(u, u)
            return v

        for x, y in pairs:
            a, b = find(int(label[x])), find(int(label[y]))
            if a != b and similarity(vector(shingles[x], levels[x]), vector(shingles[y], levels[y])) >= SIMILARITY:
                parent[a] = b
                got.append((own[x], own[y]))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], ["x", "y"]) if got else None

    columns = ["band", "tile", "text_hash", "label", "samples", "all", "shingles", "levels"]
    return in_groups(full.select(*columns), keys, ["text_hash"], verify, "x long, y long", batch_rows=4_000)


def compare_rows(t: pa.Table, group: np.ndarray) -> tuple[Iterator[tuple[int, int]], np.ndarray, np.ndarray]:
    """(pairs, rows of any pair, labels): candidates of different labels whose first common band is the one they stand in."""
    col = _columns(t)
    bands = t.column("all").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS)
    here = t.column("band").to_numpy()

    def passing(left: np.ndarray, d: int) -> np.ndarray:
        left = left[_apart(col, left, left + d)]
        common = (bands[left] == bands[left + d]).argmax(axis=1)
        return left[bands[left, common] == here[left]]

    def steps() -> Iterator[tuple[np.ndarray, int]]:
        left, d = np.arange(len(group)), 1
        while True:
            left = left[left + d < len(group)]
            left = left[group[left] == group[left + d]]
            if not len(left):
                return
            yield passing(left, d), d
            d += 1

    hit = np.zeros(len(group), dtype=bool)
    for at, d in steps():
        hit[at] = hit[at + d] = True
    pairs = ((i, i + d) for at, d in steps() for i in at.tolist())
    return pairs, np.flatnonzero(hit), col["label"]


def links(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """node, label: the class of each text (hash) that has a similar, different one."""
    idf = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))  # at most MOST_KNOWN shingles
    signed = saved(signatures(docs, idf), "signatures")
    keys, order, item = ["band", "tile"], ["place", "text_hash"], "text_hash"
    met = saved(compare(bucketed(signed, block), keys, order, item, _columns, _agreeing, touched=True).groupBy("x", "y").agg(F.max("more").alias("more")), "met")
    ids = saved(met.select(F.explode(F.array("x", "y")).alias("text_hash")).distinct(), "met-texts")
    known = saved(vectors(docs, ids, idf), "vectors")
    tried = met.where("x <> y").select("x", "y")
    edges = saved(linked(tried, known), "links")
    labels = components(edges)
    if met.where("more").isEmpty():
        return labels
    some = saved(signed.join(ids, "text_hash", "left_semi"), "met-signatures")

    def named() -> DataFrame:
        return some.join(labels.select(F.col("node").alias("text_hash"), "label"), "text_hash", "left").withColumn("label", F.coalesce("label", "text_hash"))

    for turn in range(1, TURNS):
        rest = compare(bucketed(named(), block, turn), keys, order, item, _columns, _apart)
        rest = rest.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        rest = saved(rest.join(tried.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")), ["x", "y"], "left_anti"), "more-pairs")
        more = saved(linked(rest, known), "more-links")
        tried, edges = tried.unionByName(rest), edges.unionByName(more)
        if not more.isEmpty():
            labels = components(edges)
    more = saved(last_links(saved(named(), "named-signatures"), known, block), "last-links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def classified(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """row, doc_id, text_hash, class_id (the smallest document id of the class), kept (one row of each class)."""
    labels = saved(links(docs, block=block), "text-classes")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(text_hash, texts_of(batch)), pa.int64())], ["doc_id", "text_hash"])

        return f

    rows = map_arrow(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id long, text_hash long", make)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    named = rows.join(labels.select(F.col("node").alias("text_hash"), "label"), "text_hash", "left").withColumn("label", F.coalesce("label", "text_hash"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    return named.join(first, "label").select("row", "doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def keep_one(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class."""
    kept = saved(classified(docs, block=block).where("kept").select(F.col("doc_id").alias("kept_doc"), F.col("text_hash").alias("kept_hash")), "kept")
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names that clash with nothing here
    doc, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(text_hash, texts_of(batch, text)), pa.int64())], [*batch.schema.names, "own_hash"])

        return f

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema), "own_hash long"])
    keyed = map_arrow(own, schema, make)
    joined = keyed.join(kept, F.col(doc).cast("long").eqNullSafe(F.col("kept_doc")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi")
    return joined.dropDuplicates([doc, "own_hash"]).drop("own_hash").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
