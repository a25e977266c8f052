"""Quality classifier (operator 10): Zstandard dictionaries of good and bad text.

Two dictionaries are trained, one from good and one from bad labelled text. A text is cut into windows, every window is
compressed with either dictionary, and the sizes are summed over the whole text. The normalised difference of the two sums
goes through a logistic calibration to a score from 0 to 1. The calibration learns from a fold of labelled rows that the
dictionaries haven't seen.

Bounds: the dictionaries learn from at most `max_windows` windows of each class, the calibration from at most `max_rows`
labelled rows of each class; both are taken in the order of a hash, so they are the same however the rows are dealt out.
Scoring reads whole texts.

Defined results: null and empty texts get the score of an empty text; repeated rows get one row each; a table without
usable labels of both classes gives every text the score 0.5; labels that are null or name unknown documents don't count.
Of a labelled id's several texts the least in binary order is learned from, of its several labels the greatest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import crc_mod, map_arrow, pick, table, texts_of

WINDOW = 1000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  #: the intercept first


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    return [text[i : i + size].encode("utf-8", "surrogatepass") for i in range(0, len(text), size)]


def measurer(model: Model):
    """A function from a text to its feature."""
    by = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=3)
        by.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    good, bad = by

    def measure(text: str) -> float:
        g = b = 0
        for w in windows(text):
            g += len(good(w))
            b += len(bad(w))
        return (b - g) / max(1, b + g)

    return measure


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[tuple, tuple, tuple]:
    """Logistic regression by Newton's method on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - ridge * w)
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 3000, max_windows: int = 3000, dictionary_bytes: int = 110_000, folds: int = 5) -> Model | None:
    """Learn from labelled rows whose crc32(doc_id) modulo `folds` is not 0. None if a class has no text."""
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(crc_mod(F.col("doc_id"), folds) != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(*order).limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # at most 2 x max_rows ids
    sample = sample.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    cut = sample.select("quality", "doc_id", F.explode(F.expr(f"sequence(0, int((length(text) - 1) / {WINDOW}))")).alias("k"), "text").where("length(text) > 0")
    cut = cut.select("quality", "doc_id", "k", F.expr(f"substring(text, k * {WINDOW} + 1, {WINDOW})").alias("w"))
    dictionaries = []
    unseen = crc_mod(F.col("doc_id"), folds) == 1
    for q in (1, 0):
        got = cut.where(~unseen).where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "w").limit(max_windows).select("w").collect()
        try:
            dictionaries.append(zstandard.train_dictionary(dictionary_bytes, [r.w.encode("utf-8", "surrogatepass") for r in got]).as_bytes())
        except zstandard.ZstdError:  # too little text for the trainer: the text itself serves as the dictionary
            if not got:
                return None
            dictionaries.append(b"".join(r.w.encode("utf-8", "surrogatepass") for r in got)[-dictionary_bytes:])
    raw = Model(dictionaries[0], dictionaries[1], (), (), ())

    def make():
        measure = measurer(raw)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("unseen"), pa.array(map(measure, texts_of(batch)), pa.float64())], ["quality", "unseen", "d"])

        return f

    got = map_arrow(sample.select("quality", unseen.alias("unseen"), "text"), "quality int, unseen boolean, d double", make).collect()  # a row for each of the sample
    rows = sorted((r.d, r.quality) for r in got if r.unseen)
    if len({q for _, q in rows}) < 2:  # too few labels for a fold of their own
        rows = sorted((r.d, r.quality) for r in got)
    mean, scale, weights = calibrate(np.array([[d] for d, _ in rows]), np.array([q for _, q in rows], dtype=float))
    return Model(raw.good, raw.bad, mean, scale, weights)


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: the calibrated score of the whole text."""
    kept = [c for c in docs.columns if c != out]
    docs = pick(docs, *kept)
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` double"])

    def make():
        m = held.value
        measure, (w0, *w) = measurer(m), m.weights

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([[measure(t)] for t in texts_of(batch, text)])
            z = w0 + ((x - np.array(m.mean)) / np.array(m.scale)) @ np.array(w)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, out])

        return f

    return map_arrow(docs, schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
