"""Quality rules (operator 1): lines that many documents of a host share.

Each document's lines are normalised (lower case, runs of blanks and the controls 9 to 13 as one blank, trimmed) and hashed
together with the document's host. For every hash the distinct documents (ids) of the host are counted. Lines found in more
than `min_docs` documents and more than `max_percent` of all documents of their host are removed from all of them but the first
(the smallest id), so that no passage vanishes from the corpus and a host is treated alike at every size. A document is rejected if more than `max_removed` of its words
go that way, or if it fails the base rules (under 50 words, or over half of them in repeated three-word windows).

Scale: the counts are pre-aggregated before they are shuffled, so a line that every document has costs one row a task; only
the lines of ids that stand in several rows are first made distinct by id. Such ids are broadcast while their number, which is
checked, stays within `broadcast_rows`; beyond that all lines are made distinct by id.
Lines above the limit are broadcast while their number, which is checked, stays within `broadcast_rows`; beyond that the
affected documents meet their lines in a join.

Defined results: null text has no words and fails the base rules; a null host is a host of its own; repeated rows count
as one document and each get their own row; an empty table gives an empty result; other columns are passed through, but for
those named like a measure, which the measure replaces.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.llm.common import map_arrow, saved, table, texts_of

MIN_DOCS = 10
MAX_PERCENT = 5
MAX_REMOVED = 0.7
BROADCAST_ROWS = 1_000_000
HOST = "host"  #: added by _with_host, which keeps no column of that name

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, removed_words long, base_failed boolean, kept boolean"
_SPACES = re.compile(r"[ \t-\r]+")
_BLANKS = " \t\n\v\f\r"
_SYMBOLS = re.compile(r"[^#*$%&|<>]+")


def line_key(host: str, line: str) -> int:
    """A signed 64-bit hash of a host and a normalised line."""
    norm = _SPACES.sub(" ", line.lower()).strip(" ")
    return int.from_bytes(xxhash.xxh3_64_digest(f"{host}\0{norm}".encode("utf-8", "surrogatepass")), "big", signed=True)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    if len(seen) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # more different words than three of their numbers fit into 63 bits
        pairs = np.unique(np.stack([ids[:-1], ids[1:]]), axis=1, return_inverse=True)[1].reshape(-1)
        keys = np.unique(np.stack([pairs[:-1], ids[2:]]), axis=1, return_inverse=True)[1].reshape(-1)
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = (counts > 1)[back.reshape(-1)]
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # on blanks and the controls 9 to 13, as bytes
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(_SYMBOLS.sub("", text))
    lines = Counter(text.split("\n"))
    dups = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(" \t\v\f\r"))
    return len(words), chars, symbols, dups, repeat_words(words)


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key long, first_doc long: a row for each line that too many distinct documents of a host have."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [list({line_key(host, x) for x in t.split("\n") if x.strip(_BLANKS)}) for t, host in zip(texts_of(batch), batch.column(HOST).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host_key"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "host_key", "keys"])

        return f

    rows = _with_host(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", HOST, F.xxhash64(HOST).alias("host_key"))
    lines = map_arrow(rows, "doc_id long, host_key long, keys array<long>", make)
    ids = saved(rows.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again", F.lit(True).alias("several")), "repeated-ids")
    if ids.count() <= broadcast_rows:
        lines = lines.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("again")), "left").select("doc_id", "host_key", "keys", F.coalesce("several", F.lit(False)).alias("several"))
    else:
        lines = lines.withColumn("several", F.lit(True))
    lines = lines.select("doc_id", "host_key", "several", F.when(F.col("several"), F.col("doc_id")).alias("own"), F.explode("keys").alias("key"))
    parts = lines.groupBy("key", "several", "own").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min("host_key").alias("host_key"))
    docs_of = F.sum(F.when(F.col("several"), 1).otherwise(F.col("n")))  # a document with several rows counts once
    found = parts.groupBy("key").agg(docs_of.alias("n"), F.min("first_doc").alias("first_doc"), F.min("host_key").alias("host_key")).where(F.col("n") > min_docs)
    hosts = rows.select("host_key", "doc_id").distinct().groupBy("host_key").agg(F.count("*").alias("docs"))
    return found.join(hosts, "host_key").where(100 * F.col("n") > max_percent * F.col("docs")).select("key", "first_doc")


def _with_host(docs: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, text, source and the host; the extra columns together in a struct, where their names can't clash."""
    others = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra")] if extra else []
    return docs.select("doc_id", "text", "source", *others).withColumn(HOST, F.coalesce(F.col("source").cast("string"), F.lit("\0")))


def _judged(text: str, host: str, doc_id, common) -> tuple:
    """The measures, the verdict and the text without common lines. common: key -> first document."""
    n_words, chars, symbols, dups, repeats = measure(text)
    failed = base_fails(n_words, repeats)
    removed, left = 0, text
    if common:
        rest = []
        for line in text.split("\n"):
            key = line_key(host, line) if line.strip(_BLANKS) else None
            if key in common and common[key] != doc_id:
                removed += len(line.encode("utf-8", "surrogatepass").split())
            else:
                rest.append(line)
        left = "\n".join(rest)
    return n_words, chars, symbols, dups, repeats, removed, failed, not failed and removed <= MAX_REMOVED * n_words, left


def judge(docs: DataFrame, *, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT, broadcast_rows: int = BROADCAST_ROWS, with_text: bool = False) -> DataFrame:
    """doc_id, the measures and the verdict of every document; with_text: its other columns and its text without common lines too."""
    spark = docs.sparkSession
    measures = StructType.fromDDL(MEASURES)
    taken = {"doc_id", "text", "source", *measures.names}
    extra = [c for c in docs.columns if c.lower() not in taken] if with_text else []
    common = saved(common_lines(docs, min_docs, max_percent, broadcast_rows), "common-lines")
    rows = _with_host(docs, extra)
    if few := common.count() <= broadcast_rows:
        held = spark.sparkContext.broadcast({r.key: r.first_doc for r in common.collect()})  # at most broadcast_rows pairs of integers
    else:
        rows = _with_own_lines(rows, common)
    names = ["doc_id", *(["text", "source"] if with_text else []), *(["extra"] if extra else [])]
    schema = StructType([*(rows.schema[c] for c in names), *measures])
    out_names = schema.names

    def make():
        every = held.value if few else None

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [dict(x or ()) for x in batch.column("own").to_pylist()] if every is None else [every] * batch.num_rows
            got = [_judged(t, h, d, c) for t, h, d, c in zip(texts_of(batch), batch.column(HOST).to_pylist(), batch.column("doc_id").to_pylist(), own, strict=True)]
            *cols, left = zip(*got, strict=True)
            was = batch.column("text").to_pylist() if with_text else []
            text = pa.array([None if a is None else b for a, b in zip(was, left, strict=True)], pa.string()) if with_text else None
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            return pa.RecordBatch.from_arrays([*(text if c == "text" else batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], out_names)

        return f

    out = map_arrow(rows, schema, make)
    return out.select("doc_id", "text", "source", "extra.*", *measures.names) if extra else out


def _with_own_lines(rows: DataFrame, common: DataFrame) -> DataFrame:
    """rows with a column own: the common lines that each document has, from a join instead of a broadcast."""
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [list({line_key(h, x) for x in t.split("\n") if x.strip(_BLANKS)}) for t, h in zip(texts_of(batch), batch.column(HOST).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "keys"])

        return f

    rows = rows.withColumn("text_hash", F.xxhash64("text", HOST))
    lines = map_arrow(rows.select("doc_id", "text_hash", "text", HOST), "doc_id long, text_hash long, keys array<long>", make)
    found = lines.select("doc_id", "text_hash", F.explode("keys").alias("key")).join(common, "key")
    own = found.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_set(F.struct("key", "first_doc"))).alias("own"))
    own = own.select(F.col("doc_id").alias("own_doc"), F.col("text_hash").alias("own_hash"), "own")
    return rows.join(own, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("text_hash") == F.col("own_hash")), "left").drop("own_doc", "own_hash", "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d
), tri AS (
  SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda p: {'p': p, 'k': concat_ws(' ', ws[p], ws[p + 1], ws[p + 2])})) AS x FROM w WHERE len(ws) > 2
), tri2 AS (
  SELECT rid, x.p AS p, count(*) OVER (PARTITION BY rid, x.k) AS n FROM tri
), rep AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM tri2 WHERE n > 1) GROUP BY rid
), lines AS (
  SELECT rid, doc_id, host, t, unnest(ls) AS line FROM w
), norm AS (
  SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), common AS (
  SELECT host, norm, first_doc FROM (SELECT host, norm, min(doc_id) AS first_doc, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS n FROM norm WHERE norm <> '' GROUP BY host, norm)
  JOIN (SELECT host, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS docs FROM d GROUP BY host) USING (host) WHERE n > %d AND 100 * n > %d * docs
), gone AS (
  SELECT rid, sum(n) AS removed FROM norm JOIN common USING (host, norm) WHERE doc_id IS DISTINCT FROM first_doc GROUP BY rid
), dup AS (
  SELECT rid, sum(c - 1) AS n_dup_lines FROM (SELECT rid, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid) LEFT JOIN dup USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND removed_words <= %s * n_words AS kept FROM judged
""" % (MIN_DOCS, MAX_PERCENT, MAX_REMOVED)
