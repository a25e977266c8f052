"""Tables as versioned folders of Parquet with the bounds of their keys, and commits that change several tables at once.

The newest manifest names the folders of all tables, each with its number of rows and, where the table has a key, its least and
greatest key. A commit writes new folders and then one manifest, which appears by a rename, so a reader sees all of a commit or
nothing. Readers and writers that look at a range of keys open only the folders whose bounds meet it. Folders that no manifest
names any more are left for a retention rule. One writer at a time.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS = {"blocks": "number", "transfers": "block_number", "waiting": "number", "ordered": "number"}


@dataclass(frozen=True)
class Folder:
    name: str
    path: str
    rows: int
    low: int | None = None
    high: int | None = None

    def meets(self, low: int | None, high: int | None) -> bool:
        if self.low is None:
            return True
        return (low is None or self.high >= low) and (high is None or self.low <= high)


@dataclass
class Manifest:
    seq: int = -1
    runs: dict[str, int] = field(default_factory=dict)  #: each run's last batch
    folders: list[Folder] = field(default_factory=list)


class Store:
    """A commit of a batch that its run has already committed changes nothing, so retried batches are safe; a run is one stream with its checkpoint, so a stream that starts anew, counting from 0, loses nothing."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), KEYS if keys is None else keys

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> Manifest:
        """The newest manifest; an empty one before the first commit."""
        fs, p = self._file(f"{self.path}/_manifests")
        if not fs.exists(p):
            return Manifest()
        names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))
        if not names:
            return Manifest()
        fs, p = self._file(f"{self.path}/_manifests/{names[-1]}")
        stream = fs.open(p)
        try:
            m = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(m["seq"], m["runs"], [Folder(**f) for f in m["folders"]])

    def _publish(self, m: Manifest) -> None:
        text = json.dumps({"seq": m.seq, "runs": m.runs, "folders": [vars(f) for f in m.folders]})
        fs, part = self._file(f"{self.path}/_manifests/{m.seq:012d}.part")
        _, whole = self._file(f"{self.path}/_manifests/{m.seq:012d}.json")
        out = fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(whole) or not fs.rename(part, whole):
            raise RuntimeError(f"another writer has made commit {m.seq} of {self.path}")

    def drop(self, path: str) -> None:
        """Remove a folder below the store that no manifest names."""
        fs, p = self._file(path)
        fs.delete(p, True)

    def committed(self, run: str = "") -> int:
        """The run's last batch; -1 before its first."""
        return self.manifest().runs.get(run, -1)

    def folders(self, name: str, low: int | None = None, high: int | None = None) -> list[Folder]:
        """The folders of a table whose bounds meet a range of keys."""
        return [f for f in self.manifest().folders if f.name == name and f.meets(low, high)]

    def read(self, name: str, schema, low: int | None = None, high: int | None = None) -> DataFrame:
        """A table, or its rows with keys in a range."""
        paths = [f.path for f in self.folders(name, low, high)]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        for bound, ok in ((low, lambda k: k >= low), (high, lambda k: k <= high)):
            rows = rows if bound is None else rows.where(ok(F.col(self.keys[name])))
        return rows

    def _write(self, name: str, df: DataFrame, path: str) -> list[Folder]:
        """df as a folder of the table; none if it has no rows."""
        key = self.keys.get(name)
        at = F.lit(None).cast("long") if key is None else F.col(key)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).write.mode("overwrite").parquet(path)
        got = seen.get
        return [Folder(name, path, got["n"], got["low"], got["high"])] if got["n"] else []

    def commit(self, batch_id: int, appended: dict[str, DataFrame], replaced: dict[str, DataFrame], run: str = "", *, above: dict[str, int] | None = None, below: dict[str, int] | None = None) -> bool:
        """Append rows, replace tables, and drop rows by key, all at once; False if the run has committed the batch before.

        above: tables whose rows with greater keys go: folders beyond are dropped unread, and only those that hold both kinds are
        written anew. below: tables whose folders with lesser keys only may go.
        """
        m, above, below = self.manifest(), above or {}, below or {}
        if batch_id <= m.runs.get(run, -1):
            return False
        seq, kept = m.seq + 1, []
        for i, f in enumerate(m.folders):
            if f.name in replaced or (f.name in below and f.low is not None and f.high < below[f.name]):
                continue
            top = above.get(f.name)
            if top is None or f.low is None or f.high <= top:
                kept.append(f)
            elif f.low <= top:
                kept += self._write(f.name, self.spark.read.parquet(f.path).where(F.col(self.keys[f.name]) <= top), f"{self.path}/{f.name}/{seq:012d}-cut-{i}")
        tables = [(name, df, f"{self.path}/{name}/{seq:012d}-{kind}") for kind, group in (("appended", appended), ("replaced", replaced)) for name, df in group.items()]
        with ThreadPoolExecutor(max(1, len(tables))) as pool:  # tables are written side by side: most are small
            for written in pool.map(lambda x: self._write(*x), tables):
                kept += written
        self._publish(Manifest(seq, m.runs | {run: batch_id}, kept))
        return True

    def compact(self, name: str, rows: int = 1_000_000, most: int = 64) -> int:
        """Where a table has more than `most` folders of fewer rows, join those that are neighbours by their bounds up to that many rows; how many folders went. Readers of older manifests still find their folders."""
        m = self.manifest()
        small = sorted((f for f in m.folders if f.name == name and f.rows < rows), key=lambda f: (f.low is not None, f.low, f.path))
        if len(small) <= most:
            return 0
        groups: list[list[Folder]] = [[]]
        for f in small:
            if sum(x.rows for x in groups[-1]) + f.rows > rows:
                groups.append([])
            groups[-1].append(f)
        gone, new, seq = set(), [], m.seq + 1
        for i, g in enumerate(x for x in groups if len(x) > 1):
            new += self._write(name, self.spark.read.parquet(*[f.path for f in g]), f"{self.path}/{name}/{seq:012d}-compact-{i}")
            gone |= {f.path for f in g}
        self._publish(replace(m, seq=seq, folders=[f for f in m.folders if f.path not in gone] + new))
        return len(gone) - len(new)
