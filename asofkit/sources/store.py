"""Tables that are replaced together, by key group: hashed buckets of Parquet files, and a manifest that switches them all at once."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "stream string, batch long, relation string, bucket int, version long"


@dataclass(frozen=True)
class Store:
    """A folder of tables: each maps to the columns of its key group, by whose hash its rows lie in buckets.

    A commit writes the buckets that it touches as a new version beside the old ones, and then one manifest, which says for
    each table and bucket which version counts. Readers follow the newest manifest, so they see all tables of a commit or none
    of them, whatever fails before. A batch has the name of its stream and a number; one whose number the stream has reached is not
    applied again. One writer at a time: of two that commit the same version, the second fails. The path is one that all share.
    """

    spark: SparkSession
    path: str
    tables: Mapping[str, Sequence[str]]
    buckets: int = 64

    def _fs(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def _names(self, path: str) -> list[str]:
        fs, own = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(own)] if fs.exists(own) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(f"{self.path}/manifests") if n.startswith("m"))

    def _state(self) -> tuple[int, dict[tuple[str, int], int], dict[str, int]]:
        """The newest commit's number, the version of each bucket, and the last batch of each stream."""
        last = self._manifests()[-1:]
        if not last:
            return 0, {}, {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/m{last[0]}").collect()  # tables x buckets rows, and one for each stream
        return last[0], {(r["relation"], r["bucket"]): r["version"] for r in rows if r["relation"]}, {r["stream"]: r["batch"] for r in rows if r["stream"]}

    def _folder(self, relation: str, version: int, bucket: int) -> str:
        return f"{self.path}/data/{relation}/v={version}/__bucket={bucket}"

    def files(self, relation: str) -> dict[int, str]:
        """The folder of each bucket of a table that has rows."""
        _, versions, _ = self._state()
        return {b: self._folder(r, v, b) for (r, b), v in sorted(versions.items()) if r == relation}

    def read(self, relation: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """A table as of the newest commit, or only some of its buckets; None where it has no rows there."""
        folders = [f for b, f in self.files(relation).items() if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def bucket_of(self, relation: str):
        return F.pmod(F.xxhash64(*(F.col(c) for c in self.tables[relation])), F.lit(self.buckets)).cast("int")

    def rows_of(self, relation: str, keys: DataFrame) -> DataFrame | None:
        """The stored rows of some key groups; only their buckets are read."""
        touched = [r[0] for r in keys.select(self.bucket_of(relation)).distinct().collect()]  # as many as there are buckets at most
        old = self.read(relation, touched)
        return None if old is None else old.join(keys.select(*self.tables[relation]).distinct(), list(self.tables[relation]), "left_semi")

    def replace(self, batch: tuple[str, int] | None, frames: Mapping[str, DataFrame], gone: Mapping[str, DataFrame] | None = None, within: Mapping[str, DataFrame] | None = None) -> bool:
        """Replaces the key groups that each frame holds by the frame's rows, in all tables at once; False if the batch was in before.

        gone: for each table further key groups whose rows go. Columns that only one side has are null on the other. Keys are not
        null. A frame is read twice, so it must give the same rows each time (a stored table does). within: for each table rows
        with all key groups that its frame can hold; these are replaced, and the frame is read once, for its rows alone.
        """
        number, versions, batches = self._state()
        if batch and batch[1] <= batches.get(batch[0], -1):
            return False
        number += 1
        for relation in {*frames, *(gone or {})}:
            self._write(relation, number, versions, frames.get(relation), (gone or {}).get(relation), (within or {}).get(relation))
        self._commit(number, versions, batches | ({batch[0]: batch[1]} if batch else {}))
        return True

    def _write(self, relation: str, number: int, versions: dict, new: DataFrame | None, gone: DataFrame | None, within: DataFrame | None = None) -> None:
        """The touched buckets of a table as a new version; `versions` is changed to what will count."""
        key = list(self.tables[relation])
        groups = reduce(DataFrame.unionByName, [df.select(*key) for df in (new if within is None else within, gone) if df is not None]).distinct()
        touched = {r[0] for r in groups.select(self.bucket_of(relation)).distinct().collect()}  # as many as there are buckets at most
        held = [self._folder(relation, versions[relation, b], b) for b in touched if (relation, b) in versions]
        old = self.spark.read.option("mergeSchema", "true").parquet(*held).join(groups, key, "left_anti") if held else None
        out = new if old is None else old if new is None else old.unionByName(new, allowMissingColumns=True)
        if out is not None:
            # a bucket is a task where it is small; adaptive execution splits it where a key group fills it
            out = out.withColumn("__bucket", self.bucket_of(relation)).hint("rebalance", "__bucket")
            # what a failed commit of this number has left goes
            out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("__bucket").parquet(f"{self.path}/data/{relation}/v={number}")
        written = self._names(f"{self.path}/data/{relation}/v={number}") if out is not None else []
        full = {int(n.partition("=")[2]) for n in written if n.startswith("__bucket=")}
        for b in touched:
            versions.pop((relation, b), None)
            if b in full:
                versions[relation, b] = number

    def _commit(self, number: int, versions: dict, batches: dict[str, int]) -> None:
        rows = [(None, None, r, b, v) for (r, b), v in versions.items()] + [(s, n, None, None, None) for s, n in batches.items()]
        draft = f"{self.path}/drafts/m{number}"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(draft)
        fs, target = self._fs(f"{self.path}/manifests/m{number}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(self._fs(draft)[1], target):
            raise RuntimeError(f"commit {number} of {self.path} was made by another writer")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the manifests before the last `keep`, and versions that none of those kept refers to."""
        kept = self._manifests()[-keep:]
        used = set()
        for n in kept:
            used |= {(r["relation"], r["version"], r["bucket"]) for r in self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/m{n}").where("relation IS NOT NULL").collect()}
        drop = [f"{self.path}/manifests/m{n}" for n in self._manifests() if n not in kept]
        for relation in self._names(f"{self.path}/data"):
            for version in self._names(f"{self.path}/data/{relation}"):
                n = int(version.partition("=")[2])
                own = [b for b in self._names(f"{self.path}/data/{relation}/{version}") if b.startswith("__bucket=")]
                drop += [f"{self.path}/data/{relation}/{version}/{b}" for b in own if n <= kept[-1] and (relation, n, int(b.partition("=")[2])) not in used] if kept else []
        for path in drop:
            fs, own = self._fs(path)
            fs.delete(own, True)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as files beside the store, so that what reads them twice reads the same; dropped() deletes them."""
        folder = f"{self.path}/staged/{name}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def dropped(self, name: str) -> None:
        fs, own = self._fs(f"{self.path}/staged/{name}")
        fs.delete(own, True)


def windows(first: date, last: date, months: int) -> list[tuple[date, date]]:
    """Closed windows of so many months from `first` on; the last one ends on `last`."""
    out, start, k = [], first, 0
    while start <= last:
        k += months
        year, month = divmod(first.month - 1 + k, 12)
        length = monthrange(first.year + year, month + 1)[1]
        following = date(first.year + year, month + 1, min(first.day, length))
        out.append((start, min(following - timedelta(days=1), last)))
        start = following
    return out


LEDGER = "job string, window_start date, window_end date, status string, rows long, attempts int, note string"


def backfill(store: Store, job: str, first: date, last: date, months: int, load: Callable[[date, date], Mapping[str, DataFrame]], ledger: str = "ledger") -> DataFrame:
    """Loads window by window and returns the job's ledger: LEDGER rows, one for each window.

    A window is entered as running, then its frames and its row as completed are one commit; where `load` or a write fails, none
    of its frames is in, the row says failed with the reason, and the next window follows. Windows that the ledger has as completed
    are skipped, so a second call runs only what failed, was interrupted or is new. Key groups are replaced, so frames
    should have keys of one window only. The ledger is a table of the store, by (job, window_start).
    """
    spark = store.spark
    known = store.read(ledger)
    known = {r["window_start"]: r for r in known.where(F.col("job") == job).collect()} if known is not None else {}  # a row for each window of one job

    def entry(start: date, end: date, status: str, rows: int | None, attempts: int, note: str | None = None) -> DataFrame:
        return spark.createDataFrame([(job, start, end, status, rows, attempts, note)], LEDGER)

    for start, end in windows(first, last, months):
        before = known.get(start)
        if before and before["status"] == "completed" and before["window_end"] == end:
            continue
        attempts = (before["attempts"] if before else 0) + 1
        store.replace(None, {ledger: entry(start, end, "running", None, attempts)})
        names = []
        try:
            frames = {}
            for relation, df in load(start, end).items():
                names.append(f"{job}-{start}-{relation}")
                frames[relation] = store.staged(df, names[-1])
            n = sum(df.count() for df in frames.values())
            store.replace(None, {**frames, ledger: entry(start, end, "completed", n, attempts)})
        except Exception as e:
            store.replace(None, {ledger: entry(start, end, "failed", None, attempts, f"{type(e).__name__}: {e}"[:500])})
        for name in names:
            store.dropped(name)
    out = store.read(ledger)
    return spark.createDataFrame([], LEDGER) if out is None else out.where(F.col("job") == job)
