"""A keyed store that a stream appends to: small runs, merged by size, cut into buckets that grow in number."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
BUCKET_ROWS = 1_000_000
_NAME = re.compile(r"run_(\d+)_(\d+)_(\d+)_(\d+)$")


class Run(NamedTuple):
    """A written run: how often its rows were merged, the batches it covers, its buckets, and where it lies."""

    level: int
    first: int
    last: int
    bits: int
    path: str


class KeyStore:
    """Rows by key, one per key and run, that ``fold`` makes one again.

    A batch writes only what it brought, as a run of its own. Once ``fan`` runs of a level stand next to
    each other they are merged into one of the next level, so a row is written about once for every
    level and the bytes written stay in proportion to the batches, whatever the store holds. A
    run is cut by the high bits of its keys' hash into buckets of about ``bucket_rows``: a larger run has
    more of them. There is no list of buckets or versions: a run's name says which batches it covers,
    it counts once it was written whole, and runs that a larger one covers are out of use.
    A batch that a run covers is not written again. What is out of use is deleted when the next
    batch begins, so a reader of the runs before has that long.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fold, *, fan: int = FAN, buckets: int = 1, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.keys, self.fold = spark, f"{folder}/runs", keys, fold
        self.fan, self.least_bits, self.bucket_rows = fan, max(0, math.ceil(math.log2(buckets))), bucket_rows
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def written(self) -> list[Run]:
        """Every run that was written whole, whether in use or not."""
        if not self._files.exists(self._path(self.folder)):
            return []
        found = []
        for status in self._files.listStatus(self._path(self.folder)):
            named = _NAME.search(status.getPath().getName())
            path = f"{self.folder}/{status.getPath().getName()}"
            if named and self._files.exists(self._path(f"{path}/_SUCCESS")):
                found.append(Run(*map(int, named.groups()), path))
        return sorted(found, key=lambda r: (r.first, r.last))

    def runs(self) -> list[Run]:
        """The runs in use, oldest first."""
        every = self.written()
        covers = lambda a, b: a.first <= b.first and b.last <= a.last and a.level > b.level
        return [r for r in every if not any(covers(other, r) for other in every)]

    def bucket(self, bits: int) -> Column:
        """The bucket of a key: the high bits of its hash, so twice as many buckets split each in two."""
        return F.shiftrightunsigned(F.xxhash64(*self.keys), 64 - bits).cast("int") if bits else F.lit(0)

    def _write(self, rows: DataFrame, count: int, level: int, first: int, last: int) -> None:
        bits = max(self.least_bits, math.ceil(math.log2(max(1, count / self.bucket_rows))))
        path = f"{self.folder}/run_{level}_{first}_{last}_{bits}"
        placed = rows.withColumn("bucket", self.bucket(bits))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's rows, unless a run covers it, then merge what has become ripe."""
        live = self.runs()
        self._sweep(live)
        if not any(r.first <= batch <= r.last for r in live):
            folded = self.fold(rows).persist()
            count = folded.count()
            if count:
                self._write(folded, count, 0, batch, batch)
            folded.unpersist()
        self._merge()

    def _merge(self) -> None:
        live = self.runs()
        while len(live) >= self.fan and len({r.level for r in live[-self.fan:]}) == 1:
            ripe = live[-self.fan:]
            rows = self._read(ripe)
            self._write(self.fold(rows), rows.count(), ripe[0].level + 1, ripe[0].first, ripe[-1].last)
            live = self.runs()

    def _read(self, runs: list[Run]) -> DataFrame:
        frames = [self.spark.read.parquet(r.path).drop("bucket") for r in runs]
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows

    def _sweep(self, live: list[Run]) -> None:
        for run in set(self.written()) - set(live):
            self._files.delete(self._path(run.path), True)

    def read(self) -> DataFrame | None:
        """One row per key; None while nothing was written."""
        live = self.runs()
        return self.fold(self._read(live)) if live else None

    def look_up(self, wanted: DataFrame) -> DataFrame | None:
        """The stored rows of the keys in ``wanted``; of each run only the buckets that they fall into are read."""
        known = []
        for run in self.runs():
            rows = self.spark.read.parquet(run.path)
            asked = wanted.select(*self.keys).distinct().withColumn("bucket", self.bucket(run.bits))
            known.append(rows.join(asked, [*self.keys, "bucket"], "left_semi").drop("bucket"))
        if not known:
            return None
        rows = known[0]
        for more in known[1:]:
            rows = rows.unionByName(more)
        return self.fold(rows)
