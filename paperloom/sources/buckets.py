"""A table of rows by key that is updated a bucket at a time.

Rows lie in buckets by a hash of their key. A batch writes anew only the buckets
that its keys fall into, beside the old ones, and takes effect by one manifest: a
small file, renamed into place, that names the folder of each bucket. Readers go by
the last manifest and so see a batch as a whole or not at all. A batch that was
committed is left alone when it comes again; one that broke off before its manifest
leaves files that nothing names, and writes them anew.

The manifest has a line a bucket, whatever the table's size. What a batch costs is
its own rows and those of the buckets that it meets; of the old versions only the
last is kept, for readers that began before the commit.

Defined results: of rows of a batch with the same key the one of the greatest
``order`` wins (without ``order``, any one); rows without a key replace nothing and
are kept; columns that are new in a batch are null in older rows; an empty batch
commits without writing a bucket.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


@dataclass(frozen=True)
class Bucketed:
    spark: SparkSession
    path: str
    key: str = "doc_id"
    buckets: int = 256
    #: Files a bucket: more for buckets too large for one task.
    files: int = 1

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, *names: str) -> list[str]:
        fs, path = self._at(*names)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def batches(self) -> list[int]:
        """Committed batches whose manifests are still there, in order."""
        return [int(n.removesuffix(".json")) for n in self._list("manifest") if n.endswith(".json")]

    def manifest(self, batch: int | None = None) -> dict:
        """batch, schema (JSON) and parts (bucket -> batch that wrote it) of the last committed batch, or of a given one."""
        known = self.batches()
        if not known:
            return {"batch": -1, "schema": None, "parts": {}, "rewritten": []}
        fs, path = self._at("manifest", f"{known[-1] if batch is None else batch:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table as of the last commit; ``only``: some of its buckets. None before the first commit."""
        last = self.manifest()
        if last["schema"] is None:
            return None
        schema = StructType.fromJson(last["schema"])
        parts = [f"{self.path}/data/{batch:012d}/{BUCKET}={b}" for b, batch in last["parts"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, batch: int, order: str | None = None) -> list[int]:
        """Puts rows in, each in the place of the one with its key; the buckets that were written."""
        return self._put(rows, batch, order, replace=True)

    def insert_absent(self, rows: DataFrame, batch: int, order: str | None = None) -> list[int]:
        """Puts in the rows whose key the table doesn't have."""
        return self._put(rows, batch, order, replace=False)

    def _put(self, rows: DataFrame, batch: int, order: str | None, replace: bool) -> list[int]:
        last = self.manifest()
        if batch <= last["batch"]:
            return []
        # The rows are worked out once.
        incoming, data = f"{self.path}/incoming/{batch:012d}", f"{self.path}/data/{batch:012d}"
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        placed.write.mode("overwrite").parquet(incoming)
        new = self.spark.read.schema(placed.schema).parquet(incoming)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most as many as there are buckets
        schema = rows.schema
        if touched:
            keyed = new.where(F.col(self.key).isNotNull())
            one = F.max_by if order else lambda row, _: F.first(row)
            fresh = keyed.groupBy(self.key).agg(one(F.struct(*[F.col(c) for c in placed.columns if c != self.key]), order).alias("row")).select(self.key, "row.*").select(placed.columns).union(new.where(F.col(self.key).isNull()))
            old = self.read(touched)
            if old is not None:
                old = old.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
                # On the key alone, so that both sides are dealt out as the aggregate above already is.
                fresh = old.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh, allowMissingColumns=True) if replace else old.unionByName(fresh.join(old.select(self.key), self.key, "left_anti"), allowMissingColumns=True)
            spread = F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(self.files))
            fresh.repartition(len(touched) * self.files, BUCKET, spread).write.mode("overwrite").partitionBy(BUCKET).parquet(data)
            schema = fresh.drop(BUCKET).schema
        elif last["schema"] is not None:
            schema = StructType.fromJson(last["schema"])
        self._commit({"batch": batch, "schema": json.loads(schema.json()), "parts": last["parts"] | {str(b): batch for b in touched}, "rewritten": touched})
        self._clean()
        return touched

    def _commit(self, manifest: dict) -> None:
        name = f"{manifest['batch']:012d}.json"
        fs, draft = self._at("manifest", f".{name}.draft")
        _, place = self._at("manifest", name)
        stream = fs.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if fs.exists(place) or not fs.rename(draft, place):
            raise RuntimeError(f"batch {manifest['batch']} has been committed by another writer")

    def _clean(self) -> None:
        """Deletes what neither the last manifest nor the one before it names."""
        known = self.batches()
        kept = [self.manifest(b)["parts"] for b in known[-2:]]
        named = {(f"{batch:012d}", b) for parts in kept for b, batch in parts.items()}
        drop = [("manifest", f"{b:012d}.json") for b in known[:-2]] + [("incoming", n) for n in self._list("incoming")]
        for version in self._list("data"):
            own = [n for n in self._list("data", version) if n.startswith(BUCKET)]
            gone = [n for n in own if (version, n.split("=")[1]) not in named]
            drop += [("data", version)] if len(gone) == len(own) else [("data", version, n) for n in gone]
        for names in drop:
            fs, path = self._at(*names)
            fs.delete(path, True)
