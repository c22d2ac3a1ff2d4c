"""A table of records by id that batches are merged into, bucket by bucket.

A record's bucket is a hash of its id. A batch writes its records as one delta a
bucket that it touches, and a manifest: for every bucket its base, its deltas
and its rows. What the newest complete manifest names is the table; a batch that
fails before its manifest is written has changed nothing, and is written anew
when it is run again. A bucket that has `compact_after` deltas is rewritten as a
base; no other bucket is. Files that none of the last `keep` manifests name are
deleted.

Batches come from jobs (a name; for a stream, its checkpoint) and are numbered.
The manifest holds the last number of each job, so a batch that was merged and
is given again changes nothing. One writer at a time.

Records carry the version that brought them and its time: the time is the stamp
of a pushed row, and is there if and only if the row is. All files are written
and read by Spark; the driver sees one row a bucket.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, COMPACT_AFTER, KEEP = 16, 4, 2
MANIFEST = "bucket int, base long, deltas array<long>"
REPORT = "version long, job string, batch long, pushed long, buckets long, compacted long, synced_at timestamp_ntz"


class BucketedTable:
    """records: DDL of the records' columns; the key is one of them and not null."""

    def __init__(self, spark: SparkSession, root: str, records: str, key: str = "id", buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER, keep: int = KEEP):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = f"{records}, synced_at timestamp_ntz, version long"
        self.buckets, self.compact_after, self.keep = buckets, compact_after, max(1, keep)

    # --- folders ---------------------------------------------------------------

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, folder: str) -> None:
        fs, p = self._path(f"{self.root}/{folder}")
        fs.delete(p, True)

    def versions(self) -> list[int]:
        """Versions with a complete manifest, oldest first."""
        numbers = [int(n.split("=")[1]) for n in self._names("manifest") if n.startswith("version=")]
        return sorted(n for n in numbers if "_SUCCESS" in self._names(f"manifest/version={n}"))

    def manifest(self, version: int | None = None) -> dict[int, tuple[int | None, list[int]]]:
        """{bucket: (base, deltas)} of a version, the newest by default."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/version={version}").collect()  # one a bucket
        return {r.bucket: (r.base, list(r.deltas or [])) for r in rows}

    def files(self, version: int | None = None) -> dict[int, list[str]]:
        """The data files of each bucket in a version."""
        found = {}
        for bucket, (base, deltas) in self.manifest(version).items():
            folders = ([f"base/version={base}"] if base is not None else []) + [f"delta/version={d}" for d in deltas]
            found[bucket] = [f"{f}/bucket={bucket}/{n}" for f in folders for n in self._names(f"{f}/bucket={bucket}") if n.endswith(".parquet")]
        return found

    # --- reading ---------------------------------------------------------------

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _live(self, manifest: dict[int, tuple[int | None, list[int]]]) -> DataFrame:
        """Bases, with the newest delta of an id in place of its base row; buckets without deltas take no part in the join."""
        clean = [f"base/version={b}/bucket={n}" for n, (b, d) in manifest.items() if b is not None and not d]
        dirty = [f"base/version={b}/bucket={n}" for n, (b, d) in manifest.items() if b is not None and d]
        deltas = self._read([f"delta/version={v}/bucket={n}" for n, (_, d) in manifest.items() for v in d])
        columns = deltas.columns
        newest = deltas.groupBy(self.key).agg(F.max_by(F.struct(*columns), "version").alias("r")).select("r.*")
        parts = [newest]
        if dirty:
            parts.append(self._read(dirty).join(deltas.select(self.key), self.key, "left_anti").select(*columns))
        if clean:
            parts.append(self._read(clean))
        return reduce(DataFrame.unionByName, parts)

    def live(self, version: int | None = None) -> DataFrame:
        """The table's rows: records, synced_at, version."""
        return self._live(self.manifest(version))

    def log(self) -> DataFrame:
        """A row for each version: its job and batch, how many records, buckets touched and compacted, and when."""
        done = [f"{self.root}/log/version={v}" for v in self._committed()]
        return self.spark.read.schema(REPORT).json(done) if done else self.spark.createDataFrame([], REPORT)

    def _committed(self) -> list[int]:
        newest = max(self.versions(), default=-1)
        return [v for v in sorted(int(n.split("=")[1]) for n in self._names("log")) if v <= newest]

    # --- writing ---------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """A file a bucket under folder/bucket=n, or several where it is larger than Spark's advisory size of a partition."""
        dealt = rows.withColumn("bucket", self._bucket())
        dealt.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")

    def merge(self, records: DataFrame, job: str, batch: int, now: dt.datetime) -> dict:
        """Puts a batch's records in place of those of the same ids; gives its report.

        Of records of one id in a batch the greatest row stays. A batch that the
        job has merged before changes nothing and reports version None.
        """
        spark = self.spark
        log = self.log().where(F.col("job") == job).agg(F.max("batch")).first()[0]
        if log is not None and log >= batch:
            return {"version": None, "job": job, "batch": batch, "pushed": 0, "buckets": 0, "compacted": 0, "synced_at": now}
        version = max(self.versions(), default=-1) + 1
        names = [n for n in records.columns]
        one = records.groupBy(self.key).agg(F.max(F.struct(*names)).alias("r")).select("r.*")
        self._write(one.withColumns({"synced_at": F.lit(now).cast("timestamp_ntz"), "version": F.lit(version).cast("long")}), f"delta/version={version}")
        written = spark.read.schema("bucket int").parquet(f"{self.root}/delta/version={version}") if self._names(f"delta/version={version}") != ["_SUCCESS"] else spark.createDataFrame([], "bucket int")
        touched = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}  # at most `buckets` rows
        manifest = self.manifest()
        for bucket in touched:
            base, deltas = manifest.get(bucket, (None, []))
            manifest[bucket] = (base, [*deltas, version])
        full = {b: m for b, m in manifest.items() if len(m[1]) >= self.compact_after}
        if full:
            self._write(self._live(full), f"base/version={version}")
            manifest |= {b: (version, []) for b in full}
        report = {"version": version, "job": job, "batch": batch, "pushed": sum(touched.values()), "buckets": len(touched), "compacted": len(full), "synced_at": now}
        spark.createDataFrame([tuple(report.values())], REPORT).coalesce(1).write.mode("overwrite").json(f"{self.root}/log/version={version}")
        rows = [(b, base, deltas) for b, (base, deltas) in sorted(manifest.items())]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/version={version}")  # the batch counts from here on
        self.collect_old()
        return report

    def collect_old(self) -> None:
        """Deletes manifests beyond the last `keep` and the bucket folders that no kept one names."""
        versions = self.versions()
        kept = versions[-self.keep :]
        used = set()
        for v in kept:
            for bucket, (base, deltas) in self.manifest(v).items():
                used |= {f"base/version={base}/bucket={bucket}"} | {f"delta/version={d}/bucket={bucket}" for d in deltas}
        for kind in ("base", "delta"):
            for folder in self._names(kind):
                if int(folder.split("=")[1]) > kept[-1]:
                    continue  # a batch that is being written
                buckets = [n for n in self._names(f"{kind}/{folder}") if n.startswith("bucket=")]
                gone = [n for n in buckets if f"{kind}/{folder}/{n}" not in used]
                for name in gone:
                    self._delete(f"{kind}/{folder}/{name}")
                if len(gone) == len(buckets):
                    self._delete(f"{kind}/{folder}")
        for v in versions[: -self.keep]:
            self._delete(f"manifest/version={v}")
