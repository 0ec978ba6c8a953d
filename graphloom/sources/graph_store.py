"""A stored graph: nodes and edges in hash buckets, of which a load rewrites only those that it changes.

A table's rows are dealt over a fixed number of buckets by the hash of their key. A load writes the buckets with
changed keys as a new version beside the old one and then, as its last step, a manifest that says for every
bucket in which version it is. Readers follow the newest manifest: until it is there they see the table as it was, and a
load that fails leaves nothing that anyone reads. A load that changes nothing writes nothing.

``folder/data/v=3/bucket=7/...`` holds rows, ``folder/manifest/v=3/...`` one small file. One writer at a time is
assumed. Rows without a key are left out; of rows that repeat a key in one load the last in order of all columns counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import row_hash
from graphloom.operators import ingest
from graphloom.operators.lineage import cut_lineage

BUCKETS = 64
_MANIFEST = "bucket int, at int, v int"
_NONE = -1


class Stored:
    """One table of a stored graph, nodes or edges, by its key columns."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.schema, self.buckets = spark, folder.rstrip("/"), list(keys), schema, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest finished version; 0 before the first load."""
        if not self._files().exists(self._path("manifest")):
            return 0
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").agg(F.max("v")).first()[0] or 0

    def manifest(self) -> dict[int, int]:
        """For each bucket that has rows, the version it is in: as many numbers as there are buckets."""
        v = self.version()
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").where(F.col("v") == v).collect() if v else []
        return {r.bucket: r["at"] for r in rows if r.bucket != _NONE}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as it is, or some of its buckets."""
        at = self.manifest()
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, changed: DataFrame, touched: Sequence[int]) -> int:
        """Write the touched buckets as a new version, and then its manifest."""
        before, v = self.manifest(), self.version() + 1
        target = f"{self.folder}/data/v={v}"
        # what a load that failed has left there goes
        changed.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        kind = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        filled = {r.bucket for r in self.spark.read.schema(kind).parquet(target).select("bucket").distinct().collect()}
        after = {b: at for b, at in before.items() if b not in touched} | dict.fromkeys(filled, v)
        # a table may have become empty: one row more says that this version is there
        rows = self.spark.createDataFrame(sorted({**after, _NONE: v}.items()), "bucket int, at int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={v}")
        return v

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def _once(self, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in self.keys]
        known = new.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        return known.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("r")).select(*self.keys, "r.*") if rest else known.distinct()

    def vacuum(self) -> int:
        """Remove the buckets that the newest version doesn't hold any more; the number of them. No reader may use an older one."""
        files, at, gone = self._files(), self.manifest(), 0
        if not files.exists(self._path("data")):
            return 0
        for version in files.listStatus(self._path("data")):
            v = int(version.getPath().getName().split("=")[1])
            for bucket in files.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and at.get(int(name.split("=")[1])) != v:
                    files.delete(bucket.getPath(), True)
                    gone += 1
        return gone


class Nodes(Stored):
    """Nodes with values, ``created_at`` and ``updated_at``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.columns = [f.name for f in schema if f.name != key]
        times = T.StructType([T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at")])
        super().__init__(spark, folder, [key], T.StructType(schema.fields + times.fields), buckets)

    def load(self, new: DataFrame, now: Column) -> dict[str, int]:
        """Lay new rows over the stored ones: how many were created, updated and unchanged, how many buckets written, and the version."""
        key = self.keys[0]
        rows = cut_lineage(self._once(new.select(key, *self.columns)))
        old = self.rows(self._touched(rows))
        done = cut_lineage(ingest.actions(old, rows, key, self.columns))
        counts = {r["action"]: r["count"] for r in done.groupBy("action").count().collect()}
        touched = self._touched(done.where("action <> 'unchanged'"))
        v = self.version()
        if touched:
            own = rows.where(self._bucket().isin(touched))
            v = self._write(ingest.upsert(self.rows(touched), own, key, self.columns, now).select(*self.schema.names), touched)
        return {a: counts.get(a, 0) for a in ("created", "updated", "unchanged")} | {"buckets": len(touched), "version": v}

    def remove(self, ids: DataFrame) -> dict[str, int]:
        """Remove the nodes with the given keys: how many went, the buckets written and the version."""
        key = self.keys[0]
        gone = cut_lineage(ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct())
        hit = cut_lineage(self.rows(self._touched(gone)).join(gone, key, "left_semi").select(key))
        touched = self._touched(hit)
        v = self._write(self.rows(touched).join(hit, key, "left_anti"), touched) if touched else self.version()
        return {"removed": hit.count(), "buckets": len(touched), "version": v}


class Edges(Stored):
    """Edges by their two ends; an edge's properties are those of the load that made it."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str] = ("src", "dst"), buckets: int = BUCKETS):
        super().__init__(spark, folder, keys, schema, buckets)

    def load(self, new: DataFrame) -> dict[str, int]:
        """Add the edges whose ends aren't linked yet: how many were created, the buckets written and the version."""
        rows = cut_lineage(self._once(new.select(*self.schema.names)))
        old = self.rows(self._touched(rows)).select(*self.keys)
        added = cut_lineage(rows.join(old, self.keys, "left_anti"))
        touched = self._touched(added)
        v = self._write(ingest.merge_edges(self.rows(touched), added, self.keys).select(*self.schema.names), touched) if touched else self.version()
        return {"created": added.count(), "buckets": len(touched), "version": v}


def row_digest(store: Stored) -> int:
    """A number that changes when any row does: for comparing versions."""
    return store.rows().agg(F.coalesce(F.sum(F.xxhash64(row_hash(*store.schema.names)).cast("decimal(38,0)")), F.lit(0))).first()[0]
