"""Tables kept as versions in a shared folder: atomic commits, upserts by key, clean-up.

A version is a small manifest that says which folder holds each bucket of keys. A write puts
new Parquet folders beside the old ones and then makes the next manifest appear under its
number in one rename, which fails if another writer was first. So a crash in between leaves
the version before it as it was, and readers of any version are never disturbed. An upsert
rewrites the buckets that its keys fall into, and only those; all others are taken over.

The driver handles manifests alone, a line a bucket; rows stay in Spark.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer has committed the version that this one was going to be."""


@dataclass(frozen=True)
class Manifest:
    """What a version holds. ``folders``: by bucket, the folder of its rows, if it has any."""

    version: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    note: str = ""


class Snapshots:
    """A table of versions at ``path``; rows are told apart by ``keys``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(conf)
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._if_absent = spark.sparkContext._gateway.new_array(rename, 1)
        self._if_absent[0] = rename.NONE

    # --- manifests

    def versions(self) -> list[int]:
        """Numbers of the versions there are, in order."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """That of a version, or of the latest; None where there is none."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        stream = self._fs.open(self._path("versions", f"{version:012d}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> Manifest:
        draft = self._path("versions", f"draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        try:
            self._context.rename(draft, self._path("versions", f"{manifest.version:012d}.json"), self._if_absent)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise ConflictError(f"version {manifest.version} of {self.path} is there already") from error
            raise
        return manifest

    # --- reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or of the latest; None where there is none."""
        manifest = self.manifest(version)
        return None if manifest is None else self._rows(manifest, manifest.folders)

    def _rows(self, manifest: Manifest, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        folders = sorted(manifest.folders[b] for b in buckets if b in manifest.folders)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def changes(self, old: int, new: int) -> DataFrame:
        """Rows that differ between two versions, with ``change``: added, removed or modified (as it is now).

        Buckets that both versions share aren't read.
        """
        a, b = self.manifest(old), self.manifest(new)
        moved = [x for x in {*a.folders, *b.folders} if a.folders.get(x) != b.folders.get(x)]
        before, after = self._rows(a, moved), self._rows(b, moved)
        same = [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in b.keys]
        both = before.select(F.struct(*before.columns).alias("_old")).join(after.select(F.struct(*after.columns).alias("_new")), same, "full_outer")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
        shown = F.coalesce("_new", "_old")
        return both.withColumn("change", change).where("change is not null").select(*(shown[c].alias(c) for c in after.columns), "change")

    # --- writing

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")

    def _written(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Writes rows into a new folder by bucket; the folder of each bucket that has rows."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, self._bucket(keys, buckets)).repartition(_BUCKET, F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(8))).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(name))]
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith(f"{_BUCKET}=")}

    def replace(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS, note: str = "") -> Manifest:
        """The next version holds ``rows`` and nothing else. Keys must be unique in them."""
        known = self.manifest()
        made = self._written(rows, keys, buckets)
        return self._commit(Manifest(known.version + 1 if known else 1, keys, buckets, rows.schema.json(), made, note))

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None, note: str = "", always: bool = False) -> Manifest:
        """The next version has ``rows`` instead of those with their keys, and none with the keys
        of ``deleted``. Both are read more than once. Without any there is no new version,
        unless ``always``."""
        known = self.manifest()
        if known is None:
            raise ValueError(f"no table at {self.path}")
        keys = known.keys
        gone = rows.select(*keys) if deleted is None else rows.select(*keys).unionByName(deleted.select(*keys))
        touched = [r[0] for r in gone.select(self._bucket(keys, known.buckets).alias("b")).distinct().collect()]  # as many as buckets at most
        if not touched:
            return self._commit(replace(known, version=known.version + 1, note=note)) if always else known
        match = [F.col(f"_own.{k}").eqNullSafe(F.col(f"_gone.{k}")) for k in keys]
        stays = self._rows(known, touched).alias("_own").join(gone.distinct().alias("_gone"), match, "left_anti")
        made = self._written(stays.unionByName(rows.select(*stays.columns)), keys, known.buckets)
        folders = {b: f for b, f in known.folders.items() if b not in touched} | made
        return self._commit(Manifest(known.version + 1, keys, known.buckets, known.schema, folders, note))

    def remove_orphans(self, parents: DataFrame, on: list[str], note: str = "orphans") -> Manifest:
        """The next version lacks the rows whose ``on`` columns ``parents`` doesn't have."""
        return self.upsert(self._none(), self.read().join(parents.select(*on).distinct(), on, "left_anti"), note)

    def compact(self, files: int = 1) -> Manifest:
        """The next version has the same rows in at most ``files`` files a bucket."""
        known = self.manifest()
        rows = self._rows(known, known.folders).withColumn(_BUCKET, self._bucket(known.keys, known.buckets))
        name = f"data/{uuid.uuid4().hex}"
        rows.repartition(_BUCKET, F.pmod(F.xxhash64(*known.keys, F.lit(1)), F.lit(files))).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        made = {s.getPath().getName().partition("=")[2]: f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(name)) if s.getPath().getName().startswith(f"{_BUCKET}=")}
        return self._commit(Manifest(known.version + 1, known.keys, known.buckets, known.schema, made, "compaction"))

    def _none(self) -> DataFrame:
        return self.read().limit(0)

    def vacuum(self, keep: int = 10, unfinished_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Drops all but the latest ``keep`` versions and the folders that no version left names.

        Folders younger than ``unfinished_ms`` stay, for a writer may be about to commit them.
        Returns what was dropped.
        """
        known, dropped = self.versions(), []
        for version in known[:-keep]:
            self._fs.delete(self._path("versions", f"{version:012d}.json"), False)
            dropped.append(f"versions/{version:012d}.json")
        used = {f.rpartition("/")[0] for v in known[-keep:] for f in self.manifest(v).folders.values()}
        if self._fs.exists(self._path("data")):
            now = self.spark._jvm.java.lang.System.currentTimeMillis()
            for status in self._fs.listStatus(self._path("data")):
                name = f"data/{status.getPath().getName()}"
                if name not in used and now - status.getModificationTime() >= unfinished_ms:
                    self._fs.delete(status.getPath(), True)
                    dropped.append(name)
        return dropped
