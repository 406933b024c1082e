"""Tables of keyed rows that are kept up to date by batches, a stream's or any others.

A table is a folder. Rows lie in buckets by a hash of their key; a batch writes a generation, with files in the buckets that it
touches only. A manifest (one small file a version) names the generations that make up each bucket. It is created last and never
overwritten, so a reader sees one version, and a batch that broke off before its manifest has changed nothing. Buckets of many
generations are rewritten as one; generations that no kept manifest names are deleted."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class _Files:
    """A folder by the file system of its path, wherever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._jvm, self.root = spark._jvm, path.rstrip("/")
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file under another name and give it its own; fails if there is one."""
        kept, made = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(kept) or not self._fs.rename(made, kept):
            self._fs.delete(made, False)
            raise RuntimeError(f"{name} is there already: another writer has changed {self.root}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class KeyedTable:
    """SNK-01 and STM-02: of each key (nulls are values like any other) the row with the greatest version stays; of equal
    versions that of the later batch. With `deleted`, the name of a boolean column, rows in which it is true take their key out
    until a greater version comes; they are stored, so that what comes late stays out.

    `buckets` is fixed with the first batch; a bucket of more than `generations` is rewritten; the manifests of the last `keep`
    versions can be read. With `bucket_by`, only so many of the key's first columns tell the bucket."""

    path: str
    key: tuple[str, ...]
    version: str
    deleted: str | None = None
    buckets: int = 64
    generations: int = 8
    keep: int = 2
    bucket_by: int | None = None

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> KeyedTable | None:
        """The table at path, with the key, version and mark of deletion that it was made with; None where there is none."""
        found = cls(path, (), "")._manifest(_Files(spark, path))
        return cls(path, tuple(found["key"]), found["row_version"], found["deleted"], found["buckets"]) if found["schema"] else None

    def _manifest(self, files: _Files, number: int | None = None) -> dict:
        numbers = [int(n) for n in files.names("manifests") if n.isdigit()]
        if not numbers and number is None:
            return {"number": -1, "key": self.key, "row_version": self.version, "deleted": self.deleted, "buckets": self.buckets, "schema": None, "parts": {}, "batches": {}}
        return json.loads(files.read(f"manifests/{max(numbers) if number is None else number:012d}"))

    def _commit(self, files: _Files, manifest: dict) -> None:
        files.create(f"manifests/{manifest['number']:012d}", json.dumps(manifest))

    def _newest(self, rows: DataFrame, *later: str) -> DataFrame:
        """Of each key the row with the greatest version; equal ones by `later` columns, then by a hash of the row."""
        columns = rows.columns
        tie = F.xxhash64(*(F.col(f"`{c}`").cast("string") if "map" not in t else F.lit(0) for c, t in rows.dtypes))
        best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.struct(F.col(self.version), *later, tie))
        return rows.groupBy(*(F.col(f"`{k}`").alias(f"key_{i}_") for i, k in enumerate(self.key))).agg(best.alias("best_")).select("best_.*")

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.key[: self.bucket_by])), F.lit(manifest["buckets"])).cast("int")

    def _write(self, files: _Files, manifest: dict, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows as a generation; its name, and the buckets that it has."""
        name = f"{manifest['number']:012d}-{uuid.uuid4().hex}"
        rows.withColumn("bucket_", self._bucket(manifest)).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{files.root}/data/{name}")
        return name, [n.split("=")[1] for n in files.names(f"data/{name}") if n.startswith("bucket_=")]

    def _stored(self, spark: SparkSession, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path.rstrip('/')}/data/{g}/bucket_={b}" for b in buckets for g in manifest["parts"][b]]
        schema = StructType.fromJson(manifest["schema"])
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _merged(self, spark: SparkSession, manifest: dict, buckets: list[str]) -> DataFrame:
        """The rows of buckets. A bucket of one generation has each key once and is read as it lies."""
        one, many = ([b for b in buckets if (len(manifest["parts"][b]) == 1) == alone] for alone in (True, False))
        rows = self._stored(spark, manifest, one)
        return rows.unionByName(self._newest(self._stored(spark, manifest, many), "generation_")) if many else rows

    def apply(self, batch: DataFrame, writer: str = "", number: int | None = None, unique: bool = False) -> bool:
        """Bring a batch in; False if it has been brought in before, as told by the writer's last number. With `unique`, the caller
        knows that no key comes twice in the batch, and it is not gathered by key."""
        spark = batch.sparkSession
        files = _Files(spark, self.path)
        old = self._manifest(files)
        if number is not None and old["batches"].get(writer, -1) >= number:
            return False
        new = json.loads(json.dumps(old)) | {"number": old["number"] + 1}
        rows = (batch if unique else self._newest(batch)).withColumn("generation_", F.lit(new["number"]).cast("long"))
        if new["schema"] is None:
            new["schema"] = rows.schema.jsonValue()
        stored = StructType.fromJson(new["schema"])
        name, touched = self._write(files, new, rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in stored)))
        for b in touched:
            new["parts"].setdefault(b, []).append(name)
        if number is not None:
            new["batches"][writer] = number
        self._commit(files, new)
        self.compact(spark)
        return True

    def compact(self, spark: SparkSession) -> None:
        """Rewrite the buckets of more than `generations` as one each, and delete what no kept manifest names."""
        files = _Files(spark, self.path)
        old = self._manifest(files)
        long = [b for b, g in old["parts"].items() if len(g) > self.generations]
        if long:
            new = json.loads(json.dumps(old)) | {"number": old["number"] + 1}
            name, _ = self._write(files, new, self._merged(spark, old, long))
            new["parts"] |= {b: [name] for b in long}
            self._commit(files, new)
        self.vacuum(spark)

    def vacuum(self, spark: SparkSession) -> None:
        """Delete old manifests and the files that none of the kept ones names; for the one writer, between its batches."""
        files = _Files(spark, self.path)
        numbers = sorted(int(n) for n in files.names("manifests") if n.isdigit())
        kept = [self._manifest(files, n) for n in numbers[-self.keep :]]
        for n in numbers[: -self.keep]:
            files.delete(f"manifests/{n:012d}")
        named = {(g, b) for m in kept for b, all_of in m["parts"].items() for g in all_of}
        for g in files.names("data"):
            buckets = [n.split("=")[1] for n in files.names(f"data/{g}") if n.startswith("bucket_=")]
            if not any((g, b) in named for b in buckets):
                files.delete(f"data/{g}")
            else:
                for b in buckets:
                    if (g, b) not in named:
                        files.delete(f"data/{g}/bucket_={b}")

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The rows of the newest version, or of a kept one; None where nothing has been written."""
        manifest = self._manifest(_Files(spark, self.path), version)
        if manifest["schema"] is None:
            return None
        rows = self._merged(spark, manifest, sorted(manifest["parts"]))
        if self.deleted:
            rows = rows.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
        return rows.drop("generation_")

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The newest rows whose key (or its first columns, as many as keys has) stands in keys; None where nothing has been
        written. Only the buckets of these keys are read; keys must have the columns that tell the bucket."""
        spark = keys.sparkSession
        manifest = self._manifest(_Files(spark, self.path))
        if manifest["schema"] is None:
            return None
        there = {f["name"]: f["type"] for f in manifest["schema"]["fields"]}
        asked = keys.select(*(F.col(f"`{k}`").cast(there[k]).alias(k) for k in self.key if k in keys.columns)).distinct()
        buckets = sorted(str(r[0]) for r in asked.select(self._bucket(manifest)).distinct().collect())  # numbers of buckets at most
        rows = self._merged(spark, manifest, [b for b in buckets if b in manifest["parts"]])
        named = asked.withColumnsRenamed({k: f"asked_{k}" for k in asked.columns})
        same = [rows[k].eqNullSafe(named[f"asked_{k}"]) for k in asked.columns]
        if self.deleted:
            rows = rows.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
        return rows.join(named, same, "left_semi").drop("generation_")

    def number(self, spark: SparkSession) -> int:
        """The newest version; -1 where nothing has been written."""
        return self._manifest(_Files(spark, self.path))["number"]

    def start(self, stream: DataFrame, checkpoint: str):
        """Keep the table in step with a stream of changed rows until all that is there has been read. A batch that is run
        again after a crash is told by its number and the stream's checkpoint."""
        merge = lambda batch, number: self.apply(batch, checkpoint, number)
        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
