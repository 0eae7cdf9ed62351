"""A stored table in buckets of its key, written by copying what changes.

A version is a small list of one folder a bucket, in `_versions`; the highest number counts. A write reads the buckets that its rows
fall into, writes them anew into folders of its own, and adds a version that points to these and, for all other buckets, to the
folders that are there. The version's name appears by one rename once all its folders are whole, so a write that dies leaves the
table as it was, and of two writes that start from one version the second fails. Old folders stay until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


class StoredTable:
    """A table at a path; key: the column by which it is cut into buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _at(self, name: str) -> tuple[JavaObject, JavaObject]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        files, at = self._at("_versions")
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self) -> tuple[int, dict]:
        """The current version's number and content; 0 and no buckets before the first write."""
        numbers = self._numbers()
        if not numbers:
            return 0, {"schema": None, "folders": {}}
        text = self.spark.read.text(f"{self.path}/_versions/{numbers[-1]}.json", wholetext=True).first()[0]  # one folder name a bucket
        return numbers[-1], json.loads(text)

    def read(self) -> DataFrame:
        _, now = self.version()
        if now["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        return self._of(now, sorted(now["folders"].values()))

    def _of(self, version: dict, folders: list[str]) -> DataFrame:
        schema = self.spark.createDataFrame([], version["schema"]).schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def create(self, rows: DataFrame) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self._commit(0, {"schema": schema, "folders": {}}, self._write(rows))

    def upsert(self, new: DataFrame, order: str) -> int:
        """Rows of new in place of those of their key, the row of highest order of both (of equals the new one); gives the number
        of buckets that were written."""
        from factloom.operators.tables import upsert

        return self._rewrite(new, lambda old: upsert(old, new.select(*old.columns), [self.key], F.col(order)))

    def replace(self, new: DataFrame) -> int:
        """Everything of the keys of new goes, new comes: a document's segments indexed again."""
        from factloom.operators.tables import replace_groups

        return self._rewrite(new, lambda old: replace_groups(old, new.select(*old.columns), self.key))

    def _rewrite(self, new: DataFrame, made: Callable[[DataFrame], DataFrame]) -> int:
        number, now = self.version()
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most one row a bucket
        folders = [now["folders"][str(b)] for b in touched if str(b) in now["folders"]]
        return self._commit(number, now, self._write(made(self._of(now, folders))))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folders of the buckets written, by bucket."""
        name = f"data-{uuid.uuid4().hex}"
        out = rows.withColumn(_BUCKET, self._bucket())
        out.repartition(self.buckets, _BUCKET, F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(4))).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        files, at = self._at(name)
        return {x.getPath().getName().removeprefix(f"{_BUCKET}="): f"{name}/{x.getPath().getName()}" for x in files.listStatus(at) if x.isDirectory()}

    def _commit(self, number: int, now: dict, written: dict[str, str]) -> int:
        files, last = self._at(f"_versions/{number + 1}.json")
        _, draft = self._at(f"_versions/.draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps({"schema": now["schema"], "folders": now["folders"] | written}).encode()))
        out.close()
        if files.exists(last) or not files.rename(draft, last):
            files.delete(draft, False)
            raise RuntimeError(f"another write has made version {number + 1} of {self.path}")
        return len(written)

    def vacuum(self) -> None:
        """Remove folders and versions that the current version does not use."""
        number, now = self.version()
        used = {f.split("/")[0] for f in now["folders"].values()}
        files, at = self._at("")
        for x in files.listStatus(at):
            if x.getPath().getName().startswith("data-") and x.getPath().getName() not in used:
                files.delete(x.getPath(), True)
        for n in self._numbers():
            if n < number:
                files.delete(self._at(f"_versions/{n}.json")[1], False)
