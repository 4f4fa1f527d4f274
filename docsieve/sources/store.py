"""User tables with whole versions: Parquet folders by user bucket, and a small list of folders for each version.

An append or a delete writes new folders first and then commits one list, by a rename that fails if another writer has made that
version; a writer that dies before leaves the last version as it was. A delete rewrites only the buckets of the users
it names. Rows never pass the driver; what does is bounded by the number of buckets and commits.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Folders of a bucket from which a compaction makes one.
MANY = 16


class Conflict(Exception):
    """Another writer has committed this version."""


class UserTable:
    """A table of rows with a ``user`` column, in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, *, user: str = "user_id"):
        self.spark, self.path, self.user = spark, path.rstrip("/"), user
        jvm = spark._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.files = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self.Path(f"{self.path}/versions")
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(folder) if f.getPath().getName().isdigit()) if self.files.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        """``version, schema, folders by bucket, commits`` of a version, the last one unless it is named."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "folders": {}, "commits": []}
        n = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/versions/{n:010d}", wholetext=True).first()[0]
        return {"version": n, **json.loads(text)}

    def commit(self, before: dict, schema: StructType, folders: dict[str, list[str]], key: str) -> None:
        n = before["version"] + 1
        body = json.dumps({"schema": schema.jsonValue(), "folders": folders, "commits": [*before["commits"], key]})
        own, final = self.Path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self.Path(f"{self.path}/versions/{n:010d}")
        out = self.files.create(own, False)
        out.write(bytearray(body.encode()))
        out.close()
        jvm = self.spark._jvm
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(own, final, kinds)
        except Exception as e:
            self.files.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {n} of {self.path} is there already") from None
            raise

    def bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("user_bucket", F.pmod(F.xxhash64(F.col(self.user).cast("string")), F.lit(BUCKETS)).cast("int"))

    def written(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows with their bucket to a new folder; gives its subfolders by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("user_bucket").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self.files.listStatus(self.Path(f"{self.path}/{folder}"))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("user_bucket=")}

    def rows_of(self, schema: StructType | None, folders: list[str]) -> DataFrame:
        if schema is None:
            raise ValueError(f"{self.path} has no version yet")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one version, whatever is written meanwhile."""
        found = self.manifest(version)
        return self.rows_of(found["schema"] and StructType.fromJson(found["schema"]), [f for fs in found["folders"].values() for f in fs])

    def append(self, rows: DataFrame, *, key: str | None = None) -> DataFrame:
        """Adds rows and returns them as they were written. A commit key that is there already adds and returns nothing."""
        key, before = key or uuid.uuid4().hex, self.manifest()
        if key in before["commits"]:
            return self.spark.createDataFrame([], rows.schema)
        new = self.written(self.bucket(rows))
        while True:
            folders = {b: [*before["folders"].get(b, []), *([new[b]] if b in new else [])] for b in {**before["folders"], **new}}
            try:
                self.commit(before, rows.schema, folders, key)
            except Conflict:
                before = self.manifest()  # an append goes with whatever else was added
                if key in before["commits"]:
                    return self.spark.createDataFrame([], rows.schema)
                continue
            return self.rows_of(rows.schema, list(new.values()))

    def delete(self, keys: DataFrame, *, key: str | None = None) -> int:
        """Deletes the rows that agree with a row of ``keys`` (the user, and further columns if it has them); gives their number."""
        return self._rewritten(lambda rows: rows.join(keys.distinct(), keys.columns, "left_anti"), keys, key)

    def compact(self) -> None:
        """Makes one folder of each bucket that has many."""
        before = self.manifest()
        many = [b for b, fs in before["folders"].items() if len(fs) >= MANY]
        if many:
            self._replace(before, many, lambda rows: rows, uuid.uuid4().hex)

    def _rewritten(self, change, keys: DataFrame, key: str | None) -> int:
        key = key or uuid.uuid4().hex
        while True:
            before = self.manifest()
            if key in before["commits"]:
                return 0
            touched = [str(r[0]) for r in self.bucket(keys).select("user_bucket").distinct().collect() if str(r[0]) in before["folders"]]  # at most BUCKETS
            if not touched:
                return 0
            try:
                return self._replace(before, touched, change, key)
            except Conflict:
                continue

    def _replace(self, before: dict, buckets: list[str], change, key: str) -> int:
        schema = StructType.fromJson(before["schema"])
        old = self.rows_of(schema, [f for b in buckets for f in before["folders"][b]])
        new = self.written(self.bucket(change(old).select(*schema.names)))
        folders = {b: fs for b, fs in before["folders"].items() if b not in buckets} | {b: [f] for b, f in new.items()}
        self.commit(before, schema, folders, key)
        return old.count() - self.rows_of(schema, list(new.values())).count()
