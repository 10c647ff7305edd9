"""A record of items that is saved again and again: buckets of items by id, and a log of commits.

Commit n is a file named by its number that is created whole and only where none is, so of two writers of one number one
fails and looks again. A commit names the folder of each bucket; a save writes new folders for the buckets that it touches
and never changes old ones. Readers take the commit of the greatest number, and whatever no commit names isn't part of the record.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


class Conflict(Exception):
    """Another writer made the commit first."""


class Record:
    """The record in a folder. ``key`` names the column of ids; null ids lie in bucket 0."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "item_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        at = self._path(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, number: int | None = None) -> dict | None:
        """A commit, by default the last; None where the record is new."""
        known = self._commits()
        if not known:
            return None
        number = known[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.folder}/commits/{number:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def put(self, content: dict) -> None:
        """Make a commit whole and at once, or raise Conflict where its number is taken."""
        jvm = self.spark._jvm
        name = self._path(f"{self.folder}/commits/{content['number']:020d}.json")
        temporary = self._path(f"{self.folder}/commits/_{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                # a rename would replace; a hard link is made only where nothing is
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(name), local(temporary))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(temporary, name, options)
        except Exception as e:
            if self._fs.exists(name):
                raise Conflict(f"commit {content['number']} is there") from e
            raise
        finally:
            self._fs.delete(temporary, False)

    def _bucket(self, buckets: int) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)), F.lit(0)).cast("int")

    def _write(self, items: DataFrame, buckets: int) -> dict[str, str]:
        """Folders of the buckets that items fall in, written by rows of a bucket together."""
        name = f"items/{uuid.uuid4().hex}"
        items.withColumn("_bucket", self._bucket(buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").json(f"{self.folder}/{name}")
        there = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{name}")))
        return {n.partition("=")[2]: f"{name}/{n}" for n in there if n.startswith("_bucket=")}

    def _read(self, commit: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(commit["schema"])
        paths = sorted({f"{self.folder}/{commit['buckets'][b]}" for b in buckets if b in commit["buckets"]})
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All items of a commit, by default the last."""
        commit = self.commit(number)
        if commit is None:
            raise FileNotFoundError(f"no record in {self.folder}")
        return self._read(commit, list(commit["buckets"]))

    def header(self) -> DataFrame:
        """One row: number, version, created_at, updated_at."""
        c = self.commit() or {}
        return self.spark.createDataFrame([(c.get("number"), c.get("version"), c.get("created_at"), c.get("updated_at"))], "number long, version string, created_at string, updated_at string")

    def _save(self, change: Callable[[dict | None], tuple[dict[str, str], list[str] | None, T.StructType]], version: str, created_at: str, updated_at: str, tries: int) -> int:
        """Commit a change of buckets. ``change`` gives the folders that it wrote, the buckets that it replaces (None: all) and
        the schema. Where another commit came first, buckets it left alone are taken over, and otherwise the change is
        made again."""
        made: tuple | None = None
        based: dict | None = None
        for _ in range(tries):
            last = self.commit()
            if made is None or (made[1] is not None and not self._untouched(based, last, made[1], made[2])):
                made, based = change(last), last
            folders, touched, schema = made
            held = {} if last is None or touched is None else {b: f for b, f in last["buckets"].items() if b not in touched}
            number = 1 if last is None else last["number"] + 1
            begun, of = (created_at, BUCKETS) if last is None else (last["created_at"], last["of"])
            content = {"number": number, "version": version, "created_at": begun, "updated_at": updated_at, "schema": json.loads(schema.json()), "buckets": held | folders, "of": of}
            try:
                self.put(content)
            except Conflict:
                continue
            return number
        raise Conflict(f"{tries} commits of others came first")

    @staticmethod
    def _untouched(based: dict | None, last: dict | None, touched: list[str], schema: T.StructType) -> bool:
        if based is None or last is None:
            return based is last
        same = all(based["buckets"].get(b) == last["buckets"].get(b) for b in touched)
        return same and based["schema"] == last["schema"] and based["of"] == last["of"]

    def replace(self, items: DataFrame, version: str, created_at: str, updated_at: str, tries: int = 10, after: int | None = None) -> int:
        """All items anew, which may come from the record itself; created_at stays from the first save. The commit's number.

        Of two writers the later wins. With ``after``, the number of the commit that items were made from, it fails instead.
        """

        def change(last: dict | None):
            if after is not None and (last is None or last["number"] != after):
                raise Conflict(f"the last commit isn't {after}")
            return self._write(items, BUCKETS if last is None else last["of"]), None, items.schema

        return self._save(change, version, created_at, updated_at, tries)

    def upsert(self, items: DataFrame, version: str, created_at: str, updated_at: str, tries: int = 10) -> int:
        """Items in place of those of their ids, others left as they are; only the buckets of items are read and written.

        One row per id; columns that items lacks become null in them. The commit's number.
        """

        def change(last: dict | None):
            if last is None:
                return self._write(items, BUCKETS), [], items.schema
            touched = [str(r[0]) for r in items.select(self._bucket(last["of"]).alias("b")).distinct().collect()]  # at most one per bucket
            old = self._read(last, touched)
            merged = old.join(items.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(items, allowMissingColumns=True)
            return self._write(merged, last["of"]), touched, merged.schema

        return self._save(change, version, created_at, updated_at, tries)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete item folders that none of the last ``keep`` commits names, and earlier commits. Run it while nobody saves."""
        numbers = self._commits()
        named = {f.split("/")[1] for n in numbers[-keep:] for f in self.commit(n)["buckets"].values()}
        at, gone = self._path(f"{self.folder}/items"), []
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if s.getPath().getName() not in named:
                gone.append(s.getPath().getName())
                self._fs.delete(s.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/commits/{n:020d}.json"), False)
        return gone
