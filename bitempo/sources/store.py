"""Versioned Parquet tables: a version is a manifest that names the folders of every table.

``manifest-<version>.json`` is never changed once it is there; the highest version is the current one. A writer claims
the next version first, by a file that only one writer can create, so no version is lost. An append
adds a folder and leaves the others as they are.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import SCHEMAS, conform, empty, schema

FORMAT = 5


class StoreError(Exception):
    """A store that can't be read or written."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset in local mode (tests)."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise StoreError("spark.checkpoint.dir names no folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "bitempo-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: a plan that starts anew and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bitempo-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for a DataFrame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df.cut_at)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Store:
    """Tables under a folder that Spark reaches. A reader sees one whole version."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    # A manifest is a one-line text file that Spark's file system API writes and renames.
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, text: str) -> None:
        """A new file; it is an error if there is one."""
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # the JVM's, of whatever file system
            raise StoreError(f"{path} is there already: another writer is at this version, or broke off (see vacuum)") from e
        out.write(bytearray(text.encode()))
        out.close()

    def _versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"format": FORMAT, "version": 0, "tables": {}}
        text = self.spark.read.text(f"{self.path}/manifest-{versions[-1]}.json").collect()
        found = json.loads("\n".join(r.value for r in text))
        if found["format"] > FORMAT:
            raise StoreError(f"written by a newer version ({found['format']} > {FORMAT})")
        return found

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def read(self, name: str) -> DataFrame:
        at = self.manifest()["tables"].get(name)
        return self.spark.read.schema(schema(name)).parquet(*(f"{self.path}/{x}" for x in at)) if at else empty(self.spark, name)

    def write(self, tables: dict[str, DataFrame]) -> int:
        """New contents of some tables as one new version: all are written before the manifest is."""
        return self._commit(tables, add=False)

    def append(self, name: str, rows: DataFrame) -> int:
        """A new version with further rows of a table; those that are there aren't written again."""
        return self._commit({name: rows}, add=True)

    def _commit(self, tables: dict[str, DataFrame], add: bool) -> int:
        if self.read_only:
            raise StoreError("opened for reading")
        old = self.manifest()
        version = old["version"] + 1
        self._put(f"{self.path}/_claim-{version}", "")
        claim = self._fs(f"{self.path}/_claim-{version}")
        try:
            at = dict(old["tables"])
            for name, df in tables.items():
                new = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
                conform(df, name).write.parquet(f"{self.path}/{new}")
                at[name] = [*(at.get(name, []) if add else []), new]
            if self._versions()[-1:] != [v for v in (old["version"],) if v]:
                raise StoreError("another writer was first")
            fs, temp = self._fs(f"{self.path}/_manifest-{uuid.uuid4().hex}")
            self._put(temp.toString(), json.dumps({"format": FORMAT, "version": version, "tables": at}))
            if not fs.rename(temp, self._fs(f"{self.path}/manifest-{version}.json")[1]):
                raise StoreError("the manifest could not be renamed")
        finally:
            claim[0].delete(claim[1], False)
        return version

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def all(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in SCHEMAS}

    def sizes(self) -> dict[str, int]:
        """Bytes of each table's current version."""
        out = {}
        for name, at in self.manifest()["tables"].items():
            out[name] = sum(fs.getContentSummary(p).getLength() for fs, p in (self._fs(f"{self.path}/{x}") for x in at))
        return out

    def vacuum(self) -> int:
        """Delete what the current manifest does not name, older manifests and claims too; the number of table folders.

        Not to be called while another writer is at work.
        """
        now = self.manifest()
        keep, gone = {x for at in now["tables"].values() for x in at}, 0
        for name in SCHEMAS:
            fs, p = self._fs(f"{self.path}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if f"{name}/{s.getPath().getName()}" not in keep:
                    gone += bool(fs.delete(s.getPath(), True))
        fs, p = self._fs(self.path)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.isFile() and re.match("_claim-|_manifest-|manifest-", n := s.getPath().getName()) and n != f"manifest-{now['version']}.json":
                fs.delete(s.getPath(), False)
        return gone


def open_readonly(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, read_only=True)
