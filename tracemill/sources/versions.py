"""Tables behind a log of small manifests: a commit writes new folders, then one manifest names them.

Readers resolve the newest manifest, so they see all of a commit or nothing of it; what a failed commit wrote is removed and named nowhere.
A manifest is created exclusively under the next number: of two writers that started from one version, the second is told.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed first."""


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under what driver and executors share: spark.checkpoint.dir, else the context's own; a temporary one in local mode alone."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracemill-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """Small files and folders of any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sc = spark, spark.sparkContext
        self.jvm, self.conf = self.sc._jvm, self.sc._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        source = fs.open(p)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self.at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def put(self, path: str, text: str, replace: bool = False) -> None:
        """Write a whole file at once: it appears complete or not at all. Without replace an existing one raises Conflict."""
        held = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        self.write(held, text)
        fs, p = self.at(path)
        _, h = self.at(held)
        try:
            if not replace and fs.getUri().getScheme() == "file":  # a rename there would replace; a link is exclusive
                local = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(p), local(h))
                return
            rule = self.jvm.org.apache.hadoop.fs.Options.Rename
            rules = self.sc._gateway.new_array(rule, 1)
            rules[0] = rule.OVERWRITE if replace else rule.NONE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(h, p, rules)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{path} is there already") from None
            raise
        finally:
            self.delete(held)


@dataclass(frozen=True)
class Head:
    """A manifest: its number, for each table its paths, format and schema, and free settings."""

    version: int = 0
    tables: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


class Store:
    """Tables of one root. Version 0 has none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _log(self, version: int) -> str:
        return f"{self.root}/_log/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/_log") if n.endswith(".json") and n[:-5].isdigit()]

    def head(self, version: int | None = None) -> Head:
        found = self.versions()
        if version is None and not found:
            return Head()
        return Head(**json.loads(self.files.read(self._log(max(found) if version is None else version))))

    def write(self, df: DataFrame, name: str, *, format: str = "parquet", by: str | None = None, order_by: str | list[str] | None = None) -> dict:
        """The entry of df, written into a new folder that no manifest names yet; without a trace if that fails."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        out = (df.orderBy(order_by) if order_by else df).write.format(format)
        try:
            (out.partitionBy(by) if by else out).save(path)
        except Exception:
            self.files.delete(path)
            raise
        return {"paths": [path], "format": format, "schema": df.schema.jsonValue()}

    def publish(self, entries: dict[str, dict], *, expect: int | None = None, meta: dict | None = None) -> Head:
        """The next version: the tables of the head with these entries in place of their own. Raises Conflict if the head is no more at version expect."""
        head = self.head()
        if expect is not None and head.version != expect:
            raise Conflict(f"version {head.version} instead of {expect}")
        new = Head(head.version + 1, {**head.tables, **entries}, {**head.meta, **(meta or {})})
        self.files.put(self._log(new.version), json.dumps(new.__dict__))
        return new

    def commit(self, tables: dict[str, DataFrame], *, expect: int | None = None, meta: dict | None = None, format: str = "parquet", order_by: str | list[str] | None = None) -> Head:
        """Write all tables, then show them together. If anything fails, readers keep what they had. An expected version is fixed before writing."""
        expect = self.head().version if expect is None else expect
        entries = {}
        try:
            for name, df in tables.items():
                entries[name] = self.write(df, name, format=format, order_by=order_by)
            return self.publish(entries, expect=expect, meta=meta)
        except Exception:
            for entry in entries.values():
                for path in entry["paths"]:
                    self.files.delete(path)
            raise

    def read(self, name: str, head: Head | None = None) -> DataFrame:
        """A table of the newest version, or of a head; a missing one raises KeyError."""
        entry = (head or self.head()).tables[name]
        schema = StructType.fromJson(entry["schema"])
        if not entry["paths"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(entry["format"]).load(entry["paths"])

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete manifests but the newest keep, and the folders that none of these names; returns the folders. Writers at work must have ended."""
        found = self.versions()
        kept = found[-keep:]
        named = {p[len(self.root) + 1 :].split("/")[0] for v in kept for e in self.head(v).tables.values() for p in e["paths"]}
        for v in found[:-keep]:
            self.files.delete(self._log(v))
        gone = [n for n in self.files.names(self.root) if not n.startswith("_") and n not in named]
        for n in gone:
            self.files.delete(f"{self.root}/{n}")
        return gone
