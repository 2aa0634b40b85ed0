"""Fact store on Parquet: scan, point lookup, append, partial update, delete; versions by exclusive manifests; atomic small files."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.functions.text import fact_key
from recallkit.operators import ingest


class ConflictError(RuntimeError):
    """Another writer has made the next version of a table."""


class Store:
    """One table per name under a folder that all executors reach.

    A version of a table is a manifest, a small file that is created only if nobody else has created it, so of two writers from the same version one
    fails with ConflictError and nothing is lost; the highest complete manifest counts, and data that no manifest names is never read. A manifest lists folders of
    rows in order, and folders of keys that hide the rows of earlier folders: appending, updating and deleting write what changes, and
    `compact` writes the table anew, dealt by user. Reads and writes of a `Store` start from the version that it read last.
    """

    #: Folders of hidden keys after which an update or delete compacts.
    MOST_HIDDEN = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, name: str) -> dict:
        """The highest complete manifest; version 0 if there is none."""
        fs, folder = self._file(f"{self.path}/{name}/versions")
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for file in names:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}/versions/{file}", wholetext=True).collect())
            try:
                return json.loads(text)
            except ValueError:  # its writer hasn't ended, or never will
                continue
        return {"version": 0, "data": [], "hidden": [], "key": "fact_id"}

    def _commit(self, name: str, old: dict, **changes) -> None:
        new = old | changes | {"version": old["version"] + 1}
        fs, p = self._file(f"{self.path}/{name}/versions/{new['version']:012d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception.getMessage()):
                raise ConflictError(f"{name}: version {new['version']} exists already") from e
            raise
        out.write(bytearray(json.dumps(new).encode()))
        out.close()

    def _put(self, name: str, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}/{folder}")
        return folder

    def exists(self, name: str) -> bool:
        return self._manifest(name)["version"] > 0

    def version(self, name: str) -> int:
        return self._manifest(name)["version"]

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self._manifest(name))

    def _rows(self, name: str, m: dict) -> DataFrame:
        at = lambda folders: [f"{self.path}/{name}/{f}" for f in folders]
        schema = self.spark.read.parquet(*at(m["data"][:1])).schema
        cuts = sorted({0, len(m["data"]), *(upto for _, upto in m["hidden"])})
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = self.spark.read.schema(schema).parquet(*at(m["data"][a:b]))
            later = [f for f, upto in m["hidden"] if upto > a]
            if later:
                rows = rows.join(self.spark.read.parquet(*at(later)).distinct(), m["key"], "left_anti").select(*schema.names)
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def write(self, name: str, df: DataFrame, key: str = "fact_id", seen: int | None = None) -> DataFrame:
        """df as the whole table; with seen, only if that is still the version."""
        m = self._manifest(name)
        if seen is not None and m["version"] != seen:
            raise ConflictError(f"{name}: version {m['version']}, not {seen}")
        if "user_id" in df.columns and m["version"]:
            df = df.repartitionByRange("user_id", *([key] if key in df.columns else [])).sortWithinPartitions("user_id")  # a scan of one user skips the others' files
        self._commit(name, m, data=[self._put(name, df)], hidden=[], key=key)
        return self.read(name)

    def compact(self, name: str) -> DataFrame:
        m = self._manifest(name)
        return self.write(name, self._rows(name, m), m["key"], m["version"])

    def scan(self, name: str, user: str | None = None, limit: int | None = None) -> DataFrame:
        df = self.read(name)
        df = df if user is None else df.where(F.col("user_id") == user)
        return df if limit is None else df.orderBy("fact_id").limit(limit)

    def get(self, name: str, ids: DataFrame) -> DataFrame:
        return self.read(name).join(ids.select("fact_id"), "fact_id", "left_semi")

    def append(self, name: str, facts: DataFrame) -> DataFrame:
        """New facts; without fact_id they get the hash of user and text, and known ids are left out."""
        if "fact_id" not in facts.columns:
            facts = facts.withColumn("fact_id", fact_key(F.col("user_id"), F.col("memory")))
        facts = facts.dropDuplicates(["fact_id"])
        m = self._manifest(name)
        if not m["version"]:
            return self.write(name, facts)
        old = self._rows(name, m)
        return self.add(name, facts.join(old.select("fact_id"), "fact_id", "left_anti"), m)

    def _fitted(self, name: str, m: dict, rows: DataFrame) -> DataFrame:
        """rows with the table's columns."""
        schema = self.spark.read.parquet(f"{self.path}/{name}/{m['data'][0]}").schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def add(self, name: str, rows: DataFrame, m: dict | None = None) -> DataFrame:
        """Rows added as they are."""
        m = m or self._manifest(name)
        self._commit(name, m, data=[*m["data"], self._put(name, self._fitted(name, m, rows))])
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that replace those of the same key, or are new."""
        m = self._manifest(name)
        folder = self._put(name, self._fitted(name, m, rows))
        keys = self._put(name, self.spark.read.parquet(f"{self.path}/{name}/{folder}").select(m["key"]).distinct())
        self._commit(name, m, data=[*m["data"], folder], hidden=[*m["hidden"], [keys, len(m["data"])]])
        return self._tidy(name)

    def update(self, name: str, delta: DataFrame) -> DataFrame:
        """Given columns overwritten where delta has a value, all others kept; only the rows of delta are written."""
        rows = self.get(name, delta)
        return self.upsert(name, ingest.update_partial(rows, delta))

    def delete(self, ids: DataFrame, *names: str) -> None:
        """Facts removed from every table named (facts, edges, postings, ..), by their fact_id."""
        for name in names:
            m = self._manifest(name)
            if m["key"] != "fact_id":
                raise ValueError(f"{name} is kept by {m['key']}")
            self._commit(name, m, hidden=[*m["hidden"], [self._put(name, ids.select("fact_id").distinct()), len(m["data"])]])
            self._tidy(name)

    def _tidy(self, name: str) -> DataFrame:
        return self.compact(name) if len(self._manifest(name)["hidden"]) > self.MOST_HIDDEN else self.read(name)


def write_json(path: str, value: object) -> None:
    """A small state file in one step: written beside, flushed, renamed; readable by its owner only."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(os.open(tmp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        json.dump(value, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def read_json(path: str, default: object = None) -> object:
    p = Path(path)
    try:
        return json.loads(p.read_text()) if p.exists() else default
    except ValueError:
        return default
