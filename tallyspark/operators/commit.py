"""Several tables as one state: new versions are written beside the old ones and become readable all at once.

A state lives under one folder. ``commit`` writes every changed table into a folder of its own and then publishes a
manifest that names the folder of each table; whoever reads follows the newest manifest. A failure before that leaves
the state as it was, whatever was written. A manifest appears by one rename onto a name that nobody had, so of two
commits on top of one version the second one fails and can be tried again.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit was published on top of the version this one was made from."""


class State:
    """The tables of the newest version under ``root`` when this object was made; see ``refresh``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.refresh()

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}" if at else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all published versions, in order."""
        fs, at = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def refresh(self) -> "State":
        """Look at the newest version."""
        known = self.versions()
        self.version = known[-1] if known else 0
        self.tables = self._manifest(self.version) if known else {}
        return self

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"manifests/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of this version; one that was never committed is empty, with ``schema``."""
        if name not in self.tables:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        at = self.tables[name]
        return self.spark.read.schema(T.StructType.fromJson(at["schema"])).parquet(f"{self.root}/{at['folder']}")

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """Write the changed tables and publish them together with all others; the number of the new version."""
        tables = dict(self.tables)
        for name, df in changed.items():
            folder = f"tables/{name}-{uuid.uuid4().hex}"
            self._write(df, folder)
            tables[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        self._publish(self.version + 1, tables)
        self.version, self.tables = self.version + 1, tables
        return self.version

    def _write(self, df: DataFrame, folder: str) -> None:
        df.write.parquet(f"{self.root}/{folder}")

    def _publish(self, version: int, tables: dict) -> None:
        fs, draft, final = self._fs(), self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/{version}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} is there already")

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` versions and every folder that none of these names (also what failed
        commits left); the number of folders deleted. Not while another commit is under way."""
        fs, known = self._fs(), self.versions()
        live = {t["folder"] for v in known[-keep:] for t in self._manifest(v).values()}
        for v in known[:-keep]:
            fs.delete(self._path(f"manifests/{v}.json"), False)
        at = self._path("tables")
        dead = [n for n in (s.getPath().getName() for s in fs.listStatus(at)) if f"tables/{n}" not in live] if fs.exists(at) else []
        for n in dead:
            fs.delete(self._path(f"tables/{n}"), True)
        return len(dead)
