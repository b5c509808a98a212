"""Versioned tables: new folders first, one manifest row set last.

A build writes every table into folders of its own (``<root>/<table>/build=<id>/...``) and
never touches folders of earlier builds. What makes it current is the last step: one small
JSON file, added to ``<root>/manifest`` by a single rename, that names the folders of every
table. A build that dies half-way leaves no manifest file, so readers keep the tables they
had; readers that opened the earlier version keep reading its folders until ``prune``.

A table may be kept in *segments* (one value of a column, here a season). A build can then
replace some segments and carry the others over from the version before, folder by folder,
without copying a row. A segment column that the table itself does not have is kept in the
folder names only (a *hidden* column).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from raceboard.sources.store import Layout, write_layout

MANIFEST = T.StructType([T.StructField("seq", T.LongType()), T.StructField("build", T.StringType()), T.StructField("table", T.StringType()),
                         T.StructField("schema", T.StringType()), T.StructField("hidden", T.ArrayType(T.StringType())),
                         T.StructField("folders", T.ArrayType(T.StringType()))])
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Table:
    """One table of one version: its full schema (with hidden columns) and its folders."""

    schema: T.StructType
    hidden: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()


@dataclass
class Build:
    """A version in the making: ``write`` and ``carry`` tables, then ``commit``."""

    store: "VersionedStore"
    seq: int
    id: str
    tables: dict[str, Table] = field(default_factory=dict)

    def write(self, name: str, df: DataFrame, layout: Layout | None = None, hidden: Collection[str] = (),
              replacing: Collection | None = None) -> DataFrame:
        """Write ``df`` as table ``name`` of this version and return its read-back.

        ``hidden`` columns of ``df`` are kept in folder names and are no part of the table.
        With ``replacing`` (values of the layout's segment column) ``df`` holds those
        segments only, and the folders of all others stay as the current version has them.
        """
        path = f"{name}/build={self.id}"
        write_layout(df, f"{self.store.root}/{path}", layout or Layout())
        folders = [path]
        if replacing is not None:
            gone = {_folder_value(v) for v in replacing}
            folders += [f for f in self.store.segments(self.store.current()[name], layout.segment) if segment_of(f, layout.segment) not in gone]
        self.tables[name] = Table(df.schema, tuple(hidden), tuple(folders))
        return self.store.frame(name, self.tables[name])

    def written(self, name: str) -> DataFrame:
        """Only the rows that this build itself wrote for ``name``."""
        table = self.tables[name]
        own = tuple(f for f in table.folders if _build_folder(f) == f"{name}/build={self.id}")
        return self.store.frame(name, Table(table.schema, table.hidden, own))

    def extend(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to the current version's table, in a folder of their own; no old row is copied."""
        before = self.store.current()[name]
        path = f"{name}/build={self.id}"
        df.select(*before.schema.names).write.parquet(f"{self.store.root}/{path}")
        self.tables[name] = Table(before.schema, before.hidden, (*before.folders, path))
        return self.store.frame(name, self.tables[name])

    def carry(self, name: str) -> DataFrame:
        """Keep table ``name`` as it is in the current version."""
        self.tables[name] = self.store.current()[name]
        return self.store.frame(name, self.tables[name])

    def commit(self) -> None:
        """Make this version the current one. Work tables (``work/...``) are not part of it."""
        rows = [(self.seq, self.id, name, t.schema.json(), list(t.hidden), list(t.folders))
                for name, t in self.tables.items() if not name.startswith("work/")]
        self.store.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.store.root}/manifest")


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[tuple[int, str]]:
        """``(seq, build)`` of every committed version, oldest first."""
        try:
            found = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").select("seq", "build").distinct().collect()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            found = []
        return sorted((r["seq"], r["build"]) for r in found)

    def tables(self, version: tuple[int, str]) -> dict[str, Table]:
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").where(f"seq = {version[0]} AND build = '{version[1]}'").collect()
        return {r["table"]: Table(T.StructType.fromJson(json.loads(r["schema"])), tuple(r["hidden"]), tuple(r["folders"])) for r in rows}

    def current(self) -> dict[str, Table]:
        """Tables of the newest committed version; none if nothing was committed yet."""
        all_ = self.versions()
        return self.tables(all_[-1]) if all_ else {}

    def begin(self) -> Build:
        all_ = self.versions()
        seq = all_[-1][0] + 1 if all_ else 1
        return Build(self, seq, f"v{seq}-{uuid.uuid4().hex[:12]}")

    def frame(self, name: str, table: Table, with_hidden: bool = False) -> DataFrame:
        """The table's rows; ``with_hidden`` adds the folder-only columns, on which filters prune folders."""
        wanted = [c for c in table.schema.names if with_hidden or c not in table.hidden]
        if not table.folders:
            return self.spark.createDataFrame([], table.schema).select(*wanted)
        reader = self.spark.read.schema(table.schema).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[f"{self.root}/{f}" for f in table.folders]).select(*wanted)

    def read(self, name: str, with_hidden: bool = False) -> DataFrame:
        """Table ``name`` of the current version."""
        return self.frame(name, self.current()[name], with_hidden)

    def segments(self, table: Table, column: str) -> list[str]:
        """The table's folders, split up to the partition folders that name a value of ``column``."""
        return [leaf for f in table.folders for leaf in ([f] if segment_of(f, column) is not None else self.leaf_folders(f))]

    def leaf_folders(self, path: str) -> list[str]:
        """The partition folders under ``path``, from the file listing Spark makes anyway."""
        listed = (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
                  .load(f"{self.root}/{path}").inputFiles())
        return sorted({path + unquote(f).rsplit("/", 1)[0].split(f"/{path}", 1)[1] for f in listed})

    def prune(self, keep: int = 1) -> list[str]:
        """Delete builds' folders that none of the newest ``keep`` versions reads; returns them.

        Readers of older versions fail afterwards, so this is a call of its own, and no build
        may be running: folders of unfinished builds go too. Deleting files needs the
        session's own file system access, which a remote session does not offer.
        """
        kept = self.versions()[-keep:]
        used = {_build_folder(f) for v in kept for t in self.tables(v).values() for f in t.folders}
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        above = len(fs.makeQualified(top).toString()) + 1
        gone = []
        for depth in ("*/build=*", "*/*/build=*"):
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, depth)):
                name = status.getPath().toString()[above:]
                if name not in used:
                    fs.delete(status.getPath(), True)
                    gone.append(name)
        return sorted(gone)


def _build_folder(folder: str) -> str:
    head, tail = folder.split("/build=", 1)
    return f"{head}/build={tail.split('/', 1)[0]}"


def _folder_value(value: object) -> str:
    return NULL_FOLDER if value is None else str(value)


def segment_of(folder: str, column: str) -> str | None:
    """The value of ``column`` in a partition folder's path."""
    for part in folder.split("/"):
        if part.startswith(f"{column}="):
            return part.split("=", 1)[1]
    return None
