"""Results that are given out once: a Spark data source over a folder that all machines share.

    put(results, folder)                       # df.write.format("spanveil_once").mode("append").save(folder)
    first = take(spark, folder, "caller-1")    # spark.read.format("spanveil_once").option("taker", "caller-1").load(folder)

A write task puts its rows into a Parquet file of its own attempt. The job's commit lists the files of the attempts
that count in a manifest, ``ready/<job>.json``, so files of failed, repeated or slower attempts are never read.

A taker moves the manifests of all commits to ``taken/<its name>``. A move has one winner, so no other taker gets
those rows; and since the taker's manifests stay, its own tasks may be run again after a lost executor. A take is
whole when its folder has the mark ``_whole``: what is committed later is for another taker, and a taker that stopped
before the mark goes on with what is left. ``forget`` removes what a taker has had.

The move has one winner on file systems that rename (``file:``, ``hdfs:``); object stores copy, so two takers that
race there may both get a commit.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, WHOLE = "spanveil_once", "_whole"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system, and the folder's path in it; ``file:/x`` and plain paths as well."""
    plain = re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(plain)


def _listed(store: fs.FileSystem, folder: str) -> list[str]:
    """Manifests in a folder, in the order of their names; none where there is no folder."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.endswith(".json"))


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def _appear(store: fs.FileSystem, path: str, body: bytes) -> None:
    """Write a small file that is seen whole or not at all."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(body)
    store.move(hidden, path)


def _named(taker: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", taker):
        raise ValueError("a taker's name has letters, digits, dots, dashes and underscores, and doesn't begin with a dot")
    return taker


def claim(folder: str, taker: str) -> list[str]:
    """Take what is ready, unless this taker's take is whole already; its manifests. Small files only: one for each commit."""
    store, root = _store(folder)
    own = f"{root}/taken/{_named(taker)}"
    if store.get_file_info(f"{own}/{WHOLE}").type == fs.FileType.NotFound:
        store.create_dir(own)
        for path in _listed(store, f"{root}/ready"):
            try:
                store.move(path, f"{own}/{path.rsplit('/', 1)[1]}")
            except OSError:
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    raise
                # another taker was first
        _appear(store, f"{own}/{WHOLE}", b"")
    return _listed(store, own)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


@dataclass
class Part(InputPartition):
    path: str


class OnceWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema, self.job = folder, schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.folder)
        out, rows, name = None, 0, f"{uuid.uuid4().hex}.parquet"
        store.create_dir(f"{root}/parts/{self.job}")
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        out = pq.ParquetWriter(f"{root}/parts/{self.job}/{name}", batch.schema, filesystem=store)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        _appear(store, f"{root}/ready/{self.job}.json", json.dumps({"job": self.job, "schema": self.schema.jsonValue(), "parts": parts}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        gone = f"{root}/parts/{self.job}"
        if store.get_file_info(gone).type != fs.FileType.NotFound:
            store.delete_dir(gone)


class OnceReader(DataSourceReader):
    def __init__(self, folder: str, taker: str, schema: StructType):
        self.folder, self.taker, self.schema = folder, taker, schema

    def partitions(self) -> list[Part]:
        """A partition for each file. A take of nothing has one without a file, as Spark wants one."""
        store, root = _store(self.folder)
        made = []
        for path in claim(self.folder, self.taker):
            said = json.loads(_read(store, path))
            if StructType.fromJson(said["schema"]) != self.schema:
                raise ValueError(f"commit {said['job']} has other columns than those that are read")
            made += [Part(f"{root}/parts/{said['job']}/{p['name']}") for p in said["parts"]]
        return made or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            store, _ = _store(self.folder)
            with store.open_input_file(partition.path) as f:
                yield from pq.ParquetFile(f).iter_batches()


class Once(DataSource):
    """Options: path (or ``folder``), and for reading ``taker``. The columns are those of the first commit, unless ``.schema`` names them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _folder(self) -> str:
        folder = self.options.get("path") or self.options.get("folder")
        if not folder:
            raise ValueError("name the folder")
        return folder.rstrip("/")

    def schema(self) -> StructType:
        store, root = _store(self._folder())
        seen = [*_listed(store, f"{root}/taken/{_named(self.options.get('taker', ''))}"), *_listed(store, f"{root}/ready")]
        if not seen:
            raise ValueError("nothing is ready: name the columns with .schema()")
        return StructType.fromJson(json.loads(_read(store, seen[0]))["schema"])

    def reader(self, schema: StructType) -> OnceReader:
        return OnceReader(self._folder(), _named(self.options.get("taker", "")), schema)

    def writer(self, schema: StructType, overwrite: bool) -> OnceWriter:
        if overwrite:
            raise ValueError("commits are added, not written over: use mode('append')")
        return OnceWriter(self._folder(), schema)


def put(results: DataFrame, folder: str) -> None:
    """Add results as one commit. Null values and repeated rows stay; no rows make a commit without files."""
    results.sparkSession.dataSource.register(Once)
    results.write.format(FORMAT).mode("append").save(folder)


def take(spark: SparkSession, folder: str, taker: str, schema: StructType | str | None = None) -> DataFrame:
    """All that is ready now, for this taker alone. The same name gets the same rows again, however often tasks or queries are repeated."""
    spark.dataSource.register(Once)
    claim(folder, taker)
    read = spark.read.format(FORMAT).option("taker", taker)
    return (read if schema is None else read.schema(schema)).load(folder)


def forget(folder: str, taker: str) -> None:
    """Remove a taker's rows, files of attempts that don't count included. The name stays used: it takes nothing more."""
    store, root = _store(folder)
    for path in _listed(store, f"{root}/taken/{_named(taker)}"):
        parts = f"{root}/parts/{json.loads(_read(store, path))['job']}"
        if store.get_file_info(parts).type != fs.FileType.NotFound:
            store.delete_dir(parts)
        store.delete_file(path)
